"""Every query with SQL gives the rows that DuckDB gives for the SQL."""

import datetime
import decimal
import math

import duckdb
import pytest

from fernweave.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The corpus operators' queries are compared in their own tests.
QUERIES, ORACLE = catalogue.QUERIES, catalogue.ORACLE


def plain(value):
    """A value as both engines would print it."""
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int | float | decimal.Decimal):
        x = float(value)
        return "nan" if math.isnan(x) else f"{x + 0.0:.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_the_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert lines(got.columns, got.collect()) == lines(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_sql_give_the_same_rows_again(spark, sf, name):
    """Whole rows, twice: the second time from tables that are dealt out differently."""
    got = QUERIES[name](spark, sf)
    first = lines(got.columns, got.collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = QUERIES[name](spark, sf)
        assert first and lines(again.columns, again.collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
