"""Corpus queries with SQL give the rows that DuckDB gives for it."""

import pytest

from fernweave.llm.queries import ORACLE, QUERIES
from tests.test_oracle import duck, lines

__all__ = ["duck"]  # a fixture


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_the_sql(spark, sf, duck, name):  # noqa: F811
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert lines(got.columns, got.collect()) == lines(columns, want.fetchall())
