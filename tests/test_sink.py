"""The report sink: all or nothing, appended, overwritten, damaged."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fernweave.sources import sink as K

SCHEMA = "k long, t string, d double"


def left(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def rows(df):
    return sorted((r.k, r.t, r.d) for r in df.collect())


def test_sink(spark, tmp_path):
    folder = f"{tmp_path}/out"
    made = spark.range(20, numPartitions=5).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('é"\n'), "id")).alias("t"), (F.col("id") / 7).alias("d"))
    want = rows(made)
    K.write_committed(made.where("k < 12"), folder)
    assert rows(K.read_committed(spark, folder, SCHEMA)) == want[:12]
    assert sum(r.rows for r in K.committed_files(spark, folder).collect()) == 12 and K.damaged_files(spark, folder).count() == 0

    # A task that fails takes the others' files with it; what was there stays.
    before = left(folder)
    broken = made.where("k >= 12").select("k", F.when(F.col("k") < 19, F.col("t")).otherwise(F.raise_error(F.lit("no"))).alias("t"), "d")
    with pytest.raises(Exception, match="no"):
        K.write_committed(broken, folder)
    assert left(folder) == before and rows(K.read_committed(spark, folder, SCHEMA)) == want[:12]

    K.write_committed(made.where("k >= 12"), folder)
    assert rows(K.read_committed(spark, folder, SCHEMA)) == want
    assert len(left(folder)) == K.committed_files(spark, folder).count() + 1
    stray = Path(folder) / "side-0" / "x.jsonl"
    stray.parent.mkdir()
    stray.write_text('{"k":99}\n')
    assert rows(K.read_committed(spark, folder, SCHEMA)) == want
    first = Path(folder) / K.committed_files(spark, folder).first().name
    first.write_text("{}\n")
    assert [r.difference for r in K.damaged_files(spark, folder).collect()] == ["changed"]

    K.write_committed(made.where("k = 3"), folder, overwrite=True)
    assert rows(K.read_committed(spark, folder, SCHEMA)) == [want[3]] and len(left(folder)) == 3  # the stray file stays
    K.write_committed(made.where("k < 0"), folder, overwrite=True)
    assert rows(K.read_committed(spark, folder, SCHEMA)) == []


def test_a_failing_first_write_leaves_nothing(spark, tmp_path):
    folder = f"{tmp_path}/new"
    broken = spark.range(40, numPartitions=8).select(F.when(F.col("id") < 39, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("k"))
    with pytest.raises(Exception, match="no"):
        K.write_committed(broken, folder)
    assert left(folder) == []
