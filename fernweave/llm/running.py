"""Running totals over very large groups, without a group in one task."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Parts that a group's rows are split into by their place in the order.
PARTS = 256


#: Places are below this: 15 hexadecimal digits.
PLACES = 1 << 60


def hash_place(*columns: Column) -> Column:
    """A random-looking but repeatable place in 0 to PLACES - 1, from the MD5 of the columns
    as text, joined by '/' (nulls left out): an order that splits evenly."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[c.cast("string") for c in columns])), 1, 15), 16, 10).cast("long")


def quick_place(*columns: Column) -> Column:
    """As hash_place, by one 64-bit hash of the columns."""
    return F.xxhash64(*columns).bitwiseAND(PLACES - 1)


def with_running_totals(df: DataFrame, groups: list[str], place: str, values: dict[str, str], parts: int = PARTS, tie: str | None = None) -> DataFrame:
    """df with, for each (column, name) of values, the column's total over all rows of the
    same group that come before in the order of `place` (a long of hash_place), as `name`.

    Rows of one place are in the order of `tie`; rows equal in that too are in some order
    among themselves. Each group is split by the
    leading bits of the place into `parts`; their totals, `parts` rows a group at most,
    are summed up first, so a window over rows only holds one part. The number of
    groups must be bounded by the caller, the number of rows need not be.
    """
    cut = df.withColumn("_part", F.expr(f"cast({place} div {PLACES // parts} as int)"))
    names = list(values.items())
    totals = cut.groupBy(*groups, "_part").agg(*[F.sum(c).alias(f"_sum{i}") for i, (c, _) in enumerate(names)])
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_part", *[F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)).alias(f"_off{i}") for i in range(len(names))])
    row = W.partitionBy(*groups, "_part").orderBy(place, *([tie] if tie else [])).rowsBetween(W.unboundedPreceding, -1)
    joined = cut.join(offsets, [*groups, "_part"])
    return joined.select(*df.columns, *[(F.col(f"_off{i}") + F.coalesce(F.sum(c).over(row), F.lit(0))).alias(n) for i, (c, n) in enumerate(names)])
