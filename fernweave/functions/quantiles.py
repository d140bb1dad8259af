"""The percentiles that reports use; they differ and none stands for another.

Ranks of groups of any size are selected by splitters. Values are counted before the shuffle;
a mergeable summary of a group's counted values, made in the same pass as their number, gives
bounds that cut them into cells of like numbers, whatever their spread. Sums of the cells say
in which one a rank lies, and only those cells go on. Cells that are still large are cut again;
a window orders the values of the last, small ones.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fernweave.sources.shared import written

#: Cells of a round, accuracy of the summary, and values of a cell that are ordered at once.
CELLS, ACCURACY, ORDERED = 256, 4096, 1 << 16


# Ranks, from 1, as columns of the count of values.


def rank_nearest(p: float):
    """ceil(n p), at least 1."""
    return lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(p) - 1e-9))


def rank_rounded_index(p: float):
    """The place round((n - 1) p), halves up."""
    return lambda n: F.floor((n - 1) * F.lit(p) + 0.5) + 1


def rank_upper_median(n: Column) -> Column:
    """The middle, the larger of two."""
    return F.floor(n / 2) + 1


def rank_lower_median(n: Column) -> Column:
    """The middle, the smaller of two."""
    return F.floor((n + 1) / 2)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys are equal; the left side's keys stay."""
    renamed = right.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_j{i}"))
    if not keys:
        return left.join(F.broadcast(right), how="cross") if how == "inner" else left  # one row
    return left.join(renamed, same, how).drop(*[f"_j{i}" for i in range(len(keys))])


def counted(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """keys, value and _w, the weight of each distinct value, without nulls; written."""
    return written(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(weight.alias("_w")), "counted")


def measured(held: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: its weight, its number of values, and bounds between its cells."""
    steps = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    finite = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    bounds = F.percentile_approx(finite, steps, ACCURACY)
    return written(held.groupBy(*keys).agg(F.sum("_w").alias("_all"), F.count("*").alias("_d"), bounds.alias("_b")), "groups")


def cell_of(value: str, ordered: int | None = None) -> Column:
    """How many of the sorted bounds _b are not beyond the value, by binary search; 0 in groups
    of up to `ordered` values. _d and _b are those of measured()."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(CELLS.bit_length()))])
    further = lambda lo, s: (lo + s <= F.size("_b")) & (F.get("_b", lo + s - 1) <= F.col(value))
    return F.when((F.col("_d") > (ORDERED if ordered is None else ordered)) & F.col("_b").isNotNull(), F.aggregate(steps, F.lit(0), lambda lo, s: F.when(further(lo, s), lo + s).otherwise(lo))).otherwise(0)


def selected(held: DataFrame, keys: list[str], value: str, thresholds: dict) -> DataFrame:
    """held: keys, value, _w, written. keys and, for each (name, threshold), the first value in
    ascending order at which the running _w reaches the threshold, a function of their sum."""
    groups = measured(held, keys, value)
    every = F.array(*[F.struct(F.lit(n).alias("_name"), t(F.col("_all")).cast("double").alias("_at")) for n, t in thresholds.items()])
    wants, by = groups.select(*keys, F.inline(every)), list(keys)
    while (groups.agg(F.max("_d").alias("d")).first().d or 0) > ORDERED:
        cell = f"_cell{len(by)}"
        celled = joined(held, groups.select(*by, "_d", "_b"), by).withColumn(cell, cell_of(value)).select(*by, cell, value, "_w")
        sums = celled.groupBy(*by, cell).agg(F.sum("_w").cast("double").alias("_s"))
        along = W.partitionBy(*by).orderBy(cell)
        runs = sums.withColumn("_upto", F.sum("_s").over(along.rowsBetween(W.unboundedPreceding, 0)))
        runs = runs.withColumn("_before", F.lag("_upto").over(along)).withColumn("_last", F.lead(cell).over(along).isNull())
        hit = (F.col("_before").isNull() | (F.col("_before") < F.col("_at"))) & ((F.col("_at") <= F.col("_upto")) | F.col("_last"))
        rest = F.col("_at") - F.coalesce("_before", F.lit(0.0))
        wants = written(joined(runs, wants, by).where(hit).select(*by, cell, "_name", rest.alias("_at")), "ranks")
        by = [*by, cell]
        held = written(joined(celled, wants.select(*by).distinct(), by).select(*by, value, "_w"), "cells")
        groups = measured(held, by, value)
    inside = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    run = held.select(*by, value, F.sum("_w").over(inside).cast("double").alias("_upto"))
    found = joined(run, wants, by).where("_upto >= _at").groupBy(*keys, "_name").agg(F.min(value).alias("_v"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in thresholds])


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: dict, count: str | None = None) -> DataFrame:
    """keys and, for each (name, rank), the value of that rank in ascending order; rank is a
    function of the column with the group's count. count names a column of how many times a
    row counts. Nulls are left out; a group of nulls does not appear. NaN is the greatest."""
    return selected(counted(df, keys, value, F.count("*") if count is None else F.sum(count)), keys, value, ranks)


def counted_percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """keys and, for each (name, p), the nearest-rank percentile (see ranked_values)."""
    return ranked_values(df, keys, value, {name: rank_nearest(p) for name, p in ps.items()})


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the middle value or the mean of the two middle ones."""
    found = ranked_values(df, keys, value, {"_low": rank_lower_median, "_high": rank_upper_median})
    return found.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, p: float = 0.95) -> DataFrame:
    """keys, the weighted mean and the first value, in ascending order, at which the running
    weight reaches p of the total. Weights of equal values are summed before the shuffle.
    Null values or weights are left out."""
    held = counted(df.where(F.col(weight).isNotNull()), keys, value, F.sum(weight))
    means = held.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col("_w")), F.sum("_w")).alias("weighted_mean"))
    return joined(means, selected(held, keys, value, {"weighted_percentile": lambda total: total * p}), keys, "left")
