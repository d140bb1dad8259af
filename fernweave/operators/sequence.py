"""Operators on ordered rows of a key: islands, prefix sums, as-of values, apportionment.

A key may hold a large share of all rows. `prefix_sums`, `carry_last`, `asof`, `islands`,
`merge_ranges` and `hold_dropped` therefore cut a key's order into cells of a fixed width of
the order column; what a cell needs from the cells before it is aggregated first, so that no
window over rows spans more than a cell. Their keys are not null. Operators whose windows span
a whole key say so.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _cell(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def prefix_sums(df: DataFrame, keys: list[str], order: str, ties: list[str], value: str, width: int, name: str = "before") -> DataFrame:
    """df with the sum of value over the key's rows before each one, in the order of (order,
    ties): 0 for the first. order is an integer column; value nulls count as 0."""
    cut = df.withColumn("_cell", _cell(order, width))
    sums = cut.groupBy(*keys, "_cell").agg(F.sum(value).alias("_s"))
    ahead = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_cell", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*keys, "_cell").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    joined = cut.join(offsets, [*keys, "_cell"])
    return joined.select(*df.columns, (F.col("_off") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias(name))


def carry_last(df: DataFrame, keys: list[str], order: str, ties: list[str], value: Column, width: int, name: str) -> DataFrame:
    """df with the last non-null value at or before each row of its key, null before the first."""
    cut = df.withColumn("_cell", _cell(order, width)).withColumn("_v", value)
    lasts = cut.where("_v is not null").groupBy(*keys, "_cell").agg(F.max_by("_v", F.struct(order, *ties)).alias("_l"))
    every = cut.select(*keys, "_cell").distinct().join(lasts, [*keys, "_cell"], "left")
    ahead = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = every.select(*keys, "_cell", F.last("_l", ignorenulls=True).over(ahead).alias("_start"))
    inside = W.partitionBy(*keys, "_cell").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0)
    joined = cut.join(starts, [*keys, "_cell"])
    return joined.select(*df.columns, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_start")).alias(name))


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], width: int) -> DataFrame:
    """left with the columns of the latest right row of the key at or before its time, null
    if none. Both are put in one order, right rows first at equal times, and the last right
    row is carried on. Times are integers; of right rows of one time the greatest is taken.
    """
    entry = F.struct(*[F.col(c).alias(c) for c in columns])
    r = right.groupBy(*keys, F.col(right_time).alias("_t")).agg(F.max(entry).alias("_e")).withColumn("_side", F.lit(0)).withColumn("_row", F.lit(None).cast(left.schema.simpleString()))
    le = left.select(*keys, F.col(left_time).alias("_t"), F.lit(None).cast(r.schema["_e"].dataType).alias("_e"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = carry_last(r.select(le.columns).union(le), keys, "_t", ["_side"], F.col("_e"), width, "_found")
    return both.where("_side = 1").select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in columns])


def _numbered(flagged: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """flagged (with _cell and _new, 1 where a run begins) with the run of each row, from 0."""
    ahead = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    sums = flagged.groupBy(*keys, "_cell").agg(F.sum("_new").alias("_n")).select(*keys, "_cell", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_runs"))
    inside = W.partitionBy(*keys, "_cell").orderBy(*order, F.desc("_new")).rowsBetween(W.unboundedPreceding, 0)
    return flagged.join(sums, [*keys, "_cell"]).withColumn(name, F.col("_runs") + F.sum("_new").over(inside) - 1)


def islands(df: DataFrame, keys: list[str], order: list[str], same: list[str], measure: str, width: int, least: Column | None = None) -> DataFrame:
    """Runs of adjacent rows with equal `same` columns: key, run (from 0), the shared columns,
    first and last order value, rows, and the sum of the measure. A null equals a null.
    order: an integer column, then ties. least: a condition on all rows of a key without which
    nothing of it is merged."""
    state = F.struct(*same)
    cut = df.withColumn("_cell", _cell(order[0], width))
    along = W.partitionBy(*keys).orderBy("_cell")
    lasts = cut.groupBy(*keys, "_cell").agg(F.max_by(state, F.struct(*order)).alias("_last"))
    prior = lasts.select(*keys, "_cell", F.lag("_last").over(along).alias("_before"), (F.row_number().over(along) == 1).alias("_head"))
    inside = W.partitionBy(*keys, "_cell").orderBy(*order)
    first = F.row_number().over(inside) == 1
    begins = (first & F.col("_head")) | ~state.eqNullSafe(F.when(first, F.col("_before")).otherwise(F.lag(state).over(inside)))
    joined = cut.join(prior, [*keys, "_cell"])
    if least is not None:
        joined = joined.join(df.groupBy(*keys).agg(F.every(least).alias("_ok")), keys)
        begins = begins | ~F.col("_ok")
    run = _numbered(joined.withColumn("_new", begins.cast("int")), keys, order, "run")
    return run.groupBy(*keys, "run", *same).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("rows"), F.sum(measure).alias("total"))


def number_ranges(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Ranges of consecutive integers: key, first, last. Repeated numbers count once."""
    one = df.select(*keys, number).where(F.col(number).isNotNull()).distinct()
    along = W.partitionBy(*keys).orderBy(number)
    return one.withColumn("_g", F.col(number) - F.row_number().over(along)).groupBy(*keys, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_g")


def merge_ranges(df: DataFrame, keys: list[str], start: str, end: str, width: int, slack: float = 0) -> DataFrame:
    """Ranges of a key that overlap or lie within slack of each other, merged: key, start, end
    and how many were merged. start is an integer column."""
    cut = df.withColumn("_cell", _cell(start, width))
    ahead = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    reached = cut.groupBy(*keys, "_cell").agg(F.max(end).alias("_m")).select(*keys, "_cell", F.max("_m").over(ahead).alias("_reach"))
    inside = W.partitionBy(*keys, "_cell").orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    reach = F.greatest("_reach", F.max(end).over(inside))
    joined = cut.join(reached, [*keys, "_cell"])
    flagged = joined.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + slack), 1).otherwise(0))
    run = _numbered(flagged, keys, [start, end], "_run")
    return run.groupBy(*keys, "_run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("merged")).drop("_run")


def removed_before(times: DataFrame, ranges: DataFrame, keys: list[str], time: str, width: int) -> DataFrame:
    """times with how much of the key's disjoint ranges (start, end) lies before each time: what is
    subtracted to get the time after the ranges are cut out. The range that began last says what
    of it lies before, a running sum what all before it removed. Times are integers."""
    spans = ranges.select(*keys, "start", "end", (F.col("end") - F.col("start")).alias("_length"))
    summed = prefix_sums(spans, keys, "start", ["end"], "_length", width, "_before")
    last = summed.select(*keys, F.col("start").alias("_start"), F.col("end").alias("_end"), "_before")
    found = asof(times, last, keys, time, "_start", ["_start", "_end", "_before"], width)
    own = F.col("_before") + F.least("_end", time) - F.col("_start")
    return found.withColumn("removed", F.coalesce(own, F.lit(0)).cast("long")).drop("_start", "_end", "_before")


def next_outside(times: DataFrame, merged: DataFrame, keys: list[str], time: str, width: int) -> DataFrame:
    """times with `playable`: the time itself, or the end of the merged range that holds it, which
    is the one that began last."""
    last = merged.select(*keys, F.col("start").alias("_start"), F.col("end").alias("_end"))
    found = asof(times, last, keys, time, "_start", ["_start", "_end"], width)
    return found.withColumn("playable", F.greatest(F.col(time), F.coalesce("_end", time))).drop("_start", "_end")


def apportion(df: DataFrame, keys: list[str], order: str, amount: str, unit: int) -> DataFrame:
    """df with `units`: amounts in whole units that sum to the key's total, rounded. Floors
    first; what is left goes one each to the largest remainders, ties to the earlier row."""
    every = W.partitionBy(*keys)
    ranked = W.partitionBy(*keys).orderBy(F.desc("_rem"), order)
    base = df.withColumn("_floor", F.expr(f"`{amount}` div {unit}")).withColumn("_rem", F.col(amount) % unit)
    due = F.floor((F.sum(amount).over(every) + unit // 2) / unit) - F.sum("_floor").over(every)
    return base.withColumn("units", (F.col("_floor") + F.when(F.row_number().over(ranked) <= due, 1).otherwise(0)).cast("long")).drop("_floor", "_rem")


def spread_over(df: DataFrame, keys: list[str], order: str, buckets: int) -> DataFrame:
    """df with `bucket`: places of a key dealt evenly into at most `buckets` by floor(place *
    buckets / rows). The sizes differ from those of ntile where it does not divide."""
    n = F.count("*").over(W.partitionBy(*keys))
    k = F.least(n, F.lit(buckets))
    return df.withColumn("bucket", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1) * k / n).cast("int"))


def keep_every(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """df with `kept`: every n-th row of a key, and always its first and last."""
    along = W.partitionBy(*keys).orderBy(order)
    place, last = F.row_number().over(along) - 1, F.count("*").over(W.partitionBy(*keys)) - 1
    return df.withColumn("kept", (place % n == 0) | (place == last))


def hold_dropped(df: DataFrame, keys: list[str], order: str, kept: str, duration: str, width: int) -> DataFrame:
    """Kept rows with the time they are held: each dropped row extends the last kept one
    before it, leading ones the first kept. A key that keeps nothing does not appear."""
    firsts = df.where(F.col(kept)).groupBy(*keys).agg(F.min(order).alias("_first"))
    carried = carry_last(df, keys, order, [], F.when(F.col(kept), F.col(order)), width, "_own").join(firsts, keys)
    return carried.groupBy(*keys, F.coalesce("_own", "_first").alias(order)).agg(F.sum(duration).alias("held"), F.count("*").alias("rows"))


def nearest_kept_gap(df: DataFrame, keys: list[str], order: str, kept: str) -> DataFrame:
    """df with `gap`: the distance in order to the nearest kept row, null if the key keeps none."""
    along = W.partitionBy(*keys).orderBy(order)
    own = F.when(F.col(kept), F.col(order))
    back = F.col(order) - F.last(own, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(own, ignorenulls=True).over(along.rowsBetween(0, W.unboundedFollowing)) - F.col(order)
    return df.withColumn("gap", F.least(back, ahead))


def adjacent(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """df with `delta` to the row before (0 for the first), and `spike`: whether it is over
    twice the median of the deltas of the two rows before and after."""
    along = W.partitionBy(*keys).orderBy(*order)
    with_delta = df.withColumn("delta", F.coalesce(F.abs(F.col(value) - F.lag(value).over(along)), F.lit(0.0)))
    near = [F.lag("delta", i).over(along) for i in (2, 1)] + [F.lead("delta", i).over(along) for i in (1, 2)]
    others = F.array_sort(F.array_compact(F.array(*near)))
    n = F.size(others)
    middle = (F.get(others, F.floor((n - 1) / 2).cast("int")) + F.get(others, F.floor(n / 2).cast("int"))) / 2
    return with_delta.withColumn("spike", F.coalesce((n > 0) & (F.col("delta") > 2 * middle), F.lit(False)))


def interpolate(asked: DataFrame, keyframes: DataFrame, keys: list[str], time: str, at: str, value: str, width: int) -> DataFrame:
    """asked with `value` at its time on straight lines between keyframes, the first and last
    one's value outside them; null for a key without any. Of keyframes of one time the greatest
    value counts. Integer times, non-null values."""
    along = W.partitionBy(*keys).orderBy(at)
    one = keyframes.groupBy(*keys, at).agg(F.max(value).alias("_v"))
    spans = one.select(*keys, F.col(at).alias("_k"), F.col("_v"), F.lead(at).over(along).alias("_k2"), F.lead("_v").over(along).alias("_v2"))
    firsts = one.groupBy(*keys).agg(F.min_by("_v", at).alias("_first"))
    found = asof(asked, spans, keys, time, "_k", ["_k", "_v", "_k2", "_v2"], width).join(firsts, keys, "left")
    line = F.col("_v") + (F.col("_v2") - F.col("_v")) * (F.col(time) - F.col("_k")) / (F.col("_k2") - F.col("_k"))
    out = F.when(F.col("_k").isNull(), F.col("_first")).when(F.col("_k2").isNull(), F.col("_v")).otherwise(line)
    return found.select(*asked.columns, out.alias("value"))


def looped_clock(time: Column, offset: Column, start: Column, length: Column) -> Column:
    """A source time that runs from offset and starts again after length, from start on."""
    return start + F.pmod(offset + time, length)


def source_time(local: Column, source_in: Column, source_out: Column, rate: Column, reverse: Column, hold: Column) -> Column:
    """The source time of a clip at a local time: held, forward or reversed, inside the clip."""
    moved = F.floor(local * rate + 0.5).cast("long")
    ahead = F.least(source_in + moved, source_out - 1)
    back = F.greatest(source_out - 1 - moved, source_in)
    return F.when(hold > 0, source_in).when(reverse, back).otherwise(ahead)
