"""Choosing rows: preferences, skylines, champions, adoption of a candidate over a baseline."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fernweave.functions.quantiles import joined
from fernweave.functions.scalar import guarded_rate, symmetric_delta_percent
from fernweave.sources.shared import written


def preferred(df: DataFrame, keys: list[str], order: list[Column], seq: str, columns: list[str], last_of_ties: bool = True) -> DataFrame:
    """One row a key: the greatest in the order given, and of exact ties the last (or first)
    by seq. An aggregate, so rows are combined before the shuffle."""
    tie = F.col(seq) if last_of_ties else -F.col(seq)
    best = F.max_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], tie.alias("tie")))
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(best.alias("_b")).select(*keys, "_b.*")


#: The keys of each preference, greatest first, of candidates with width, fps and colours.
PREFERENCES = {
    "balanced": ("width", "fps", "colours"),
    "clarity": ("width", "colours", "fps"),
    "smoothness": ("fps", "width", "colours"),
    "smallest": (),
}


def by_preference(preference: str) -> list[Column]:
    """The order of a preference, then fewer bytes."""
    return [*map(F.col, PREFERENCES[preference]), -F.col("bytes")]


def fit_label(size: Column, target: Column, window: tuple[Column, Column], searching: Column) -> Column:
    """How a search's best size fits: exact in the window (as of search.size_window), under up to
    the target, over while the search has a next candidate, else unreachable, also without any size."""
    least, ceiling = window
    exact = (size >= least) & (size <= ceiling)
    return F.when(exact, "exact").when(size <= target, "under").when(size.isNotNull() & searching, "over").otherwise("unreachable")


#: Routes of re-spent bytes by rank, the route that comes first otherwise, the one
#: that clarity avoids, and the dithers that clarity and the other preferences look for.
REINVESTED = {"perceptual_reinvest_corrected": 2, "perceptual_reinvest": 1}
BASELINE, PERCEPTUAL, CLEAR_DITHER, PLAIN_DITHER = "baseline", "perceptual_timeline", "sierra2_4a", "bayer"


def select_route(routes: DataFrame, keys: list[str], seq: str, preference: str, stats: Column, target: Column, tolerance_percent: float, symmetric: bool = False) -> DataFrame:
    """One row a key: the route chosen from those that were encoded (size not null), or no row.

    routes: keys, seq, route, dither, stats_mode, size, cfr. A symmetric match takes the routes
    of constant rate: within the tolerance first, then the closest, the baseline, the first.
    A hard cap takes what the target holds if any does: clarity by re-spent bytes, dither,
    recommended statistics, no perceptual timeline, baseline, fewest bytes; smallest by bytes
    alone (the first of ties); else baseline, recommended statistics, dither, fewest bytes.
    Of other ties the last is taken.
    """
    made = routes.where("size is not null")
    size, route = F.col("size"), F.col("route")
    if symmetric:
        apart = symmetric_delta_percent(size, target)
        order = [apart <= min(max(tolerance_percent, 1.0), 25.0), -apart, route == BASELINE]
        return preferred(made.where("cfr"), keys, order, seq, [seq, "route", "size"], last_of_ties=False)
    fits = size <= target
    reinvested = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in REINVESTED.items() for x in pair]), route), F.lit(0))
    recommended = F.col("stats_mode") == stats
    order = {
        "clarity": [reinvested, F.col("dither") == CLEAR_DITHER, recommended, route != PERCEPTUAL, route == BASELINE, -size],
        "smallest": [-size],
    }.get(preference, [route == BASELINE, recommended, F.col("dither") == PLAIN_DITHER, -size])
    return preferred(made, keys, [fits, *order], seq, [seq, "route", "size"], last_of_ties=preference != "smallest")


def best_observation(df: DataFrame, keys: list[str], size: str, target: str, window: tuple[Column, Column], order: list[Column], seq: str, columns: list[str]) -> DataFrame:
    """One row a key: of those in the window (least and greatest size that hit, as of
    search.size_window) if there are any, else of those up to its upper end, the selection
    ceiling, else the closest in bytes; within the first two by the order given."""
    least, ceiling = window
    tier = F.when((F.col(size) >= least) & (F.col(size) <= ceiling), 2).when(F.col(size) <= ceiling, 1).otherwise(0)
    near = F.when(tier == 0, -F.abs(F.col(size) - F.col(target)))
    return preferred(df, keys, [tier, near, *order], seq, columns)


#: Values of a dimension are cut so that a key has about so many cells; rows of a cell that one
#: task compares at once before the cell is put together; rows of a block of comparisons;
#: survivors of cells that meet others together.
CELLS, PART, BLOCK, MET = 1024, 1 << 15, 512, 4096


def _dominated(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which rows another one is as low as in every column, and lower in one."""
    out = np.zeros(len(rows), dtype=bool)
    for at in range(0, len(rows), BLOCK):
        own = rows[at : at + BLOCK, None, :]
        for to in range(0, len(others), 8 * BLOCK):
            them = others[None, to : to + 8 * BLOCK, :]
            out[at : at + BLOCK] |= ((them <= own).all(axis=2) & (them < own).any(axis=2)).any(axis=1)
    return out


def local_skyline(rows: np.ndarray) -> np.ndarray:
    """Places of the distinct rows that no other dominates. Of two columns, in order of the first,
    those below all before them in the second. Of more, in the order of their sums no row
    dominates an earlier one, so a block meets those kept before it, and itself."""
    if rows.shape[1] == 2 and len(rows):
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        below = np.append(np.inf, np.minimum.accumulate(rows[order, 1])[:-1])
        return order[(rows[order, 1] < below) | (np.arange(len(order)) == 0)]
    order = np.lexsort((*rows.T, rows.sum(axis=1)))
    kept = np.zeros(0, dtype=np.int64)
    for at in range(0, len(order), BLOCK):
        own = order[at : at + BLOCK]
        own = own[~_dominated(rows[own], rows[own])]
        own = own[~_dominated(rows[own], rows[kept])]
        kept = np.append(kept, own)
    return kept


def skyline(df: DataFrame, keys: list[str], low: list[str], high: list[str], feasible: Column | None = None) -> DataFrame:
    """Of the feasible rows, those that no other one of the key dominates: as good in every column
    (less in `low`, more in `high`) and better in one. Equal rows do not dominate each other; a
    row with a null in any column neither dominates nor is dominated. Columns are numbers.

    Distinct value combinations are compared, not rows. Each key's space is cut into cells by
    bounds between like numbers of values, unless one task compares it all. A cell that lies beyond an occupied one in every
    dimension goes as a whole; the others keep their local skylines, large cells in parts first.
    A survivor then meets those of the cells that are not beyond its own in any dimension: the
    only ones that could dominate it. They meet in blocks of cells of about MET survivors.
    """
    df = df if feasible is None else df.where(feasible)
    values = [*low, *high]
    d, some = len(values), F.lit(True)
    for c in values:
        some = some & F.col(c).isNotNull()
    least = [F.col(c).cast("double") for c in low] + [-F.col(c).cast("double") for c in high]
    own = written(df.where(some).select(*keys, *values).distinct().withColumn("_v", F.array(*least)), "combinations")
    steps = max(2, round(CELLS ** (1 / d)))
    cuts = F.array(*[F.lit(i / steps) for i in range(1, steps)])
    bounds = own.groupBy(*keys).agg(F.count("*").alias("_all"), F.array(*[F.percentile_approx(F.col("_v")[i], cuts, 1 << 12) for i in range(d)]).alias("_b"))
    at = F.zip_with("_v", "_b", lambda x, b: F.when(F.col("_all") > PART, F.size(F.filter(b, lambda y: y < x))).otherwise(0))
    celled = written(joined(own, bounds, keys).withColumn("_cell", at).drop("_b", "_all"), "celled")
    cells = celled.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    every = lambda a, b, less: F.forall(F.zip_with(a, b, (lambda x, y: x < y) if less else (lambda x, y: x <= y)), lambda ok: ok)
    other = cells.select(*keys, F.col("_cell").alias("_other"))
    pairs = written(joined(cells, other, keys).where(every("_other", "_cell", False)), "cells")
    beyond = pairs.where(every("_other", "_cell", True)).select(*keys, "_cell").distinct()
    open_ = joined(cells, beyond, [*keys, "_cell"], "left_anti")
    alive = joined(celled, open_, [*keys, "_cell"]).withColumn("_part", F.pmod(F.xxhash64("_v"), F.ceil(F.col("_n") / PART)).cast("int")).withColumn("_several", F.col("_n") > PART).drop("_n")
    schema = alive.schema

    def local(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[local_skyline(np.array(group["_v"].tolist(), dtype=float))]

    def met(key: tuple, own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(others):
            return own.iloc[:0]
        return own[_dominated(np.array(own["_v"].tolist(), dtype=float), np.array(others["_v"].tolist(), dtype=float))]

    parts = written(alive.groupBy(*keys, "_cell", "_part").applyInPandas(local, schema), "parts")
    together = parts.where("_several").groupBy(*keys, "_cell").applyInPandas(local, schema)
    whole = written(parts.where("not _several").union(together).drop("_part", "_several"), "survivors")
    # Survivors are put together to blocks, so that blocks meet, not the many small cells.
    held = whole.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    ahead = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)  # a row a cell
    block = F.floor(F.coalesce(F.sum("_n").over(ahead), F.lit(0)) / MET).cast("long")
    subs = F.when(F.col("_n") > MET, F.ceil(F.col("_n") / MET)).otherwise(1).cast("int")
    blocks = written(held.select(*keys, "_cell", block.alias("_at"), subs.alias("_subs")), "blocks")
    deal = lambda side: joined(side, blocks, [*keys, "_cell"]).withColumn("_block", F.array("_at", F.pmod(F.xxhash64("_v"), F.col("_subs"))))
    dealt = written(deal(whole).drop("_at", "_subs", "_cell"), "dealt")
    parts_of = lambda name: blocks.select(*keys, F.col("_cell").alias(name), F.explode(F.transform(F.sequence(F.lit(0), F.col("_subs") - 1), lambda i: F.array("_at", i.cast("long")))).alias(f"{name}_block"))
    near = joined(joined(pairs.where("_cell <> _other").select(*keys, "_cell", "_other"), parts_of("_cell"), [*keys, "_cell"]), parts_of("_other"), [*keys, "_other"])
    meet = near.select(*keys, F.col("_cell_block").alias("_block"), F.col("_other_block").alias("_with")).distinct()
    tested = joined(dealt, meet, [*keys, "_block"])
    testing = joined(dealt.withColumnRenamed("_block", "_with"), meet, [*keys, "_with"]).select(*tested.columns).toDF(*tested.columns)
    unit = [*keys, "_block", "_with"]
    gone = tested.groupBy(*unit).cogroup(testing.groupBy(*unit)).applyInPandas(met, tested.schema).select(*keys, *values).distinct()
    kept = joined(whole.select(*keys, *values), gone, [*keys, *values], "left_anti")
    return joined(df.where(some), kept, [*keys, *values], "left_semi").union(df.where(~some))


def size_matched(df: DataFrame, keys: list[str], size: str, target: str, quality: str, seq: str, columns: list[str]) -> DataFrame:
    """One row a key: the closest in percent, then in bytes, then of the best quality, then the first."""
    order = [-symmetric_delta_percent(F.col(size), F.col(target)), -F.abs(F.col(size) - F.col(target)), F.col(quality)]
    return preferred(df, keys, order, seq, columns, last_of_ties=False)


def smallest_accepted(df: DataFrame, keys: list[str], accepted: str, size: str, baseline: str, seq: str, columns: list[str], least_bytes: int = 64, least_share: float = 0.01) -> DataFrame:
    """One row a key: the smallest accepted candidate that saves at least the greater of
    least_bytes and least_share of the baseline."""
    saving = F.col(baseline) - F.col(size)
    enough = saving >= F.greatest(F.lit(float(least_bytes)), F.col(baseline) * least_share)
    return preferred(df.where(F.col(accepted) & enough), keys, [-F.col(size)], seq, columns, last_of_ties=False)


def adopt(candidate: Column, original: Column, control: Column, cap: Column, passed: Column) -> Column:
    """struct(status, bytes): the candidate if it passed its gate, is under the cap and smaller than the
    original and the same writer's control; else the original, with the reason."""
    status = (
        F.when(candidate.isNull(), "no_candidate")
        .when(~F.coalesce(passed, F.lit(False)), "rejected")
        .when(cap.isNotNull() & (candidate > cap), "over_cap")
        .when((candidate >= original) | (candidate >= control), "no_gain")
        .otherwise("adopted")
    )
    return F.struct(status.alias("status"), F.when(status == "adopted", candidate).otherwise(original).alias("bytes"))


def first_fit(df: DataFrame, keys: list[str], size: str, cap: str, ladder: str, seq: str, columns: list[str]) -> DataFrame:
    """One row a key: the highest rung of the ladder that fits under the cap, the first of equal rungs."""
    return preferred(df.where(F.col(size) <= F.col(cap)), keys, [F.col(ladder)], seq, columns, last_of_ties=False)


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with its rank from 1 in a total order."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def bounding_box(df: DataFrame, keys: list[str], x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """The smallest box around all boxes of a key."""
    return df.groupBy(*keys).agg(F.min(x0).alias(x0), F.min(y0).alias(y0), F.max(x1).alias(x1), F.max(y1).alias(y1))


def reinvested_width(width: Column, size: Column, target: Column, ceiling: Column) -> Column:
    """A width that spends spare bytes: by the square root of what is left, 4 % short of it."""
    grown = F.floor(width * F.sqrt(guarded_rate(target, size)) * 0.96).cast("int")
    return F.when(size < target, F.greatest(width, F.least(grown, ceiling))).otherwise(width)


def area_interpolated_width(low: Column, high: Column, low_bytes: Column, high_bytes: Column, target: Column) -> Column:
    """Between two widths, the one whose area meets 98 % of the target on a straight line in bytes."""
    share = (target * 0.98 - low_bytes) / (high_bytes - low_bytes)
    area = low * low + (high * high - low * low) * share
    return F.when((low_bytes < target) & (high_bytes > target), F.floor(F.sqrt(area)).cast("int"))
