"""Report aggregates: slices at several grains, counters with precedence, tallies, coverage,
calibration and shares."""

from pyspark.sql import Column, DataFrame, functions as F

from fernweave.functions.quantiles import counted_percentiles, joined, rank_nearest, selected
from fernweave.functions.scalar import clamp, guarded_rate, wilson_interval
from fernweave.sources.shared import written


def grouping_sets(df: DataFrame, grains: dict[str, list[str]], aggregates: list[Column], columns: list[str]) -> DataFrame:
    """One aggregation at several grains: `grain` names the row's grain, columns that are not
    part of it are null. grains: name to the columns it groups by; columns: all of them."""
    labels = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in own): name for name, own in grains.items()}
    grain = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    grouped = df.groupingSets([[F.col(f"`{c}`") for c in own] for own in grains.values()], *[F.col(f"`{c}`") for c in columns])
    return grouped.agg(F.grouping_id().cast("int").alias("_grain"), *aggregates).withColumn("grain", F.element_at(grain, F.col("_grain"))).drop("_grain")


def slices(df: DataFrame, grains: dict[str, list[str]], columns: list[str], measures: list[str]) -> DataFrame:
    """Rows, and of each measure the count, P50, P95 and maximum (nulls left out), at several
    grains: `grain` names the row's grain, columns that are not part of it are null.

    Values are counted once at the finest grain, written, and rolled up from there; ranks are
    selected as in quantiles.selected, so the overall grain needs no task of its own size.
    """
    long = df.select(*columns, F.inline(F.array(*[F.struct(F.lit(m).alias("_m"), F.col(m).cast("double").alias("_v")) for m in measures])))
    counts = written(long.groupBy(*columns, "_m", "_v").agg(F.count("*").alias("_w")), "counted")
    at = lambda name, own: F.struct(F.lit(name).alias("grain"), *[(F.col(c) if c in own else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in columns])
    rolled = counts.select("_m", "_v", "_w", F.explode(F.array(*[at(name, own) for name, own in grains.items()])).alias("_g")).select("_g.*", "_m", "_v", "_w")
    keys = ["grain", *columns]
    whole = rolled.groupBy(*keys, "_m").agg(F.sum("_w").alias("rows"), F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))), F.lit(0)).alias("count"), F.max("_v").alias("max"))
    ranks = selected(rolled.where("_v is not null"), [*keys, "_m"], "_v", {"p50": rank_nearest(0.5), "p95": rank_nearest(0.95)})
    both = joined(whole, ranks, [*keys, "_m"], "left")
    of = lambda c, m: F.max(F.when(F.col("_m") == m, F.col(c))).alias(f"{m}_{c}")
    return both.groupBy(*keys).agg(F.max("rows").alias("rows"), *[of(c, m) for m in measures for c in ("count", "p50", "p95", "max")])


def with_empty_groups(report: DataFrame, dim: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """A report by key with a row for each key of the dimension: counts of a key without rows are 0."""
    joined = dim.select(key).distinct().join(report, key, "left")
    return joined.select(key, *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in counts else F.col(c) for c in report.columns if c != key])


def hard_cap_counts(size: Column, cap: Column, correct: Column) -> list[Column]:
    """Counters in which the first that applies takes the row: unknown cap, not measurable,
    over the cap, incorrect, hit. The rate is of hits among rows with a known cap."""
    state = F.when(cap.isNull(), "unknown").when(size.isNull(), "unmeasurable").when(size > cap, "over").when(~F.coalesce(correct, F.lit(False)), "incorrect").otherwise("hit")
    names = ("unknown", "unmeasurable", "over", "incorrect", "hit")
    return [*[F.count_if(state == n).alias(f"n_{n}") for n in names], guarded_rate(F.count_if(state == "hit"), F.count_if(state != "unknown")).alias("hit_rate")]


def calibration(df: DataFrame, keys: list[str], ratio: str, corrected: Column) -> DataFrame:
    """keys and, of the measured ratios: count, mean, P95, share of corrected rows, and a
    recommended factor 0.96 / sqrt(P95) held to 0.75 to 0.99 once there are 3."""
    whole = df.groupBy(*keys).agg(
        F.count(ratio).alias("samples"),
        F.avg(ratio).alias("mean_ratio"),
        guarded_rate(F.count_if(corrected & F.col(ratio).isNotNull()), F.count(ratio)).alias("correction_rate"),
    )
    both = joined(whole, counted_percentiles(df, keys, ratio, {"p95_ratio": 0.95}), keys, "left")
    factor = F.when(F.col("samples") >= 3, clamp(0.96 / F.sqrt("p95_ratio"), 0.75, 0.99))
    return both.withColumn("recommended_factor", factor)


def tally(outcome: str) -> list[Column]:
    """Wins, losses and ties, the rate of wins among decisive rows with its Wilson interval,
    and the score in which a tie counts half."""
    wins, losses, ties = (F.count_if(F.col(outcome) == n) for n in ("win", "loss", "tie"))
    interval = wilson_interval(wins, wins + losses)
    return [
        wins.alias("wins"), losses.alias("losses"), ties.alias("ties"),
        guarded_rate(wins, wins + losses).alias("decisive_rate"),
        guarded_rate(wins + ties / 2, wins + losses + ties).alias("tie_aware_score"),
        interval["low"].alias("wilson_low"), interval["high"].alias("wilson_high"),
    ]


def metric_summary(df: DataFrame, keys: list[str], value: str, reference: str, outcome: str, severe: str) -> DataFrame:
    """keys and a summary of signed improvements: outcomes, rates, mean, extremes, percentiles,
    severe losses."""
    whole = df.groupBy(*keys).agg(
        *tally(outcome)[:4],
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(reference).alias("mean_reference"),
        F.count_if(F.col(severe)).alias("severe"),
    )
    return joined(whole, counted_percentiles(df, keys, value, {"p05": 0.05, "p50": 0.5, "p95": 0.95}), keys, "left")


def vote_coverage(votes: DataFrame, expected: DataFrame, reviewer: str, pair: str) -> DataFrame:
    """Per reviewer: votes on expected pairs, and the coverage of all expected pairs."""
    due = expected.select(pair).distinct()
    n_due = due.agg(F.count("*").alias("n_due"))
    cast = votes.join(due, pair, "left_semi").select(reviewer, pair).distinct().groupBy(reviewer).agg(F.count("*").alias("n_votes"))
    return votes.select(reviewer).distinct().join(cast, reviewer, "left").join(F.broadcast(n_due), how="cross").select(
        reviewer, F.coalesce("n_votes", F.lit(0)).alias("n_votes"), "n_due", guarded_rate(F.coalesce("n_votes", F.lit(0)), F.col("n_due")).alias("coverage")
    )


def shares(df: DataFrame, keys: list[str], part: str, value: Column) -> DataFrame:
    """Sum of value by keys and part, and its share of the keys' total. The total comes from
    the sums, not from the rows."""
    sums = df.groupBy(*keys, part).agg(F.sum(value).alias("amount"))
    totals = sums.groupBy(*keys).agg(F.sum("amount").alias("_all")) if keys else sums.agg(F.sum("amount").alias("_all"))
    joined = sums.join(totals, keys) if keys else sums.join(F.broadcast(totals), how="cross")
    return joined.select(*keys, part, "amount", guarded_rate(F.col("amount"), F.col("_all")).alias("share"))


def paired_saving(baseline: Column, optimised: Column) -> Column:
    """Saving of a pair in percent of its baseline; the summary is the median of these."""
    return guarded_rate((baseline - optimised) * 100.0, baseline)


def colour_histogram(pixels: DataFrame, keys: list[str], bin_: Column, weight: Column, channels: list[str]) -> DataFrame:
    """Weight and weighted channel sums of each colour bin."""
    return pixels.groupBy(*keys, bin_.alias("bin")).agg(F.sum(weight).alias("weight"), *[F.sum(F.col(c) * weight).alias(f"{c}_sum") for c in channels])


def histogram_distance(a: DataFrame, b: DataFrame, keys: list[str], bin_col: str, count: str) -> DataFrame:
    """Half the L1 distance of two histograms as shares of their counts: 0 equal, 1 disjoint."""
    total = lambda df, n: df.select(*keys, bin_col, F.col(count).alias(n))
    both = total(a, "_a").join(total(b, "_b"), [*keys, bin_col], "full").na.fill(0, ["_a", "_b"])
    sums = both.groupBy(*keys).agg(F.sum("_a").alias("_sa"), F.sum("_b").alias("_sb"))
    joined = both.join(sums, keys) if keys else both.join(F.broadcast(sums), how="cross")
    one = F.abs(F.coalesce(guarded_rate(F.col("_a"), F.col("_sa")), F.lit(0.0)) - F.coalesce(guarded_rate(F.col("_b"), F.col("_sb")), F.lit(0.0)))
    return joined.groupBy(*keys).agg((F.sum(one) / 2).alias("distance"))
