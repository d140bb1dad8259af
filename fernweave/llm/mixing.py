"""Temperature mixing of sources.

Shares of the sources in the tokens, raised to an exponent between 0 (all alike) and 1 (as
they are) and scaled to sum 1, are the weights. The exponent is bisected to the flattest
mix whose most repeated source is read at most so often, or to the least flat mix of a
wanted entropy. The weights are realised over a budget of tokens in blocks: each source
is read in permutations, a new one for each epoch, and a block takes from each source its
weight's share of the block's tokens.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fernweave.llm.running import hash_place, with_running_totals
from fernweave.llm.store import stored

#: Intervals that a round of the bisection tries at once (five halvings), and rounds.
INTERVALS, ROUNDS = 32, 6
#: Most sources that are broadcast; with more, their rows are spread over SALTS copies and joined.
BROADCAST_SOURCES, SALTS = 100_000, 64
_NULL = "\u0000"
#: Columns that mix_sources() adds.
ADDED = ["n_tokens", "weight", "epoch", "block", "place"]


def word_tokens(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` and one end: at least 1, for null too."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


@dataclass
class Mix:
    """The solved exponent, with what it gives over `tokens` of `sources`."""

    exponent: float
    scale: float  # sum of the shares raised to the exponent
    tokens: int
    sources: int
    budget: int


def solve(sums: DataFrame, budget_share: float = 1.0, max_repeat: float | None = None, entropy: float | None = None) -> Mix:
    """sums: a row a source, with its tokens (at least 1). Give max_repeat or entropy.

    max_repeat: the smallest exponent in 0 to 1 with which no source is read more often
    (1 if none is). entropy: the largest with which the weights have that entropy in nats
    (0 if none has). Each round evaluates INTERVALS + 1 exponents in one aggregation of the
    source table and goes on in the interval in which the answer changes. Rounded to 6 places.
    """
    if (max_repeat is None) == (entropy is None):
        raise ValueError("give max_repeat or entropy")
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    budget = math.floor(total.t * budget_share)
    if not total.n:
        return Mix(1.0, 1.0, 0, 0, 0)
    shares = sums.select((F.col("tokens") / F.lit(total.t)).alias("p"))

    def ahead(exponents: list[float]) -> list[bool]:
        """Whether each exponent is at or beyond the one sought, seen from 0."""
        each = shares.select("p", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        rows = each.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("s"), F.max(F.pow("p", F.col("a") - 1)).alias("m")).collect()
        by = {r.a: r for r in rows}
        if max_repeat is not None:
            return [budget_share * by[a].m / by[a].z <= max_repeat + 1e-12 for a in exponents]
        return [math.log(by[a].z) - a * by[a].s / by[a].z < entropy for a in exponents]

    low, high = 0.0, 1.0
    first, last = ahead([0.0, 1.0])
    if first or not last:
        exponent = 0.0 if first else 1.0
    else:
        for _ in range(ROUNDS):
            tried = [low + (high - low) * i / INTERVALS for i in range(INTERVALS + 1)]
            k = ahead(tried).index(True)
            low, high = tried[k - 1], tried[k]
        exponent = round(high if max_repeat is not None else low, 6)
    scale = shares.agg(F.sum(F.pow("p", F.lit(exponent))).alias("z")).first().z
    return Mix(exponent, scale, total.t, total.n, budget)


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (with _id and _source), each with the columns of its source."""
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), "_source")
    salted = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS))).join(salted, ["_source", "_salt"])


def _planned(df: DataFrame, source_col: str, id_col: str, text_col: str, budget_share: float, max_repeat: float | None, entropy: float | None, tokens: Column | None) -> DataFrame:
    """_whole and _row (all columns, and those that mix_sources() does not replace), _id, _source
    and n_tokens of each row, with tokens, weight, quota and epochs of its source; only rows of
    sources that are read."""
    counted = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_whole"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ADDED]).alias("_row"),
        F.col(id_col).cast("string").alias("_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL)).alias("_source"),
        (word_tokens(F.col(text_col)) if tokens is None else tokens).alias("n_tokens"),
    )
    sums = stored(counted.groupBy("_source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    mix = solve(sums, budget_share, max_repeat, entropy)
    weight = F.pow(F.col("tokens") / F.lit(max(mix.tokens, 1)), F.lit(mix.exponent)) / F.lit(mix.scale)
    plan = sums.select("_source", "tokens", F.round(weight, 9).alias("weight")).withColumn("quota", F.floor(F.col("weight") * F.lit(mix.budget)).cast("long"))
    return _with_sources(counted, plan.withColumn("epochs", F.ceil(F.col("quota") / F.col("tokens")).cast("int"))).where("epochs > 0")


def mix_sources(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", budget_share: float = 1.0, max_repeat: float | None = 1.5, entropy: float | None = None, block_tokens: int = 1 << 20, seed: int = 17, tokens: Column | None = None) -> DataFrame:
    """df's rows as often as the mix reads them, with n_tokens, weight (of the source, 9
    places), epoch (from 0), block and place (the order within a block and source).

    Of a source with weight w the first floor(w * budget) tokens are read, in permutations of
    the whole source by a hash of seed, epoch and id: a row is in if its first token is. Rows
    of one id, and those without one, are in the order of a hash of all their columns, so
    which of them are read does not depend on how the table is dealt out. A
    null source is one of its own; null texts have one token; repeated rows are rows of
    their own; columns named like the added ones are replaced; an empty table gives none.
    """
    read = _planned(df, source_col, id_col, text_col, budget_share, max_repeat, entropy, tokens)
    read = read.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    read = read.withColumn("place", hash_place(F.lit(seed), F.col("epoch"), F.col("_id"))).withColumn("_tie", F.xxhash64("_row"))
    run = with_running_totals(read, ["_source", "epoch"], "place", {"n_tokens": "_before"}, tie="_tie")
    at = F.col("epoch") * F.col("tokens") + F.col("_before")
    share = F.greatest(F.lit(1), F.floor(F.col("weight") * F.lit(block_tokens)).cast("long"))
    return run.withColumn("_at", at).where("_at < quota").withColumn("_share", share).withColumn("block", F.expr("_at div _share")).select("_row.*", *ADDED)


def draw(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", budget_share: float = 1.0, max_repeat: float | None = 1.5, entropy: float | None = None, seed: int = 17, tokens: Column | None = None) -> DataFrame:
    """The rows that mix_sources() reads, as often as it reads them, with the columns of df.

    All epochs of a source but the last are whole. Running totals over hashes of the rows say
    after which place the last one ends; rows are then kept where they are read, so no text is
    shuffled. Of equal rows at that place as many copies are kept as are read.
    """
    read = _planned(df, source_col, id_col, text_col, budget_share, max_repeat, entropy, tokens)
    read = read.withColumn("place", hash_place(F.lit(seed), F.col("epochs") - 1, F.col("_id"))).withColumn("_tie", F.xxhash64("_row"))
    keys = read.groupBy("_source", "place", "_tie").agg(F.count("*").alias("_m"), F.sum("n_tokens").alias("n_tokens"), F.first("quota").alias("quota"), F.first("tokens").alias("tokens"), F.first("epochs").alias("epochs"))
    run = with_running_totals(keys, ["_source"], "place", {"n_tokens": "_before"}, tie="_tie")
    run = run.withColumn("_left", F.col("quota") - (F.col("epochs") - 1) * F.col("tokens") - F.col("_before"))
    taken = F.least("_m", F.expr("(_left * _m + n_tokens - 1) div n_tokens"))
    ends = stored(run.where("_left > 0").groupBy("_source").agg(F.max(F.struct("place", "_tie", taken.alias("taken"), "_m")).alias("_end")), "ends")
    both = _with_sources(read.select("_whole", "_id", "_source", "place", "_tie", "epochs"), ends)
    here, end = F.struct("place", "_tie"), F.struct("_end.place", "_end._tie")
    cut = (here == end) & (F.col("_end.taken") < F.col("_end._m"))
    times = F.col("epochs") - 1 + F.when((here <= end) & ~cut, 1).otherwise(0)
    some = both.select("_whole", F.explode(F.array_repeat(F.lit(0), times)).alias("_i"))
    copies = both.where(cut).groupBy("_source", "_whole").agg(F.count("*").alias("_m"), F.first("_end.taken").alias("taken"))
    before = F.coalesce(F.sum("_m").over(W.partitionBy("_source").orderBy(F.xxhash64("_whole")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    share = F.least(F.col("_m"), F.col("taken") - before).cast("int")
    rest = copies.select("_whole", share.alias("_n")).where("_n > 0").select("_whole", F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_i"))
    return some.union(rest).select("_whole.*")
