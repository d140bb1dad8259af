"""How far the terms of each source lie from those of its language and of its other sources.

Counts of terms by (lang, source) are postings of (lang, term). Smoothed probabilities are
whole billionths, and f = floor((p - q)^2 / q) compares a group's p with another's q.

Pairs of sources: terms that neither has add one and the same value, those that only one has
depend on its count alone, so counts of equal terms stand for them; only terms that both
have meet, in a join of the postings.

The terms of a group that lie farthest over their language: the group's terms are put in
buckets by count. A bucket's largest p and its least q in the language bound every f in it.
Buckets are evaluated from the highest bound down, some terms at once, until the bounds of
those not yet seen are strictly below the group's k-th value; the other terms get no f.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fernweave.llm.store import released, stored
from fernweave.llm.text import blocks, coded, word_array, words

#: Words that a task gathers before it hands out their counts, buckets for each doubling of a
#: count, parts in which a group's best terms are taken first.
GATHERED, STEPS, PARTS = 1 << 20, 8, 8
UNIT = 1_000_000_000

#: Terms `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` once A-Z are lower-cased.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True

Group = tuple[str, str]


def _summed(held: list[tuple[pa.Array, np.ndarray, np.ndarray]], groups: list[Group]) -> pa.RecordBatch:
    dictionary, ids = coded([x for x, _, _ in held])
    group, doc = (np.concatenate([h[i] for h in held]) for i in (1, 2))
    d = max(len(dictionary), 1)
    key, c = np.unique(group * d + ids, return_counts=True)
    own = np.unique(doc * d + ids)
    of = np.zeros(int(doc.max()) + 1, dtype=np.int64)
    of[doc] = group
    _, df = np.unique(of[own // d] * d + own % d, return_counts=True)
    lang, source = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(key // d)) for i in (0, 1))
    return pa.RecordBatch.from_arrays([lang, source, dictionary.take(pa.array(key % d)), pa.array(c, pa.int64()), pa.array(df, pa.int64())], ["lang", "source", "term", "c", "df"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, c, df): occurrences, and rows with the term, of a stretch of rows."""
    held, groups, total, rows = [], {}, 0, 0
    for batch in batches:
        for at, to, texts in blocks(batch, "text"):
            w = words(texts, LETTERS)
            pairs = zip(*(batch.column(c).slice(at, to - at).to_pylist() for c in ("lang", "source")), strict=True)
            own = np.array([groups.setdefault(x, len(groups)) for x in pairs], dtype=np.int64)
            row = np.repeat(np.arange(to - at), np.diff(w.edges))
            if len(row):
                held.append((word_array(w), own[row], row + rows))
                total, rows = total + len(row), rows + to - at
            if total >= GATHERED:
                yield _summed(held, list(groups))
                held, groups, total, rows = [], {}, 0, 0
    if held:
        yield _summed(held, list(groups))


def _p(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (count + 1) / (total + kept)), exactly; UNIT's multiple may pass 64 bits."""
    exact = (F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.lit(1) + F.call_function("div", exact, (total + kept).cast("decimal(38,0)")).cast("long")


def far(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): p and q are at most UNIT + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def source_terms(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Stored (lang, source, term, c, p, q, p0) of the terms that a group has and its language
    keeps, in `least` rows or more; q is the language's, p0 the group's for a term it lacks.
    And (lang, source, p0, kept) of all groups, with the number of terms kept."""
    texts = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = texts.mapInArrow(_term_counts, "lang string, source string, term string, c long, df long")
    counts = stored(counts.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("df").alias("df")), "terms")
    terms = counts.groupBy("lang", "term").agg(F.sum("c").alias("all"), F.sum("df").alias("df")).where(F.col("df") >= least)
    terms = stored(terms.drop("df"), "terms")
    own = stored(counts.drop("df").join(terms, ["lang", "term"]), "kept")
    released(counts)
    sizes = own.groupBy("lang", "source").agg(F.sum("c").alias("total"))
    langs = terms.groupBy("lang").agg(F.sum("all").alias("spoken"), F.count("*").alias("kept"))
    every = texts.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    every = every.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "spoken", "kept")])
    p0 = F.when(F.col("kept") > 0, _p(F.lit(0), F.col("total"), F.greatest("kept", F.lit(1))))
    groups = stored(every.withColumn("p0", p0), "groups")
    joined = own.join(groups, ["lang", "source"])
    p, q = _p(F.col("c"), F.col("total"), F.col("kept")), _p(F.col("all"), F.col("spoken"), F.col("kept"))
    scored = stored(joined.select("lang", "source", "term", "c", p.alias("p"), q.alias("q"), "p0"), "probabilities")
    released(own)
    released(terms)
    return scored, groups.select("lang", "source", "p0", "kept")


def source_pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): every group with every other source of its language, f
    summed over all terms that the language keeps, the item's p for q."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    keys = ["lang", "source", "item"]
    apart = F.col("source") != F.col("item")
    neither = F.coalesce(F.col("kept") * far(F.col("p0"), F.col("q0")), F.lit(0))
    base = groups.join(other, "lang").where(apart).select(*keys, neither.alias("value"))
    alike = scored.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n")).join(other, "lang").where(apart)
    here = F.col("n") * (far(F.col("p"), F.col("q0")) - far(F.col("p0"), F.col("q0")))
    there = F.col("n") * (far(F.col("q0"), F.col("p")) - far(F.col("q0"), F.col("p0")))
    single = alike.select("lang", F.explode(F.array(F.struct("source", "item", here.alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), there.alias("value")))).alias("x"))
    postings = scored.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q, p0, q0 = map(F.col, ("p", "q", "p0", "q0"))
    more = far(p, q) - far(p, q0) - far(p0, q) + far(p0, q0)
    both = scored.drop("q").join(postings, ["lang", "term"]).where(apart).groupBy(*keys).agg(F.sum(more).alias("value"))
    rows = base.union(single.select("lang", "x.source", "x.item", "x.value").groupBy(*keys).agg(F.sum("value").alias("value"))).union(both)
    return rows.groupBy(*keys).agg(F.sum("value").alias("value"))


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k first of each group, taken in parts of the group first."""
    order = [F.desc("value"), "item"]
    part = rows.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS)))
    some = part.withColumn("k", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(*order))).where(F.col("k") <= k)
    return some.withColumn("k", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order))).where(F.col("k") <= k).select("lang", "source", "item", "value")


def farthest_terms(scored: DataFrame, k: int = 200) -> DataFrame:
    """(lang, source, item, value): each group's k terms of highest f among those with p over
    the language's q, ties by the term, by best-first evaluation of buckets."""
    keys = ["lang", "source", "bucket"]
    cut = scored.withColumn("bucket", F.floor(F.log2("c") * STEPS).cast("int"))
    over = cut.where("p > q").groupBy(*keys).agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count("*").alias("n"))
    cells = stored(over.select(*keys, "n", far(F.col("p"), F.col("q")).alias("bound")), "buckets")
    best, quota = None, k
    while True:
        left = cells
        if best is not None:
            least = best.groupBy("lang", "source").agg(F.count("*").alias("held"), F.min("value").alias("kth")).where(F.col("held") >= k)
            left = left.join(seen, keys, "left_anti").join(least, ["lang", "source"], "left").where("kth is null or bound >= kth")
        before = F.coalesce(F.sum("n").over(W.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        chosen = stored(left.withColumn("before", before).where(F.col("before") < quota).select(*keys), "chosen")
        if best is not None and chosen.isEmpty():
            return best
        rows = cut.where("p > q").join(chosen, keys, "left_semi").select("lang", "source", F.col("term").alias("item"), far(F.col("p"), F.col("q")).alias("value"))
        best = stored(_best(rows if best is None else rows.union(best), k), "best")
        seen = chosen if quota == k else seen.union(chosen)
        quota *= 4


def source_divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3, k: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: of each group (lang, source), part `pair` has all
    other sources of the language, part `term` its k terms farthest over the language.

    Null text, language and source are ''. A group without kept terms has pairs and no terms;
    repeated rows count again; an empty table gives no row; other columns are not looked at.
    """
    scored, groups = source_terms(df, text_col, lang_col, source_col, least)
    parts = [x.select("lang", "source", F.lit(name).alias("part"), "item", "value") for name, x in (("pair", source_pairs(scored, groups)), ("term", farthest_terms(scored, k)))]
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return parts[0].union(parts[1]).withColumn("rank", F.row_number().over(order))
