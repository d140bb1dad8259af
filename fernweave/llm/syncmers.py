"""Document fingerprints from closed syncmers.

A k-mer of K words is kept if the smallest hash of its S-mers stands first or last among
them. Whether it is kept depends on its own words only, so the same passage yields the
same anchors in any context. A fingerprint holds all anchors of the whole text with their
positions. Two fingerprints are matched by position: of each hash that both hold, the first
anchors of the two and the last ones vote for an offset. At each of the offsets with most
votes, anchors of one hash at that offset are matched, two at least. The likeness is the
share of the anchors of both that are matched at any of them, each counted once.
"""

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Words in a k-mer and in an inner s-mer, and bits of an anchor's position.
K, S, PLACE = 5, 2, 31
#: Offsets at which two fingerprints are matched: those with most votes, the smaller first.
OFFSETS = 8
#: Longer runs of non-spaces count as words of this many characters.
LONGEST = 24
#: Documents in a bucket of neighbours, and most buckets, whose bounds are held by every task.
BUCKET, BUCKETS = 8_192, 1 << 16
_MASK = (1 << 32) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(n: Column) -> Column:
    """0 to n - 1; nothing for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _mer_hashes(text: Column) -> Column:
    """Hashes of all S-mers of a text's words; of the whole text if it has fewer than K words."""
    found = F.regexp_extract_all(text, F.lit(f"([^\\x20\\x09-\\x0D]{{1,{LONGEST}}})"), F.lit(1))

    def mers(t: Column) -> Column:
        pairs = F.transform(_count(F.size(t) - S + 1), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(S)]))
        return F.when(F.size(t) >= K, pairs).when(F.size(t) > 0, F.array(F.xxhash64(t))).otherwise(F.array().cast("array<bigint>"))

    return _let(found, mers)


def _closed(s: Column) -> Column:
    """Positions of the closed syncmers, given the S-mer hashes."""
    inner = K - S + 1

    def closed(i: Column) -> Column:
        edge = [F.get(s, i), F.get(s, i + (inner - 1))]
        least = F.least(*[F.get(s, i + j) for j in range(inner)])
        return (least == edge[0]) | (least == edge[1])

    return F.filter(_count(F.size(s) - inner + 1), closed)


def _anchor(s: Column, i: Column) -> Column:
    """The hash of the k-mer at i: S-mers at even steps and the last one hold all its words."""
    steps = sorted({*range(0, K - S + 1, S), K - S})
    return F.xxhash64(*[F.get(s, i + j) for j in steps]).bitwiseAND(_MASK)


def anchors(text: Column) -> Column:
    """All anchors of a text in order, as longs of 32 bits of hash and PLACE bits of position,
    which counts words from 0. A text with words but no anchor has one at 0 with the hash of
    all its words; one without words, and null, has none."""

    def all_of(s: Column) -> Column:
        packed = lambda i: F.shiftleft(_anchor(s, i), PLACE).bitwiseOR(i.cast("long"))
        whole = F.array(F.shiftleft(F.xxhash64(s).bitwiseAND(_MASK), PLACE))
        return _let(F.transform(_closed(s), packed), lambda x: F.when((F.size(x) > 0) | (F.size(s) == 0), x).otherwise(whole))

    return _let(_mer_hashes(F.coalesce(text, F.lit(""))), all_of)


def _place(x: Column) -> Column:
    return x.bitwiseAND((1 << PLACE) - 1)


def as_text(found: Column) -> Column:
    """Anchors as 9 hexadecimal digits each: the hash, and the words since the anchor before
    or the beginning. Those are fewer than 16: of any K - S + 1 k-mers in a row one is kept."""

    def digits(a: Column) -> Column:
        gap = lambda x, i: _place(x) - F.when(i > 0, _place(F.get(a, i - 1))).otherwise(0)
        return F.transform(a, lambda x, i: F.lpad(F.hex(F.shiftleft(F.shiftrightunsigned(x, PLACE), 4).bitwiseOR(gap(x, i))), 9, "0"))

    return F.lower(F.array_join(_let(found, digits), ""))


def _votes(a: Column, b: Column) -> Column:
    """Sorted offsets from a to b, one for each hash of both: a and b hold one anchor a hash."""
    both = F.sort_array(F.concat(F.transform(a, lambda x: F.shiftleft(x, 1)), F.transform(b, lambda x: F.shiftleft(x, 1).bitwiseOR(1))))
    side = lambda x: x.bitwiseAND(1)
    place = lambda x: _place(F.shiftright(x, 1))

    def offset(v: Column) -> Callable[[Column, Column], Column]:
        def of(x: Column, i: Column) -> Column:
            y = F.get(v, i + 1)
            paired = (F.shiftright(x, PLACE + 1) == F.shiftright(y, PLACE + 1)) & (side(x) != side(y))
            return F.when(paired, (place(y) - place(x)) * (side(y) - side(x)))

        return of

    return _let(both, lambda v: F.filter(F.transform(v, offset(v)), lambda o: o.isNotNull()))


def _ends_of_runs(a: Column, step: int) -> Column:
    """Of each hash in sorted anchors, the first (step -1) or the last one (step 1)."""
    mer = lambda x: F.shiftright(x, PLACE)
    return F.filter(a, lambda x, i: F.when(i + step >= 0, mer(F.get(a, i + step))).eqNullSafe(mer(x)) == F.lit(False))


def _most_voted(votes: Column) -> Column:
    """The OFFSETS offsets that occur most often in sorted votes, of equals the smaller."""
    starts = lambda v: F.filter(_count(F.size(v)), lambda i: (i == 0) | (F.get(v, i) != F.when(i > 0, F.get(v, i - 1))))

    def counted(v: Column) -> Column:
        length = lambda s, i, k: F.coalesce(F.get(s, k + 1), F.size(v)) - i
        return _let(starts(v), lambda s: F.transform(s, lambda i, k: F.struct((-length(s, i, k)).alias("n"), F.get(v, i).alias("o"))))

    return F.transform(F.slice(F.sort_array(_let(votes, counted)), 1, OFFSETS), lambda x: x["o"])


def _moved(a: Column, offset: Column) -> Column:
    """Anchors with their positions changed by the offset, without those that leave the range."""
    inside = lambda x: (_place(x) + offset >= 0) & (_place(x) + offset < 1 << PLACE)
    return F.transform(F.filter(a, inside), lambda x: x + offset)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the anchors matched by position over those of both. 1 for two without anchors.
    A side with one anchor only may match it alone."""

    def match(x: Column, y: Column) -> Column:
        votes = F.sort_array(F.concat(*[_votes(_ends_of_runs(x, step), _ends_of_runs(y, step)) for step in (-1, 1)]))
        least = F.when(F.least(F.size(x), F.size(y)) == 1, 1).otherwise(2)
        found = F.transform(_most_voted(votes), lambda o: F.struct(o.alias("o"), F.array_intersect(_moved(x, o), y).alias("b")))

        def matched(f: Column) -> Column:
            theirs = F.size(F.array_distinct(F.flatten(F.transform(f, lambda m: m["b"]))))
            ours = F.size(F.array_distinct(F.flatten(F.transform(f, lambda m: F.transform(m["b"], lambda z: z - m["o"])))))
            return F.when(F.size(f) == 0, 0).when(F.size(f) == 1, F.size(F.get(f, F.lit(0))["b"])).otherwise(F.least(ours, theirs))

        return _let(F.filter(found, lambda m: F.size(m["b"]) >= least), matched)

    sorted_both = F.struct(F.sort_array(a).alias("a"), F.sort_array(b).alias("b"))
    share = lambda m: m / (F.size(a) + F.size(b) - m)
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(_let(_let(sorted_both, lambda s: match(s["a"], s["b"])), share))


def _bucket(key: Column, bounds: list, kind: str) -> Column:
    """How many of the sorted bounds are not beyond the key, by binary search. The bounds are
    one constant; key and bounds are structs of an id of type `kind` and a hash."""
    if not bounds:
        return F.lit(0)
    held = F.from_json(F.lit(json.dumps(bounds)), "array<struct<id:string,h:bigint>>").cast(f"array<struct<id:{kind},h:bigint>>")

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(held, middle) <= key
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(~done & below, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(~done & ~below, middle).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve, lambda s: s["lo"])


def with_next(df: DataFrame, per_bucket: int = BUCKET, most: int = BUCKETS) -> DataFrame:
    """df has columns id and text. Returns id, text, anchors, and next_text and next_anchors of
    the row that follows in ascending order of ids, the first after the last.

    Ids are of any type that can be ordered and written as text; null ids come first, and rows
    of one id follow one another by a hash of their texts. The order is cut into buckets of
    neighbours by the ids alone, a sample of which gives the bounds; then the texts move once,
    to their buckets, and the first row of each bucket goes to the bucket before it, too.
    """
    kind = df.schema["id"].dataType.simpleString()
    keyed = df.select("id", "text", F.xxhash64("text").alias("h"))
    key = F.struct("id", "h")
    slim = keyed.select("id", "h")
    n = min(most, max(1, -(-slim.count() // per_bucket)))
    ranged = slim.repartitionByRange(n, F.asc_nulls_first("id"), "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("k"))
    firsts = sorted((r.p, r.id, r.h) for r in ranged.select("p", F.col("k.id").cast("string").alias("id"), "k.h").collect()) if n > 1 else []  # most rows at most
    placed = keyed.withColumn("bucket", _bucket(key, [{"id": i, "h": h} for _, i, h in firsts[1:]], kind))
    edges = placed.groupBy("bucket").agg(F.min(key).alias("k")).select("bucket", F.struct("k.id", "k.h").alias("k")).orderBy("bucket").collect()  # most rows at most
    order = [r.bucket for r in edges]
    to = dict(zip(order, order[-1:] + order[:-1], strict=True))
    schema = f"bucket int, k struct<id:{kind},h:bigint>, to int"
    heads = F.broadcast(df.sparkSession.createDataFrame([(r.bucket, r.k, to[r.bucket]) for r in edges], schema).select(F.col("bucket").alias("own"), F.col("k.id").alias("first"), F.col("k.h").alias("first_h"), "to"))
    is_head = (F.col("bucket") == F.col("own")) & F.col("id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h"))
    one = placed.join(heads, is_head).groupBy("to").agg(F.min(F.struct("id", "h", "text")).alias("r"))
    extra = one.select("r.id", "r.text", "r.h", F.col("to").alias("bucket"), F.lit(0).alias("real"))
    every = placed.select("id", "text", "h", "bucket", F.lit(1).alias("real")).union(extra)
    along = [F.desc("real"), F.asc_nulls_first("id"), F.asc("h")]
    dealt = every.repartition("bucket").sortWithinPartitions("bucket", *along).withColumn("anchors", anchors(F.col("text")))
    window = W.partitionBy("bucket").orderBy(*along)
    led = dealt.select("id", "text", "anchors", "real", F.lead("text").over(window).alias("next_text"), F.lead("anchors").over(window).alias("next_anchors"))
    return led.where("real = 1").drop("real")


def syncmer_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: its id, n_chars, the SHA-256 of its edited text, the fingerprints of text
    and edited text, and the likeness of its own to that and to the next row's.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many
    (or all) of the next row's text, in ascending order of ids, the first after the last.
    Null texts are empty; a single row is its own next; an empty table gives none; other
    columns are not looked at. Null ids come first; rows of one id follow by a hash of the text.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut))
    made = with_next(docs).select("id", F.length("text").cast("long").alias("n_chars"), "anchors", "next_anchors", edited.alias("edited"))
    both = made.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "anchors", "next_anchors", anchors(F.col("edited")).alias("edited_anchors"))
    return both.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
