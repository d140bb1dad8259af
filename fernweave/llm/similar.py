"""Documents whose sets of word shingles have a Jaccard likeness of at least a bound: all of them.

Two sets of n and m shingles that are that like share one among the first n - ceil(bound n) + 1
of the one and as many of the other, in any order that is the same for all; those that fewest
rows hold come first, by exact counts. Those prefixes are the postings. SimHash links of the
same shingles (simhash.simhash_links) are verified first, then the members of each posting
against one of them; of the postings, only pairs across the components that these make are left.
Postings of up to SHORT members give their pairs, if sizes and places allow. The members of a
longer one are compared in blocks of
that posting: each task gets the sets of two blocks and hands out verified links only, so no
pair is a row. Postings of the same members count once, and a pair is compared in the first
posting that it shares. Every link is verified by its sets; postings are neither cut nor sampled.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from fernweave.llm.components import connected_components
from fernweave.llm.simhash import reachable, simhash_links
from fernweave.llm.store import released, stored
from fernweave.llm.text import NON_SPACE, blocks, gram_hashes, words

#: Members of a posting up to which its pairs are rows, and of a block of a longer one's.
SHORT, BLOCK = 64, 256
#: Passes in which shingles are counted and pairs are verified.
PASSES = 4
#: Bytes of text, and rows, that a task handles at once.
TEXT, ROWS = 1 << 18, 256
#: Bits of the map of nodes that keeps sets from being shuffled which a join would drop.
MARKS = 1 << 24
#: Bits of the map of a pass's shared shingles, which keeps most others from being shuffled.
SIEVE = 1 << 26


def shingle_sets(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, node, fp, n, shingles): a row for each row of df. shingles are the distinct hashes,
    sorted; node is a hash of them, fp their SimHash with repeats. A shorter text is one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in blocks(batch, "text", TEXT):
                w = words(texts, NON_SPACE)
                hashes = w.hashes()
                grams = gram_hashes(hashes, shingle)
                sets, fps = [], []
                for a, b in zip(w.edges[:-1].tolist(), w.edges[1:].tolist(), strict=True):
                    own = grams[a : b - shingle + 1] if b - a >= shingle else gram_hashes(hashes[a:b], b - a) if b > a else grams[:0]
                    sets.append(np.unique(own))
                    bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                    fps.append(int.from_bytes(np.packbits(bits * 2 > len(own)).tobytes(), "big", signed=True))
                sizes = np.fromiter(map(len, sets), dtype=np.int32, count=len(sets))
                nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64).view(np.int64)
                every = pa.array(np.concatenate(sets).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), every)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), pa.array(nodes), pa.array(fps, pa.int64()), pa.array(sizes), lists], ["id", "node", "fp", "n", "shingles"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, node long, fp long, n int, shingles array<long>")


def _marks(keys: DataFrame, bits: int = MARKS) -> np.ndarray:
    """A map of so many bits with those of the keys (one long) set."""
    bit = keys.toDF("key").select(F.expr(f"key & {bits - 1}L").alias("bit"))
    masks = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("mask")).toArrow()
    marks = np.zeros(bits >> 6, dtype=np.uint64)
    marks[masks.column("word").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    return marks


def _in(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which keys may be among the marked ones, all that are."""
    bits = keys & (len(marks) * 64 - 1)
    return marks[bits >> 6] >> (bits & 63).astype(np.uint64) & np.uint64(1) == 1


def _marked(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of sets whose node may be in nodes, all that are among them."""
    shared = sets.sparkSession.sparkContext.broadcast(_marks(nodes))
    return sets.mapInArrow(lambda batches: (b.filter(pa.array(_in(b.column("node").to_numpy(), shared.value))) for b in batches), sets.schema)


def _holders(sets: DataFrame, shared: DataFrame, part: int) -> DataFrame:
    """(s, node, n): who holds the shingles of a part that are in `shared`, and some others."""
    known = sets.sparkSession.sparkContext.broadcast(_marks(shared.select("s"), SIEVE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            off, every = batch.column("shingles").offsets.to_numpy(), batch.column("shingles").flatten().to_numpy()
            at = np.flatnonzero(every % PASSES == part)
            at = at[_in(every[at] // PASSES, known.value)]
            of = np.searchsorted(off - off[0], at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(every[at]), *(batch.column(c).take(pa.array(of)) for c in ("node", "n"))], ["s", "node", "n"])

    return sets.select("node", "n", "shingles").mapInArrow(run, "s long, node long, n int")


def _postings(sets: DataFrame, bound: float) -> DataFrame:
    """Stored (s, node, n, place): the prefix of each distinct set, of the shingles that two rows have.

    All shingles are counted, a part of them at once. Those of one row alone come first in
    every prefix and are no postings; the fewer rows hold one of the others, the earlier it comes.
    """
    parts = []
    for i in range(PASSES):
        every = sets.select(F.explode("shingles").alias("s")).where(F.pmod("s", F.lit(PASSES)) == i)
        shared = stored(every.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"), "shared")
        held = _holders(sets, shared.select(F.expr(f"(s - {i}) div {PASSES}").alias("s")), i).distinct()  # copies once
        parts.append(stored(held.join(shared, "s"), "held"))
        released(shared)
    own = W.partitionBy("node")
    alone = F.col("n") - F.count("*").over(own)
    place = (alone + F.row_number().over(own.orderBy("c", "s")) - 1).cast("int")
    first = reduce(DataFrame.union, parts).select("s", "node", "n", place.alias("place"))
    postings = stored(first.where(F.col("place") < F.col("n") - F.ceil(F.lit(bound) * F.col("n") - 1e-9) + 1), "postings")
    for done in parts:
        released(done)
    return postings


def _verified(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, bound: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are as like as the bound says."""
    sizes = nodes.select("node", "n")
    sized = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "m"), "b")
    pairs = stored(sized.where(F.least("n", "m") >= F.lit(bound) * F.greatest("n", "m") - 1e-9).select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = stored(_marked(sets.select("row", "node", "shingles"), wanted).join(nodes.join(wanted, "node").select("row"), "row", "left_semi").drop("row"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = np.zeros(len(batch), dtype=bool)
            for i in range(len(batch)):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                if min(len(p), len(q)) >= bound * max(len(p), len(q)) - 1e-9:
                    same = len(np.intersect1d(p, q, assume_unique=True))
                    keep[i] = same >= bound * (len(p) + len(q) - same) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    parts = []
    for i in range(PASSES):  # a part of the pairs' sets is in shuffles at once
        mine = F.pmod(F.xxhash64("a"), F.lit(PASSES)) == i
        both = pairs.where(mine).join(held.toDF("a", "x").where(mine), "a").join(held.toDF("b", "y"), "b")
        parts.append(stored(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified"))
    released(pairs)
    released(held)
    return reduce(DataFrame.union, parts)


def _compared(s: int, rows: list[tuple], bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the like pairs of one unit of posting s join, fewer than it has
    rows: (side, node, root, own, shingles) of two blocks, or of one on side 0. Pairs of one
    root need no link, those whose sizes differ too much have none, and those that share an
    earlier posting of their own (sorted) are compared there."""
    side, nodes, roots = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
    sizes = np.array([len(r[4]) for r in rows], dtype=np.int64)
    _, ids = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
    off = np.append(0, np.cumsum(sizes))
    early = [r[3][: np.searchsorted(r[3], s)] for r in rows]
    _, first = np.unique(np.concatenate(early), return_inverse=True)
    edge = np.append(0, np.cumsum([len(x) for x in early]))
    mark, met = (np.zeros(len(x) + 1, dtype=np.int64) for x in (ids, first))
    found = []
    other = np.flatnonzero(side == side.max())
    for i in np.flatnonzero(side == 0).tolist():
        fits = (roots[other] != roots[i]) & (np.minimum(sizes[other], sizes[i]) >= bound * np.maximum(sizes[other], sizes[i]) - 1e-9) & (other > i)
        near = other[fits]
        if len(near) and edge[i + 1] > edge[i]:
            met[first[edge[i] : edge[i + 1]]] = 1
            before = np.append(0, np.cumsum(met[first]))
            met[first[edge[i] : edge[i + 1]]] = 0
            near = near[before[edge[near + 1]] == before[edge[near]]]
        if len(near):
            own = ids[off[i] : off[i + 1]]
            mark[own] = 1
            starts = np.cumsum(sizes[near]) - sizes[near]
            at = np.arange(sizes[near].sum()) + np.repeat(off[near] - starts, sizes[near])
            same = np.add.reduceat(mark[ids[at]], starts)
            mark[own] = 0
            near = near[same >= bound * (sizes[near] + sizes[i] - same) - 1e-9]
            found.append(np.stack([np.full(len(near), i), near]))
    a, b = np.concatenate(found, axis=1) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    least = reachable(a, b, len(rows))
    at = np.flatnonzero(least != np.arange(len(rows)))
    return nodes[least[at]], nodes[at]


def _block_links(batches: Iterator[pa.RecordBatch], bound: float) -> Iterator[pa.RecordBatch]:
    """batches: (unit, s, side, node, root, own, shingles) sorted by unit and side."""
    unit, posting, held = None, 0, []

    def out() -> pa.RecordBatch:
        a, b = _compared(posting, held, bound)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        own, shingles = batch.column("own"), batch.column("shingles")
        columns = (batch.column(c).to_pylist() for c in ("unit", "s", "side", "node", "root"))
        for i, (u, s, side, node, root) in enumerate(zip(*columns, strict=True)):
            if held and u != unit:
                yield out()
                held = []
            unit, posting = u, s
            held.append((side, node, root, own[i].values.to_numpy().copy(), shingles[i].values.to_numpy().copy()))
    if held:
        yield out()


def block_units(open_: DataFrame) -> DataFrame:
    """(unit, s, side, node, root): the members of each posting of open_ (s, node, root, k), dealt
    to pairs of blocks of that posting. Of postings of the same members one is taken."""
    members = [F.expr(f"bit_xor(xxhash64(node, {i}))").alias(f"x{i}") for i in range(2)]
    shapes = open_.groupBy("s").agg(F.max("k").alias("k"), *members)
    chosen = shapes.groupBy("k", "x0", "x1").agg(F.min("s").alias("s")).select("s")
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    placed = open_.join(chosen, "s", "left_semi").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return dealt.select(F.xxhash64("s", low, high).alias("unit"), "s", F.when(F.col("block") == low, 0).otherwise(1).alias("side"), "node", "root")


def _long_links(open_: DataFrame, sets: DataFrame, nodes: DataFrame, bound: float) -> DataFrame:
    """Stored links across components among the members of each posting of open_, in blocks."""
    units = stored(block_units(open_), "units")
    own = units.groupBy("node").agg(F.sort_array(F.collect_set("s")).alias("own"))  # at most a prefix of its set
    wanted = stored(nodes.select("node", "row").join(own, "node"), "members")
    held = _marked(sets.select("row", "node", "shingles"), wanted.select("node")).drop("node").join(wanted, "row").drop("row")
    dealt = units.join(held, "node").select("unit", "s", "side", "node", "root", "own", "shingles")
    run = lambda batches: _block_links(batches, bound)
    links = stored(dealt.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(run, "a long, b long"), "blocks")
    released(units)
    released(wanted)
    return links


def similar_links(sets: DataFrame, bound: float) -> DataFrame:
    """sets: as of shingle_sets(), with a number for each row. Links (a, b) of nodes: what they join is what all pairs of
    sets of at least that Jaccard likeness join. Equal sets are one node."""
    nodes = stored(sets.groupBy("node").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("row").alias("row"), F.count("*").alias("copies")), "nodes")
    first = stored(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("hub")), "first")
    bits = simhash_links(first).join(first.toDF("a", "p"), "a").join(first.toDF("b", "q"), "b").toDF("u", "v", "a", "b").select("a", "b")
    links = _verified(nodes.join(first, "fp").select(F.col("node").alias("a"), F.col("hub").alias("b")).union(bits), sets, nodes, bound)
    postings = _postings(sets, bound)
    open_ = _open(postings, links)
    hubs = open_.groupBy("s").agg(F.min_by(F.struct("node", "n", "place", "root"), F.xxhash64("node")).alias("hub"))
    hubs = hubs.select("s", *[F.col(f"hub.{c}").alias(f"{c}2") for c in ("node", "n", "place", "root")])
    links = stored(links.union(_verified(_likely(open_, hubs, bound, False), sets, nodes, bound)), "hubs")
    released(open_)
    open_ = _open(postings, links)
    released(postings)
    short = open_.where(F.col("k") <= SHORT)
    other = short.select(*[F.col(c).alias(f"{c}2" if c != "s" else c) for c in short.columns])
    links = links.union(_verified(_likely(short, other, bound, True), sets, nodes, bound))
    long = open_.where(F.col("k") > SHORT)
    if not long.isEmpty():
        links = links.union(_long_links(long, sets, nodes, bound))
    for done in (open_, first, nodes):
        released(done)
    return links


def _open(postings: DataFrame, links: DataFrame) -> DataFrame:
    """The postings with members of several components, with each member's component as root
    and their number k."""
    roots = connected_components(links, "likes")
    own = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = own.groupBy("s").agg(F.count("*").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("s", "k")
    return stored(own.join(mixed, "s"), "open")


def _likely(postings: DataFrame, other: DataFrame, bound: float, each: bool) -> DataFrame:
    """Pairs of postings across components that sizes and places allow: at the first shingle
    that both have, what follows it in the order must be enough for the bound. each: other
    has the same rows, and a pair is wanted once."""
    least = F.ceil(F.lit(bound / (1 + bound)) * (F.col("n") + F.col("n2")) - 1e-9)
    rest = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    sized = F.least("n", "n2") >= F.lit(bound) * F.greatest("n", "n2") - 1e-9
    allowed = (F.col("root") != F.col("root2")) & sized & (rest >= least) & (F.col("node") < F.col("node2") if each else F.lit(True))
    return postings.join(other, (postings.s == other.s) & allowed).select(F.col("node").alias("a"), F.col("node2").alias("b"))


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bound: float = 0.8) -> DataFrame:
    """Per row of df: its id and component_id, the smallest id whose text its own can reach over
    links of a Jaccard likeness of at least `bound`. Texts without words are alike. Null ids
    take part but never name a component unless all of it are null."""
    sets = stored(shingle_sets(df, id_col, text_col, shingle).withColumn("row", F.monotonically_increasing_id()), "sets")
    roots = connected_components(similar_links(sets, bound), "similar")
    rows = stored(sets.select("id", "node").join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root")), "rooted")
    released(sets)
    names = rows.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(names, "root").select(F.col("id").alias(id_col), "component_id")
