"""SimHash near-duplicates by a positional byte index with count filtering.

A 64-bit fingerprint has 8 bytes. Two fingerprints that differ in at most 3 bits differ
in at most 3 bytes, so they share at least 8 - 3 = 5 of their positional bytes. Any pair
that shares 5 of all 8 shares 4 of the first 7: the index has one term for each four of
the first seven positions (35 terms of 32 bits a fingerprint). Four bytes of the guaranteed
five are thus in the term already; within a posting the shared positional bytes of each pair
are tallied, pairs with fewer than 5 go, and the rest is verified bit by bit. A posting of
more than COMPARED fingerprints is split by one more byte position: a pair with the fifth
shared byte there meets in that part, and the parts are dealt out anew, so none can hold
more than 2^24 fingerprints. Postings are of distinct fingerprints, so copies cost nothing.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fernweave.llm.components import connected_components
from fernweave.llm.store import stored
from fernweave.llm.text import blocks

#: Differing bits that still link; with it the least count of shared bytes, and the terms.
MOST_BITS = 3
LEAST_SHARED = 8 - MOST_BITS
TERMS = tuple(combinations(range(7), LEAST_SHARED - 1))
#: Postings up to this length tally all their pairs; longer ones are split by one more byte. A part
#: has the guaranteed count of shared bytes; a long one is verified by lookups of all flips of its
#: free bits instead of pair by pair.
COMPARED = 4096
#: Most long postings, and most rows to go or repeated, whose keys are broadcast.
LONG_KEYS, BROADCAST_ROWS = 100_000, 2_000_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the text's word shingles (see simhash_fingerprints)."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    stops = np.cumsum(sizes)
    starts, ends = stops - sizes, stops - 1
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    h = b"".join([digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(h, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(starts)).tobytes(), "big", signed=True)


def simhash_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): a row for each row of df. fp is a signed long of 64 bits.

    A-Z are lower-cased, words are runs of non-spaces, shingles are `shingle` words joined
    by a space, repeats included; a shorter text is one shingle, a null or empty one has
    fp 0. A bit is set if it is set in over half the XXH64 hashes (seed 42).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x or b"", shingle) for _, _, texts in blocks(batch, "text") for x in texts.cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For links between positions below n: the smallest position that each can reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _close(x: np.ndarray) -> np.ndarray:
    """Which differences share LEAST_SHARED positional bytes and differ in at most MOST_BITS bits."""
    shared = sum(((x >> np.uint64(8 * i)) & np.uint64(0xFF)) == 0 for i in range(8))
    return (shared >= LEAST_SHARED) & (np.bitwise_count(x) <= MOST_BITS)


def _flips(free: int) -> Iterator[int]:
    """All masks of 1 to MOST_BITS of the free bits."""
    spots = [1 << i for i in range(64) if free >> i & 1]
    for n in range(1, MOST_BITS + 1):
        for some in combinations(spots, n):
            yield sum(some)


def linked_in_postings(key: np.ndarray, fp: np.ndarray, split: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, within each run of one key, what the close pairs of the run join.

    key is sorted; fp has distinct fingerprints within a run; with split, those of a run
    share LEAST_SHARED bytes. A run's links are a forest: each position that reaches a
    smaller one is linked to the smallest it reaches.
    """
    n = len(key)
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, n))
    flipped = (sizes > COMPARED) & split
    at = np.flatnonzero(np.repeat(~flipped, sizes))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    left = (np.repeat(heads + sizes, sizes) - np.arange(n))[at] if n else at  # positions from here to the run's end
    d = 1
    while len(at := at[left > d]):
        left = left[left > d]
        near = at[_close(fp[at] ^ fp[at + d])]
        found.append((near, near + d))
        d += 1
    for head, size in zip(heads[flipped].tolist(), sizes[flipped].tolist(), strict=True):
        own = fp[head : head + size]
        order = np.argsort(own)
        ranked = own[order]
        for mask in _flips(int(np.bitwise_or.reduce(own ^ own[0]))):  # bits that differ in the run
            other = own ^ np.uint64(mask)
            spot = np.minimum(np.searchsorted(ranked, other), size - 1)
            hit = np.flatnonzero((ranked[spot] == other) & (own < other))
            if len(hit):
                found.append((head + hit, head + order[spot[hit]]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    root = reachable(a, b, n)
    node = np.flatnonzero(root != np.arange(n))
    return fp[node], fp[root[node]]


def _links(split: bool):
    """For mapInArrow over (key, fp) sorted by key; a run may go on in the next batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            k, f = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64),) * 2
            a, b = linked_in_postings(k, f, split)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            key, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "fp"))
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if whole:  # all runs but the last end here
                held.append((key[:whole], fp[:whole]))
                yield out()
                held = []
            held.append((key[whole:], fp[whole:]))
        yield out()

    return run


def simhash_links(fps: DataFrame) -> DataFrame:
    """fps: column fp. Links (a, b) between fingerprints such that what they join is what
    all pairs at MOST_BITS or fewer differing bits join. Nulls are left out."""
    byte = [F.shiftrightunsigned("fp", 56 - 8 * i).bitwiseAND(255) for i in range(8)]
    terms = []
    for t, spots in enumerate(TERMS):
        key = F.lit(t).cast("long")
        for i in spots:
            key = F.shiftleft(key, 8).bitwiseOR(byte[i])
        terms.append(key)
    postings = fps.select("fp").where("fp is not null").distinct().select("fp", F.explode(F.array(*terms)).alias("key"))
    long = stored(postings.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > COMPARED).select("key"), "long")
    n_long = long.count()
    linked = lambda p, split: p.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_links(split), "a long, b long")
    if not n_long:
        return linked(postings, False).distinct()
    keys = F.broadcast(long) if n_long <= LONG_KEYS else long
    # A fifth byte at each position that the term leaves free: its number and value follow the term.
    free = F.array(*[F.array(*[F.lit(i) for i in range(8) if i not in spots]) for spots in TERMS])
    bytes_ = F.array(*byte)
    term = F.shiftright("key", 32).cast("int")
    parts = postings.join(keys, "key", "left_semi").select("fp", "key", F.explode(F.get(free, term)).alias("spot"))
    parts = parts.select("fp", F.shiftleft("key", 11).bitwiseOR(F.col("spot") * 256).bitwiseOR(F.get(bytes_, F.col("spot"))).alias("key"))
    return linked(postings.join(keys, "key", "left_anti"), False).union(linked(parts, True)).distinct()


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Per row of df: its id, fingerprint (16 hex digits) and component_id, the smallest id
    whose fingerprint its own can reach over links of MOST_BITS or fewer bits.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows come
    out repeated; null ids take part but never name a component unless all of it are null.
    An empty table gives none; other columns are not looked at.
    """
    docs = stored(simhash_fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = stored(docs.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = connected_components(simhash_links(nodes), "links").withColumnRenamed("node", "fp")
    joined = stored(nodes.join(roots, "fp"), "joined")
    least = joined.groupBy("root").agg(F.min("least").alias("reached"))
    named = nodes.join(joined.select("fp", "root").join(least, "root").select("fp", "reached"), "fp", "left")
    names = named.select("fp", F.coalesce("reached", "least").alias("component_id"))
    return docs.join(names, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of df for each component: of simhash_components, or with a similarity of texts
    whose shingles are at least so like (Jaccard), all of which are found
    (similar.similar_components). The row with the smallest id stays; of rows with equal ids
    and different texts in one component, that with the smallest hash of its text.

    Of rows with one id and one text one stays, the one with the smallest hash of all its
    columns. Rows without an id cannot be named and stay. Texts are only moved where rows
    repeat, or where more than BROADCAST_ROWS rows go.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    named = df.select(F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), text_hash.alias("h"))).alias("key"), F.col(text_col).alias("text"))
    if similarity is None:
        parts = simhash_components(named, "key", "text", shingle)
    else:
        from fernweave.llm.similar import similar_components  # it needs simhash_links

        parts = similar_components(named, "key", "text", shingle, similarity)
    keys = stored(parts.where("key is not null").groupBy("key").agg(F.min("component_id").alias("c"), F.count("*").alias("n")), "parts")
    hashed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), text_hash.alias("h"))

    def bounded(some: DataFrame) -> tuple[int, DataFrame]:
        own = some.select("key.id", "key.h")
        n = own.count()
        return n, F.broadcast(own) if n <= BROADCAST_ROWS else own

    _, gone = bounded(keys.where("c <> key"))
    kept = hashed.join(gone, ["id", "h"], "left_anti")
    n_repeated, repeated = bounded(keys.where("c = key and n > 1"))
    if n_repeated:
        one = kept.join(repeated, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.min_by("row", F.xxhash64("row.*")).alias("row"))
        kept = kept.join(repeated, ["id", "h"], "left_anti").select("row").union(one.select("row"))
    return kept.select("row.*")
