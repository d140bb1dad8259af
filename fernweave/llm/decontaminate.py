"""Benchmark decontamination by winnowed word grams.

Of each 6 consecutive hashes of 5-word grams the smallest is kept (the rightmost of equal
ones), in documents and in benchmark items alike, so any 10 words that both hold share a
kept hash. Kept hashes of a document are joined with those of the items; each hit is
extended to the windows of 10 words around it, which are looked up among the items' windows
and compared word by word. A repeated word costs one lookup a place, not one for each pair
of places. An item of fewer than 10 words is a single window and is looked up by all its words.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fernweave.llm.store import stored
from fernweave.llm.text import ALNUM, blocks, gram_hashes, mix, words

GRAM, WINDOW = 5, 6
#: Words of a window that counts: the shortest span that winnowing never misses.
SPAN = GRAM + WINDOW - 1
#: Most bytes of benchmark text in one broadcast index; a larger benchmark takes a pass a part.
INDEX_BYTES = 64 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def winnow(grams: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions of the kept grams, given the hashes of all GRAM-word grams. row: the row of
    each word; no gram or window crosses rows. Of equal smallest hashes the rightmost is kept."""
    n = len(row) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, where = grams[:n].copy(), np.zeros(n, dtype=np.int64)
    for i in range(1, WINDOW):
        other = grams[i : i + n]
        take = other <= least
        least[take], where[take] = other[take], i
    inside = np.flatnonzero(row[:n] == row[SPAN - 1 :])
    kept = np.zeros(len(grams), dtype=bool)
    kept[inside + where[inside]] = True
    return np.flatnonzero(kept)


def _windows(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the SPAN words from each position on: of its two halves' grams."""
    return mix(grams[at] * _ODD + grams[at + (SPAN - GRAM)])


@dataclass
class Windows:
    """Distinct windows of one length: sorted hashes, a place of each in the items' words,
    and the group of items that hold it."""

    size: int
    value: np.ndarray
    place: np.ndarray
    group: np.ndarray


@dataclass
class Index:
    """The items of a benchmark, or of a part of it. Windows that the same items hold share a group."""

    names: list[str | None]
    words: np.ndarray
    kept: np.ndarray  # distinct kept grams, sorted
    long: Windows
    short: list[Windows]
    groups: list[np.ndarray]  # items of each group


def _grouped(size: int, value: np.ndarray, place: np.ndarray, item: np.ndarray, groups: dict[bytes, int]) -> Windows:
    """Windows of all occurrences (value, place, item)."""
    order = np.lexsort((item, value))
    value, place, item = value[order], place[order], item[order]
    cut = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    own = [np.unique(x).tobytes() for x in np.split(item, cut[1:])] if len(value) else []
    return Windows(size, value[cut], place[cut], np.array([groups.setdefault(x, len(groups)) for x in own], dtype=np.int64))


def build_index(items: list[tuple[object, str | None]]) -> Index:
    """items: (item_id, text). Those without words have no window."""
    w = words(pa.array([t or "" for _, t in items], pa.string()), ALNUM)
    h, sizes = w.hashes(), np.diff(w.edges)
    row = np.repeat(np.arange(len(items)), sizes)
    grams = gram_hashes(h, GRAM)
    starts = np.flatnonzero(row[: max(len(h) - SPAN + 1, 0)] == row[SPAN - 1 :]) if len(h) >= SPAN else np.zeros(0, np.int64)
    groups: dict[bytes, int] = {}
    long = _grouped(SPAN, _windows(grams, starts), starts, row[starts], groups)
    short = []
    for m in sorted(set(sizes[(sizes > 0) & (sizes < SPAN)].tolist())):
        own = np.flatnonzero(sizes == m)
        short.append(_grouped(m, gram_hashes(h, m)[w.edges[own]], w.edges[own], own, groups))
    return Index([None if i is None else str(i) for i, _ in items], h, np.unique(grams[winnow(grams, row)]), long, short, [np.frombuffer(x, dtype=np.int64) for x in groups])


def _looked_up(index: Index, kind: Windows, h: np.ndarray, value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(start, end, group) of those starts whose words are one of the windows, word by word."""
    if not len(kind.value) or not len(start):
        return np.zeros((3, 0), np.int64)
    spot = np.minimum(np.searchsorted(kind.value, value), len(kind.value) - 1)
    hit = np.flatnonzero(kind.value[spot] == value)
    for i in range(kind.size):
        hit = hit[h[start[hit] + i] == index.words[kind.place[spot[hit]] + i]]
    return np.stack([start[hit], start[hit] + kind.size, kind.group[spot[hit]]])


def spans(index: Index, h: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, group) of every place of every window. h: word hashes; edges: where each
    document's begin. Linear in the words, whatever repeats."""
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    grams = gram_hashes(h, GRAM)
    at = winnow(grams, row)
    if len(index.kept) and len(at):
        spot = np.minimum(np.searchsorted(index.kept, grams[at]), len(index.kept) - 1)
        at = at[index.kept[spot] == grams[at]]
    else:
        at = at[:0]
    # A window of SPAN words around the hit begins at one of these places.
    near = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(near, np.maximum(at - (WINDOW - 1), edges[row[at]]), 1)
    np.add.at(near, at + 1, -1)
    start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    start = start[start + SPAN <= edges[1:][row[start]]]
    found = [_looked_up(index, index.long, h, _windows(grams, start), start)]
    for kind in index.short:
        own = gram_hashes(h, kind.size)
        start = np.flatnonzero(row[: len(own)] == row[kind.size - 1 :]) if len(own) else np.zeros(0, np.int64)
        found.append(_looked_up(index, kind, h, own[start], start))
    start, end, group = np.concatenate(found, axis=1).astype(np.int64)
    return start, end, group


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[Index]:
    """Indexes of the whole benchmark, each of about `most` bytes of text at most."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first().b
    parts = -(-total // most) or 1
    for k in range(parts):
        yield build_index([(r.i, r.t) for r in (items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)).collect()])


_HITS = "n_words long, spans array<struct<first:int,last:int>>, items array<string>"


def _scan(index: Index, found: tuple, w) -> tuple[list, list]:
    """Merged spans and item names of each document, None where it has none."""
    start, end, group = found
    docs = len(w.edges) - 1
    out_spans: list = [None] * docs
    out_items: list = [None] * docs
    if len(start):
        change = np.zeros(len(w.starts) + 1, dtype=np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
        hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        doc = np.searchsorted(w.edges, hit, "right") - 1
        cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(doc) > 0))
        for a, b in zip(np.append(0, cut + 1).tolist(), np.append(cut, len(hit) - 1).tolist(), strict=True):
            d = int(doc[a])
            out_spans[d] = (out_spans[d] or []) + [(int(hit[a] - w.edges[d]), int(hit[b] - w.edges[d]))]
        for d, g in np.unique(np.stack([np.searchsorted(w.edges, start, "right") - 1, group]), axis=1).T.tolist():
            out_items[d] = (out_items[d] or []) + [index.names[i] for i in index.groups[g].tolist()]
    return out_spans, out_items


def contaminated_spans(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Per row of df: its id, n_words, spans (merged word ranges first..last that lie inside
    occurrences of benchmark windows) and items (ids of the items with such windows, as
    sorted strings); both null where there are none.

    Null texts have no words and no windows; benchmark rows without an id mark their words
    but name no item; repeated rows on either side change nothing; empty tables are fine.
    A benchmark of more than `index_bytes` is indexed in parts, with a stored pass for each.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    merged = None
    for index in _indexes(benchmark, item_col, item_text_col, index_bytes):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kept = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            for batch in batches:
                n_words, own_spans, own_items = [], [], []
                for _, _, texts in blocks(batch, "text"):
                    w = words(texts, ALNUM)
                    s, i = _scan(shared.value, spans(shared.value, w.hashes(), w.edges), w)
                    n_words.append(np.diff(w.edges))
                    own_spans += [None if x is None else [{"first": a, "last": b} for a, b in x] for x in s]
                    own_items += [None if x is None else sorted({y for y in x if y is not None}) for x in i]
                counts = np.concatenate(n_words).astype(np.int64) if n_words else np.zeros(0, np.int64)
                arrays = [pa.array(counts), pa.array(own_spans, kept), pa.array(own_items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "n_words", "spans", "items"])

        if merged is None:
            merged = rows.mapInArrow(run, f"id {kind}, text string, {_HITS}")
        else:
            before = stored(merged, "hits")
            kept = before.select("id", F.struct("n_words", "spans", "items").alias("b"), "text").mapInArrow(run, f"id {kind}, b struct<{_HITS.replace(' long', ':bigint').replace(' array', ':array')}>, text string, {_HITS}")
            merged = kept.select("id", "text", "n_words", _union_spans(F.col("b.spans"), F.col("spans")).alias("spans"), _union_items(F.col("b.items"), F.col("items")).alias("items"))
    return merged.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def _union_items(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_sort(F.array_union(a, b)))


def _union_spans(a: Column, b: Column) -> Column:
    """Merged ranges of both lists."""
    both = F.array_sort(F.concat(a, b))
    none = F.array().cast("array<struct<first:int,last:int>>")
    joined = F.aggregate(
        both,
        none,
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["first"] <= F.element_at(done, -1)["last"] + 1),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(joined)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of df without any word inside a benchmark window; all columns stay as they are.
    A benchmark of several parts takes a stored pass for each, so a task holds one index."""
    for k, index in enumerate(_indexes(benchmark, item_col, item_text_col, index_bytes)):
        df = stored(df, "clean") if k else df
        shared = df.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for at, _, texts in blocks(batch, text_col):
                    w = words(texts, ALNUM)
                    start, _, _ = spans(shared.value, w.hashes(), w.edges)
                    clean[at + np.searchsorted(w.edges, start, "right") - 1] = False
                yield batch.filter(pa.array(clean))

        df = df.mapInArrow(run, T.StructType(df.schema.fields))
    return df
