"""Phrases of two to five words that stand together oftener than their parts would.

The texts are cut into shards of a million words. In a shard, each word has a bitmap
of its positions, compressed to the 64-bit lanes that have a bit set; a position without a
word stands between two pieces, so nothing reaches over a boundary. A phrase's bitmap holds
its last words' positions: shifted by one and ANDed with the next word's it is the longer
phrase's, and the bits set are its occurrences. Phrases are extended depth first, some of
them at once, over bounded stretches of positions, and their counts are summed over the shards.

What is extended is pruned by what is frequent in the whole corpus, words first, then pairs of
neighbours, then three in a row. Pairs and threes are counted by a code of 42 bits, packed in
buckets, four bytes each; phrases cross the shuffle packed in buckets too, a row for many. Bit maps of bounded size name the frequent ones, and some others with
them, whose phrases go when the counts are summed: nothing is joined back to the shards. And by
a map of co-occurrence: a phrase is only ANDed with words that follow its last two somewhere in
the stretch. A word is known by a 64-bit hash of its language and itself; its seed is chosen so
that no two frequent words share one.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from fernweave.llm.store import released, stored
from fernweave.llm.text import blocks, coded, mix, word_array, words

#: Words in a shard, positions of it that make a row of frequent words, at least, and that are
#: searched at once, lanes that one step looks up.
SHARD, PIECE, STRETCH, PROBES = 1 << 20, 1 << 18, 1 << 16, 1 << 17
#: A bitmap that holds one lane in so many is kept open too, its lanes looked up by number.
OPEN = 64
#: Bits of a map of frequent words or pairs for each of them, and at most: 32 MB, whatever their number.
BITS, MOST_BITS = 32, 1 << 28
#: Bytes of text that a task handles at once.
TEXT = 1 << 18
#: Buckets of codes and phrases, positions that are coded at once, codes of a task that are
#: packed at once, and phrases of a task that are counted before the shuffle, and after it.
BUCKETS, CODED, PACKED, COUNTED = 1 << 10, 1 << 17, 1 << 19, 1 << 20
#: Parts in which each language's best phrases are taken before the last ranking.
PARTS = 16

#: Which of the three words of arrays may stand in a row.
Three = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_INSIDE = ~_ENDS
_INSIDE[[0x20, 0x09]] = False


def _shard(held: list[tuple[pa.Array, np.ndarray, np.ndarray]], langs: list[str]) -> pa.RecordBatch:
    """One row: the shard's distinct (lang, word, n), and all words in order as numbers of
    those, -1 where a piece ends."""
    dictionary, numbers = coded([x for x, _, _ in held])
    lang, gap = (np.concatenate([h[i] for h in held]) for i in (1, 2))
    found, local, n = np.unique(lang.astype(np.int64) * max(len(dictionary), 1) + numbers, return_inverse=True, return_counts=True)
    place = np.arange(len(local)) + np.cumsum(gap, dtype=np.int64)
    ids = np.full(place[-1] + 1 if len(place) else 0, -1, dtype=np.int32)
    ids[place] = local
    of = pa.array(langs, pa.string()).take(pa.array(found // max(len(dictionary), 1)))
    vocabulary = pa.StructArray.from_arrays([of, dictionary.take(pa.array(found % max(len(dictionary), 1))), pa.array(n, pa.int64())], ["lang", "word", "n"])
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), vocabulary), pa.array([ids.tobytes()], pa.binary())], ["vocab", "ids"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, langs, total = [], {}, 0
    for batch in batches:
        for at, to, texts in blocks(batch, "text", TEXT):
            w = words(texts, _INSIDE)
            own = [langs.setdefault(x, len(langs)) for x in batch.column("lang").slice(at, to - at).to_pylist()]
            row = np.repeat(np.arange(len(own)), np.diff(w.edges))
            ends = np.append(0, np.cumsum(_ENDS[w.buffer[:-8]]))
            gap = np.ones(len(row), dtype=np.uint8)
            gap[1:] = (ends[w.starts[1:]] > ends[w.ends[:-1]]) | (row[1:] != row[:-1])
            if not held:
                gap[:1] = 0
            if len(row):
                held.append((word_array(w), np.array(own, dtype=np.int32)[row], gap))
                total += len(row)
            if total >= SHARD:
                yield _shard(held, list(langs))
                held, langs, total = [], {}, 0
                pa.default_memory_pool().release_unused()
    if held:
        yield _shard(held, list(langs))


def _frequent_ids(batches: Iterator[pa.RecordBatch], marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(hashes, ids) of shards to (gids, ids), a row for each PIECE or so of positions: only
    words with a marked hash, by their place in gids, and one -1 for whatever stands between
    them. Rows end at such a -1."""
    for batch in batches:
        for i in range(len(batch)):
            hashes = batch.column("hashes")[i].values.to_numpy()
            gids, local = np.unique(hashes, return_inverse=True)
            gids = gids[kept := _marked(gids, gids, marks)]
            to = np.append(np.where(kept, np.cumsum(kept) - 1, -1)[local], -1).astype(np.int32)
            ids = to[np.frombuffer(batch.column("ids")[i].as_buffer(), dtype=np.int32)]
            keep = ids >= 0
            keep[1:] |= ids[:-1] >= 0
            ids = ids[keep]
            for part in np.split(ids, _cuts(ids, PIECE)):
                used = np.zeros(len(gids) + 1, dtype=bool)
                used[part] = True
                used[-1] = False
                to = np.where(used, np.cumsum(used) - 1, -1).astype(np.int32)
                own = gids[used[:-1]]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own, pa.int64())), pa.array([to[part].tobytes()], pa.binary())], ["gids", "ids"])


def _cuts(ids: np.ndarray, least: int) -> list[int]:
    """Where ids are cut: behind a -1, `least` places or more after the cut before."""
    ends, cuts = np.flatnonzero(ids < 0) + 1, [0]
    while (k := int(np.searchsorted(ends, cuts[-1] + least))) < len(ends) and ends[k] < len(ids):
        cuts.append(int(ends[k]))
    return cuts[1:]


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the pairs."""
    return mix(mix(a.astype(np.uint64)) + b.astype(np.uint64))


def _code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs' codes: a bucket and 32 bits."""
    return (_joint(a, b) & np.uint64((BUCKETS << 32) - 1)).astype(np.int64)


def _marked(a: np.ndarray, b: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of the pairs have their bit in the map."""
    bit = _code(a, b) & (len(marks) * 64 - 1)
    return (marks[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)) == 1


def _beside(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of words that stand side by side in ids, words 0 to n - 1, and how often."""
    ids = ids.astype(np.int64)
    both = (ids[:-1] >= 0) & (ids[1:] >= 0)
    code, times = np.unique(ids[:-1][both] * n + ids[1:][both], return_counts=True)
    return code // max(n, 1), code % max(n, 1), times


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal codes once, in order, with the sum of their counts."""
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first, dtype=n.dtype) if len(first) else n


def _packed(found: Iterator[np.ndarray], least: int) -> Iterator[pa.RecordBatch]:
    """The codes of all occurrences, an array at a time, to rows (bucket, codes, counts): those
    of a bucket in order, 32 bits each. Counts stop at `least`, as more says no more."""

    def rows(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        first = np.searchsorted(code, np.arange(BUCKETS) << 32)
        bucket = np.flatnonzero(np.diff(first, append=len(code)))
        off = pa.py_buffer((np.append(first[bucket], len(code)) * 4).astype(np.int32))
        data = [x.astype(np.uint32) for x in (code & 0xFFFFFFFF, np.minimum(n, least))]
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *[pa.Array.from_buffers(pa.binary(), len(bucket), [None, off, pa.py_buffer(x)]) for x in data]], ["bucket", "codes", "counts"])

    codes, counts = [], []
    for every in found:
        code, n = np.unique(every, return_counts=True)
        codes.append(code)
        counts.append(n.astype(np.int32))
        if sum(map(len, codes)) > PACKED:
            code, n = _summed(codes, counts)
            codes, counts = [code], [n]
            if 2 * len(code) > PACKED:
                yield rows(code, n)
                codes, counts = [], []
    if codes:
        yield rows(*_summed(codes, counts))


def _often(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Over (bucket, codes, counts) sorted by bucket: the codes that occur `least` times or more."""

    def frequent(bucket: int, codes: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        code, n = _summed(codes, counts)
        return pa.RecordBatch.from_arrays([pa.array(code[n >= least].astype(np.int64) | bucket << 32)], ["code"])

    held: tuple | None = None
    for batch in batches:
        for bucket, codes, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "codes", "counts")), strict=True):
            if held is not None and held[0] != bucket:
                yield frequent(*held)
                held = None
            held = held or (bucket, [], [])
            held[1].append(np.frombuffer(codes, dtype=np.uint32))
            held[2].append(np.frombuffer(counts, dtype=np.int32))
    if held is not None:
        yield frequent(*held)


def _side_by_side(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(gids, ids) of shards to the n words of all places where so many stand in a row."""
    for batch in batches:
        for i in range(len(batch)):
            gids = batch.column("gids")[i].values.to_numpy()
            ids = np.frombuffer(batch.column("ids")[i].as_buffer(), dtype=np.int32)
            for k in range(0, len(ids) - n + 1, CODED):
                part = ids[k : k + CODED + n - 1]
                each = [part[j : len(part) - n + 1 + j] for j in range(n)]
                some = np.flatnonzero(np.min(each, axis=0) >= 0)
                yield tuple(gids[x[some]] for x in each)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """(gids, ids) of shards to the codes of all frequent words that stand side by side."""
    for a, b in _side_by_side(batches, 2):
        yield _code(a, b)


def _threes(batches: Iterator[pa.RecordBatch], marks: np.ndarray) -> Iterator[np.ndarray]:
    """(gids, ids) of shards to the codes of all three words in a row of two marked pairs."""
    for a, b, c in _side_by_side(batches, 3):
        some = _marked(a, b, marks) & _marked(b, c, marks)
        yield _code(_joint(a[some], b[some]), c[some])


@dataclass
class Bitmaps:
    """Of some phrases: phrase i has the lanes off[i] to off[i + 1], each a number of 64
    positions with a bit set in it and those bits."""

    off: np.ndarray
    lane: np.ndarray
    bits: np.ndarray

    @cached_property
    def keys(self) -> np.ndarray:
        """phrase << 32 | lane of all lanes, in order."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off)) << 32 | self.lane

    @cached_property
    def opened(self) -> tuple[np.ndarray, np.ndarray]:
        """Which row of a table each dense phrase has, -1 for the others; and that table of
        the bits of all lanes, which is at most OPEN times as large as what it holds."""
        sizes, lanes = np.diff(self.off), int(self.lane.max(initial=0)) + 1
        dense = np.flatnonzero(sizes * OPEN > lanes)
        row = np.full(len(sizes), -1, dtype=np.int64)
        row[dense] = np.arange(len(dense))
        table = np.zeros((len(dense), lanes), dtype=np.uint64)
        at, of = _spread(self.off, dense)
        table[of, self.lane[at]] = self.bits[at]
        return row, table

    def held(self, phrase: np.ndarray, lane: np.ndarray) -> np.ndarray:
        """The bits of the phrases' lanes, 0 where there is none."""
        out = np.zeros(len(lane), dtype=np.uint64)
        row, table = self.opened
        row = row[phrase]
        fits = lane < table.shape[1]
        some = (row >= 0) & fits
        out[some] = table[row[some], lane[some]]
        if len(rest := np.flatnonzero((row < 0) & fits)):
            want = phrase[rest] << 32 | lane[rest]
            spot = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            same = self.keys[spot] == want
            out[rest[same]] = self.bits[spot[same]]
        return out

    def counts(self) -> np.ndarray:
        """Bits set of each phrase; those of lane 0 belong to the stretch before."""
        total = np.append(0, np.cumsum(np.bitwise_count(self.bits).astype(np.int64) * (self.lane > 0)))
        return total[self.off[1:]] - total[self.off[:-1]]

    def shifted(self) -> "Bitmaps":
        """All positions one later: the top bit of a lane goes into the next lane."""
        top = (self.bits >> np.uint64(63)).astype(bool)
        key = np.concatenate([self.keys, self.keys[top] + 1])
        return _gathered(key, np.concatenate([self.bits << np.uint64(1), np.ones(int(top.sum()), np.uint64)]), len(self.off) - 1)


def _gathered(key: np.ndarray, bits: np.ndarray, n: int) -> Bitmaps:
    """Bitmaps of n phrases from bits by (phrase << 32 | lane); those of one key are joined."""
    order = np.argsort(key, kind="stable")
    key, bits = key[order], bits[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
    some = bits != 0
    key, bits = key[first][some], bits[some]
    return Bitmaps(np.searchsorted(key >> 32, np.arange(n + 1)), key & 0xFFFFFFFF, bits)


def word_bitmaps(ids: np.ndarray, n: int) -> Bitmaps:
    """Of the words 0 to n - 1: where they stand in ids, a whole lane of what is before them first."""
    at = np.flatnonzero(ids >= 0)
    return _gathered(ids[at].astype(np.int64) << 32 | at >> 6, np.uint64(1) << (at & 63).astype(np.uint64), n)


def _spread(off: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all lanes of the chosen phrases, and which choice each belongs to."""
    sizes = off[chosen + 1] - off[chosen]
    of = np.repeat(np.arange(len(chosen)), sizes)
    return np.arange(len(of)) + np.repeat(off[chosen] - (np.cumsum(sizes) - sizes), sizes), of


def anded(x: Bitmaps, i: np.ndarray, y: Bitmaps, j: np.ndarray) -> Bitmaps:
    """x's phrase i[k] AND y's phrase j[k], for every k: the lanes of the one that has fewer
    are looked up in the other."""
    fewer = (x.off[i + 1] - x.off[i]) <= (y.off[j + 1] - y.off[j])
    keys, found = [], []
    for side, (p, ip), (q, iq) in ((fewer, (x, i), (y, j)), (~fewer, (y, j), (x, i))):
        k = np.flatnonzero(side)
        at, of = _spread(p.off, ip[k])
        bits = p.bits[at] & q.held(iq[k][of], p.lane[at])
        some = np.flatnonzero(bits)
        keys.append(k[of[some]] << 32 | p.lane[at[some]])
        found.append(bits[some])
    return _gathered(np.concatenate(keys), np.concatenate(found), len(i))


@dataclass
class Follow:
    """A stretch's map of co-occurrence: the pairs of words that stand side by side in it, the
    pairs that word w begins, first[w] up to first[w + 1], and those that begin with the last
    word of pair i right after it somewhere, after[off[i]] up to after[off[i + 1]]."""

    a: np.ndarray
    b: np.ndarray
    first: np.ndarray
    off: np.ndarray
    after: np.ndarray


def co_occurring(ids: np.ndarray, n: int, allowed: np.ndarray, three: Three | None = None) -> Follow:
    """Of words 0 to n - 1 in ids and of the allowed pairs only, sorted codes n a + b; if given,
    `three` says which three words may stand in a row."""
    code = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * n + ids[1:], -1)
    present = np.intersect1d(code, allowed, assume_unique=False)
    at = np.minimum(np.searchsorted(present, code), max(len(present) - 1, 0))
    hit = present[at] == code if len(present) else np.zeros(len(code), bool)
    beside = np.unique(at[:-1][hit[:-1] & hit[1:]] * max(len(present), 1) + at[1:][hit[:-1] & hit[1:]])
    before, after = beside // max(len(present), 1), beside % max(len(present), 1)
    x, y = present // max(n, 1), present % max(n, 1)
    if three is not None:
        some = three(x[before], y[before], y[after])
        before, after = before[some], after[some]
    return Follow(x, y, np.searchsorted(x, np.arange(n + 1)), np.searchsorted(before, np.arange(len(present) + 1)), after)


def extended(phrases: np.ndarray, last: np.ndarray, maps: Bitmaps, single: Bitmaps, follow: Follow, most: int, probes: int = PROBES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, counts) of all that extend the given ones, to `most` words, depth first. last:
    the word of phrases of one word, or the pair that a longer phrase ends in."""
    moved = maps.shifted()
    if phrases.shape[1] == 1:
        pair, of = _spread(follow.first, last)
    else:
        at, of = _spread(follow.off, last)
        pair = follow.after[at]
    word = follow.b[pair]
    work = np.cumsum(np.minimum(moved.off[of + 1] - moved.off[of], single.off[word + 1] - single.off[word]))
    begin = 0
    while begin < len(of):
        end = max(begin + 1, int(np.searchsorted(work, (work[begin - 1] if begin else 0) + probes, side="right")))
        i, j = of[begin:end], word[begin:end]
        longer = anded(moved, i, single, j)
        some = np.flatnonzero(np.diff(longer.off))
        grown = np.column_stack([phrases[i[some]], j[some]])
        if len(some):
            yield grown, longer.counts()[some]
            if grown.shape[1] < most:
                kept = Bitmaps(np.append(longer.off[some], longer.off[-1]), longer.lane, longer.bits)
                yield from extended(grown, pair[begin:end][some], kept, single, follow, most, probes)
        begin = end


def shard_phrases(ids: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, stretch: int = STRETCH, probes: int = PROBES, three: Three | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All phrases of two to `most` words of ids whose neighbours are all among the pairs a, b,
    and, if given, whose threes in a row `three` allows: a row each with -1 after its words, and how often each occurs. A stretch begins with the
    lane before it, so phrases that reach over its begin are found, and counted once."""
    rows, counts = [np.zeros((0, most), dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
    padded = np.append(np.full(64, -1, dtype=np.int64), ids)
    for at in range(0, len(ids), stretch):
        word, local = np.unique(padded[at : at + stretch + 64], return_inverse=True)
        gaps = int(word[0] < 0)
        word, local = word[gaps:], local - gaps
        if not len(word):
            continue
        x, y = (np.minimum(np.searchsorted(word, v), len(word) - 1) for v in (a, b))
        own = three and (lambda *some, word=word: three(*(word[v] for v in some)))
        follow = co_occurring(local, len(word), np.unique((x * len(word) + y)[(word[x] == a) & (word[y] == b)]), own)
        single, each = word_bitmaps(local, len(word)), np.arange(len(word))
        for phrases, n in extended(each[:, None], each, single, single, follow, most, probes):
            row = np.full((len(phrases), most), -1, dtype=np.int32)
            row[:, : phrases.shape[1]] = word[phrases]
            rows.append(row[n > 0])
            counts.append(n[n > 0])
        if sum(map(len, rows)) > 4 * len(rows[0]) + probes:
            rows, counts = [[x] for x in _merged(rows, counts)]
    return _merged(rows, counts)


def _merged(rows: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows once, with the sum of their counts."""
    row, n = np.concatenate(rows), np.concatenate(counts)
    order = np.lexsort(row.T[::-1])
    row, n = row[order], n[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]).any(axis=1))) if len(row) else np.zeros(0, np.int64)
    return row[first], np.add.reduceat(n, first) if len(first) else n


def _mined(batches: Iterator[pa.RecordBatch], most: int, pairs: np.ndarray, threes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(gids, ids) of shards to (p, c): the task's phrases, of marked pairs and threes, and
    their counts, up to COUNTED of them at once. Those held are kept apart by length."""

    def out() -> Iterator[pa.RecordBatch]:
        for (m, rows), (_, n) in zip(held.items(), counts.items(), strict=True):
            offsets = pa.array(np.arange(len(rows[0]) + 1) * m, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(rows[0].ravel(), pa.int64())), pa.array(n[0], pa.int64())], ["p", "c"])
        held.clear()
        counts.clear()

    def merge() -> int:
        for m in held:
            row, n = _merged(held[m], counts[m])
            held[m], counts[m] = [row], [n]
        return sum(len(rows[0]) for rows in held.values())

    held: dict[int, list[np.ndarray]] = {}
    counts: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for i in range(len(batch)):
            gids = batch.column("gids")[i].values.to_numpy()
            ids = np.frombuffer(batch.column("ids")[i].as_buffer(), dtype=np.int32)
            if not len(gids):
                continue
            a, b, _ = _beside(ids, len(gids))
            some = _marked(gids[a], gids[b], pairs)
            row, n = shard_phrases(ids, a[some], b[some], most, three=lambda x, y, z, gids=gids: _marked(_joint(gids[x], gids[y]), gids[z], threes))
            size = (row >= 0).sum(axis=1)
            for m in np.unique(size).tolist():
                held.setdefault(m, []).append(gids[row[size == m, :m]])
                counts.setdefault(m, []).append(n[size == m])
            del row, n, size, a, b, some
            if sum(len(x) for rows in held.values() for x in rows) > COUNTED and 2 * merge() > COUNTED:
                yield from out()
    merge()
    yield from out()


def _dealt(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(p, c) to rows (bucket, words, counts): the phrases of a bucket, all of one length, which
    is the remainder of the bucket by most + 1."""
    for batch in batches:
        off, n = batch.column("p").offsets.to_numpy(), batch.column("c").to_numpy()
        every, size = batch.column("p").values.to_numpy(), np.diff(off)
        for m in np.unique(size).tolist():
            some = np.flatnonzero(size == m)
            words = every[off[some][:, None] + np.arange(m)]
            h = np.zeros(len(words), dtype=np.int64)
            for word in words.T:
                h = _joint(h, word)
            bucket = (h & np.uint64(BUCKETS - 1)).astype(np.int64) * (most + 1) + m
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
            columns = [pa.array(bucket[order[first]], pa.int32())]
            for data, width in ((words[order], 8 * m), (n[some][order].astype(np.int64), 8)):
                edges = pa.py_buffer((np.append(first, len(order)) * width).astype(np.int32))
                columns.append(pa.Array.from_buffers(pa.binary(), len(first), [None, edges, pa.py_buffer(np.ascontiguousarray(data))]))
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "words", "counts"])


def _counted(batches: Iterator[pa.RecordBatch], most: int, least: int) -> Iterator[pa.RecordBatch]:
    """Over the rows of _dealt() sorted by bucket: (p, f) of the phrases with f >= least."""

    def frequent(bucket: int, words: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        row, n = _merged(words, counts)
        row, n, m = row[n >= least], n[n >= least], bucket % (most + 1)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * m, pa.int32()), pa.array(row.ravel(), pa.int64())), pa.array(n, pa.int64())], ["p", "f"])

    held: tuple | None = None
    for batch in batches:
        for bucket, words, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "words", "counts")), strict=True):
            if held is not None and held[0] != bucket:
                yield frequent(*held)
                held = None
            held = held or (bucket, [], [])
            held[1].append(np.frombuffer(words, dtype=np.int64).reshape(-1, bucket % (most + 1)))
            held[2].append(np.frombuffer(counts, dtype=np.int64))
            if sum(map(len, held[2])) > 2 * len(held[2][0]) + COUNTED:
                held = (bucket, *([x] for x in _merged(*held[1:])))
    if held is not None:
        yield frequent(*held)


def _marks(df: DataFrame) -> np.ndarray:
    """A bit for each of the codes, or of the pairs (a, b), in a map with BITS for each, of MOST_BITS at most."""
    bits = min(MOST_BITS, max(64, 1 << (BITS * df.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, *other = (c.to_numpy() for c in batch.columns)
            bit = np.unique((_code(code, *other) if other else code) & (bits - 1))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array((np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    masks = df.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("mask")).toArrow()
    marks = np.zeros(bits >> 6, dtype=np.uint64)
    marks[masks.column("word").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    return marks


def _frequent_codes(packed: DataFrame, least: int, name: str) -> DataFrame:
    """(code) of those that occur `least` times or more in rows of _packed()."""
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return stored(dealt.mapInArrow(lambda batches: _often(batches, least), "code long"), name)


def phrase_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of a language's words and phrases that occur `least` times or more:
    (gid, lang, word, f), (p, f) for phrases of two to `most` words as arrays of gid, and
    (lang, n), all word occurrences of each language."""
    spark = df.sparkSession
    own = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    shards = stored(own.mapInArrow(_shards, "vocab array<struct<lang:string,word:string,n:bigint>>, ids binary"), "shards", large=True)
    vocab = shards.select(F.explode("vocab").alias("v")).select("v.lang", "v.word", "v.n")
    totals = stored(vocab.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    counted = stored(vocab.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "counted")
    seed = 0
    while not counted.groupBy(F.xxhash64(F.lit(seed), "lang", "word")).count().where("count > 1").isEmpty():
        seed += 1
    frequent = stored(counted.withColumn("gid", F.xxhash64(F.lit(seed), "lang", "word")), "words")
    known = spark.sparkContext.broadcast(_marks(frequent.select(F.col("gid").alias("a"), F.col("gid").alias("b"))))
    hashed = shards.select(F.transform("vocab", lambda v: F.xxhash64(F.lit(seed), v["lang"], v["word"])).alias("hashes"), "ids")
    slim = stored(hashed.mapInArrow(lambda batches: _frequent_ids(batches, known.value), "gids array<long>, ids binary"), "frequent", large=True)
    released(shards)
    released(counted)
    kind = "bucket int, codes binary, counts binary"
    pairs = _frequent_codes(slim.mapInArrow(lambda batches: _packed(_pairs(batches), least), kind), least, "pairs")
    twos = spark.sparkContext.broadcast(_marks(pairs))
    triples = _frequent_codes(slim.mapInArrow(lambda batches: _packed(_threes(batches, twos.value), least), kind), least, "threes")
    threes = spark.sparkContext.broadcast(_marks(triples))
    found = slim.mapInArrow(lambda batches: _dealt(_mined(batches, most, twos.value, threes.value), most), "bucket int, words binary, counts binary")
    dealt = found.repartition("bucket").sortWithinPartitions("bucket")
    phrases = stored(dealt.mapInArrow(lambda batches: _counted(batches, most, least), "p array<long>, f long"), "phrases")
    released(slim)
    released(pairs)
    released(triples)
    return frequent, phrases, totals


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, most: int = 5, top: int = 2000) -> DataFrame:
    """The `top` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, n the language's words; of the cuts of the phrase in two, with
    counts l and r, the one with the lowest floor(1000 a n / (l r)) counts, the first of such.
    A phrase inside a longer one that is as frequent goes. Null texts are empty, a null
    language is `und`; repeated rows count again; empty tables give no row; other columns
    are not looked at.
    """
    frequent, phrases, totals = phrase_counts(df, text_col, lang_col, least, most)
    m = F.size("p")
    inside = phrases.where(m > 2).select(F.explode(F.array(F.slice("p", F.lit(1), m - 1), F.slice("p", F.lit(2), m - 1))).alias("p"), F.col("f").alias("longer"))
    kept = phrases.join(inside.groupBy("p").agg(F.max("longer").alias("longer")), "p", "left").where("longer is null or longer < f").select("p", F.col("f").alias("a"))
    counts = phrases.union(frequent.select(F.array("gid"), "f"))
    spoken = frequent.join(totals, "lang").select(F.col("gid").alias("first"), "lang", "n")
    cut = kept.withColumn("first", F.col("p")[0]).join(spoken, "first").withColumn("k", F.explode(F.sequence(F.lit(1), m - 1)))
    cut = cut.select("p", "a", "lang", "n", "k", F.slice("p", F.lit(1), F.col("k")).alias("left"), F.slice("p", F.col("k") + 1, m - F.col("k")).alias("right"))
    cut = cut.join(counts.toDF("left", "l"), "left").join(counts.toDF("right", "r"), "right")
    exact = F.expr("cast((cast(1000 * a as decimal(20,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)")
    best = cut.withColumn("score", exact).groupBy("p", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = stored(best.select("p", "lang", "a", "n", "cut.score", "cut.l", "cut.r"), "scored")
    spelt = best.select("p", F.posexplode("p").alias("i", "gid")).join(frequent.select("gid", "word"), "gid").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = best.join(spelt, "p").withColumn("phrase", F.array_join(F.col("w.word"), " "))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = named.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
