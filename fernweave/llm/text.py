"""Word boundaries and word hashes of whole texts, a block of an Arrow batch at a time.

Texts are handled as UTF-8 bytes: every delimiter used here is ASCII, so a byte
table finds the same words as the code-point patterns of the operators do.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once: arrays over bytes take a hundred times as much. LARGE is for
#: work on the distinct words of a block. One longer text makes a longer block.
BLOCK_BYTES, LARGE = 1 << 20, 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Words `[^\x20\x09-\x0D]+`.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


@dataclass
class Words:
    """The words of some rows. Row r has the words edges[r] up to edges[r + 1]."""

    buffer: np.ndarray  # lower-cased bytes of all texts, then 8 zero bytes
    starts: np.ndarray
    ends: np.ndarray
    edges: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        lanes = np.ndarray((max(len(self.buffer) - 7, 0),), dtype="<u8", buffer=self.buffer, strides=(1,))
        at, left = self.starts, self.ends - self.starts
        out = left.astype(np.uint64) * _C1
        todo = np.arange(len(at))
        while len(todo):
            n = np.minimum(left, 8)
            out[todo] = mix(out[todo] ^ (lanes[at] & _MASKS[n]))
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """Row ranges of about `most` bytes of text, with the texts; null is empty."""
    texts = pc.fill_null(batch.column(column), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield at, to, texts.slice(at, to - at)
        at, done = to, int(sizes[to - 1])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array and the len + 1 offsets into it."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind, count=len(texts) + 1, offset=texts.offset * kind().itemsize).astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def words(texts: pa.Array, table: np.ndarray, lower: bool = True) -> Words:
    """All words of the texts, A-Z lower-cased if `lower`, where `table` says which bytes belong to words."""
    data, off = raw(texts)
    buffer = np.zeros(len(data) + 8, dtype=np.uint8)
    buffer[:-8] = _LOWER[data] if lower else data
    inside = np.append(table[buffer[:-8]], False)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[1:] > off[:-1]
    edge, end = off[:-1][full], off[1:][full] - 1
    first[edge], last[end] = inside[edge], inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(buffer, starts, ends, np.searchsorted(starts, off))


def word_array(w: Words) -> pa.Array:
    """The words' bytes themselves, one after another."""
    sizes = w.ends - w.starts
    offsets = np.append(0, np.cumsum(sizes))
    data = w.buffer[np.repeat(w.starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def coded(arrays: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of the arrays, as text, and the number of each word in order."""
    chunks = pa.chunked_array(arrays, pa.large_binary()).dictionary_encode().unify_dictionaries().chunks
    dictionary = chunks[0].dictionary if chunks else pa.array([], pa.large_binary())
    numbers = [c.indices.to_numpy() for c in chunks]
    return dictionary.cast(pa.large_string()).cast(pa.string()), np.concatenate(numbers).astype(np.int64) if numbers else np.zeros(0, np.int64)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, however long: the buffer ends in 8 more bytes."""
    sizes = ends - starts
    lanes = np.ndarray((max(len(buffer) - 7, 0),), dtype="<u8", buffer=buffer, strides=(1,))
    n = (sizes + 7) // 8
    first = np.cumsum(n) - n
    k = np.arange(n.sum()) - np.repeat(first, n)
    held = lanes[np.repeat(starts, n) + 8 * k] & _MASKS[np.minimum(np.repeat(sizes, n) - 8 * k, 8)]
    mixed = mix(held + mix((k + 1).astype(np.uint64) * _C1))
    total = np.append(np.uint64(0), np.cumsum(mixed, dtype=np.uint64))
    return mix(total[first + n] - total[first] ^ sizes.astype(np.uint64) * _C2)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes, over row ends too: the caller masks those."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out * _C1 + hashes[i : i + len(out)])
    return out
