"""Token counts by a map-side two-tier lookup.

A first pass keeps a bounded tally of pre-tokens in each task; the most frequent of
all tasks, with their lengths in tokens, become a small broadcast table. The counting
pass splits each text into pre-tokens, adds up the lengths found in that table and
encodes the misses, which a cache of the worker keeps. No pre-token is shuffled but
for the bounded tallies.

A pre-token is a run of spaces with the non-spaces after it. No piece of the model may have
a space mark after another character (checked when it is loaded), so no merge crosses from
one pre-token into the next, and the lengths add up to the library's count of the whole text.
The model puts a mark before a text, which makes a text's first pre-token look like a later
one; only the bare mark differs: alone it is an empty text, of no token, later a final space.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from fernweave.llm.text import LARGE, blocks, raw

#: Entries of the broadcast table, of a task's tally when emitted, and of a tally or cache before it is cut.
TABLE, EMITTED, HELD = 65_536, 8_192, 400_000
#: Longer pre-tokens are always encoded on their own, so tables and caches stay small.
LONGEST = 64

_models: dict[str, sentencepiece.SentencePieceProcessor] = {}
_cache: dict[str, dict[bytes, int]] = {}


def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _models:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if joined := [p for p in map(model.id_to_piece, range(model.vocab_size())) if "▁" in p.lstrip("▁")]:
            raise ValueError(f"pieces of {path} go on after a space, lengths of pre-tokens do not add up: {joined[:3]}")
        _models[path] = model
    return _models[path]


def _lengths(path: str, pretokens: list[bytes]) -> list[int]:
    """The model puts a space mark before what it is given: the pre-token's own first space
    goes. A bare space is what a letter with a space after it has more than the letter."""
    model = _model(path)
    bare = len(model.encode("a ")) - len(model.encode("a"))
    return [bare if p == b" " else n for p, n in zip(pretokens, map(len, model.encode([p[1:].decode() for p in pretokens], num_threads=1)), strict=True)]


def pretokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pre-tokens of all texts, and where each text's begin. Every text has one at
    least; U+2581 is the model's own mark for a space and counts as one."""
    if pc.any(pc.match_substring(texts, "▁")).as_py():
        texts = pc.replace_substring(texts, "▁", " ")
    data, off = raw(pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
    space = data == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[off[:-1]] = True
    edges = np.append(np.flatnonzero(first), len(data)).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    return array.dictionary_encode(), np.searchsorted(edges, off[:-1])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()
    for batch in batches:
        for _, _, texts in blocks(batch, "text", LARGE):
            coded, _ = pretokens(texts)
            times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).tolist()
            for word, n in zip(coded.dictionary.to_pylist(), times, strict=True):
                if n > 1 and len(word) <= LONGEST:
                    seen[word] += n
            if len(seen) > HELD:
                seen = Counter(dict(seen.most_common(HELD // 2)))
    top = seen.most_common(EMITTED)
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["pretoken", "n"])


def frequent_lengths(df: DataFrame, model_path: str, text_col: str = "text", entries: int = TABLE) -> dict[bytes, int]:
    """Lengths in tokens of the corpus's frequent pre-tokens, at most `entries` of them."""
    rows = (
        df.select(F.col(text_col).alias("text"))
        .mapInArrow(_tally, "pretoken binary, n long")
        .groupBy("pretoken")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "pretoken")
        .limit(entries)
        .collect()
    )
    words = [bytes(r.pretoken) for r in rows]
    return dict(zip(words, _lengths(model_path, words), strict=True))


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, entries: int = TABLE) -> DataFrame:
    """Per row of df: its id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each;
    null ids stay null; other columns are not looked at. An empty table gives none.
    """
    known = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, model_path, text_col, entries))
    id_type = df.schema[id_col].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = known.value, _cache.setdefault(model_path, {})
        for batch in batches:
            totals = np.zeros(batch.num_rows, dtype=np.int64)
            for at, to, texts in blocks(batch, "text", LARGE):
                coded, begins = pretokens(texts)
                own = coded.dictionary.to_pylist()
                sizes = [table.get(x, -1) for x in own]
                sizes = [cache.get(x, -1) if n < 0 else n for x, n in zip(own, sizes, strict=True)]
                missed = [i for i, n in enumerate(sizes) if n < 0]
                if len(cache) > HELD:
                    cache.clear()
                for i, n in zip(missed, _lengths(model_path, [own[i] for i in missed]), strict=True):
                    sizes[i] = n
                    if len(own[i]) <= LONGEST:
                        cache[own[i]] = n
                summed = np.add.reduceat(np.array(sizes, dtype=np.int64)[coded.indices.to_numpy()], begins)
                totals[at:to] = np.where(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0, summed, 0)
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(batch.column("text")), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), n_bytes, pa.array(totals)], ["id", "n_bytes", "n_tokens"])

    return (
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(count, f"id {id_type.simpleString()}, n_bytes long, n_tokens long")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
