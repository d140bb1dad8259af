"""Licence scans through a positional index of rare words.

A template is a licence text or notice with a label and key phrases. A pass over all documents
counts in how many of them each template word occurs; the inverse document frequencies rank
the words. The index holds for every template a posting for each key phrase, its word of the
highest IDF and that word's offset in the template, the rarest first. A scan looks up the places
of the rarest word in a file; the next postings' places are intersected with those by their
relative positions, give or take the template's slack, and a template ends as soon as nothing is
left. What is left is verified: all key phrases word for word at those positions, and the share
of the template's word pairs that stand there. Since a key phrase holds its posting's word, no
place is missed.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernweave.llm.license_texts import BASE, NOTICES, TEXTS
from fernweave.llm.text import ALNUM, blocks, words

#: A label needs this share of its template's pairs of neighbouring words, besides the key phrases.
COVER = 0.6
#: A key phrase may stand this share of the template's words away from its place after the first.
SLACK = 8


@dataclass
class Template:
    label: str
    words: list[str]
    phrases: list[list[str]]
    offsets: list[int] = field(init=False)  # of the phrases
    slack: int = field(init=False)

    def __post_init__(self) -> None:
        where = lambda p: next(i for i in range(len(self.words)) if self.words[i : i + len(p)] == p)
        self.offsets = [where(p) for p in self.phrases]
        self.slack = len(self.words) // SLACK


def split(text: str) -> list[str]:
    """Words as a scan sees them."""
    w = words(pa.array([text]), ALNUM)
    return [w.buffer[a:b].tobytes().decode() for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]


TEMPLATES = [Template(label, split(text), [split(p) for p in phrases]) for label, text, phrases in BASE + NOTICES + TEXTS]
VOCABULARY = sorted({w for t in TEMPLATES for w in t.words})
_CODE = {w: i for i, w in enumerate(VOCABULARY)}


@cache
def _word_codes() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the vocabulary, with each word's code."""
    h = words(pa.array([" ".join(VOCABULARY)]), ALNUM).hashes()
    order = np.argsort(h)
    return h[order], order


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code of each word (-1 if no template has it), and where each text's words begin."""
    w = words(texts, ALNUM)
    known, code = _word_codes()
    h = w.hashes()
    spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[spot] == h, code[spot], -1), w.edges


def document_frequencies(df: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """How many rows there are, and in how many of them each template word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, np.zeros(len(VOCABULARY), dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            for _, _, texts in blocks(batch, "text"):
                code, edges = coded(texts)
                at = np.flatnonzero(code >= 0)
                row = np.searchsorted(edges, at, "right") - 1
                held += np.bincount(np.unique(row * len(VOCABULARY) + code[at]) % len(VOCABULARY), minlength=len(VOCABULARY))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(VOCABULARY))], pa.int32()), pa.array([n, *held.tolist()], pa.int64())], ["word", "n"])

    sums = df.select(F.col(text_col).alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by = {r.word: r.n for r in sums}
    return by.pop(-1, 0), {VOCABULARY[k]: n for k, n in by.items()}


@dataclass
class Posting:
    """A key phrase's rarest word: its code, its offset in the template and in the phrase, the phrase."""

    word: int
    offset: int
    within: int
    phrase: int


def build_index(rows: int, held: dict[str, int]) -> list[list[Posting]]:
    """The postings of each template, highest IDF first; of equals the first."""
    idf = {w: np.log((rows + 1) / (held.get(w, 0) + 1)) for w in VOCABULARY}
    index = []
    for t in TEMPLATES:
        own = []
        for k, (phrase, at) in enumerate(zip(t.phrases, t.offsets, strict=True)):
            within = max(range(len(phrase)), key=lambda i: (idf[phrase[i]], -i))
            own.append((-idf[phrase[within]], Posting(_CODE[phrase[within]], at + within, within, k)))
        index.append([p for _, p in sorted(own, key=lambda x: x[0])])
    return index


def _near(sorted_: np.ndarray, keys: np.ndarray, slack: int) -> np.ndarray:
    """Which keys have a value of the sorted array within the slack."""
    spot = np.searchsorted(sorted_, keys - slack)
    return (spot < len(sorted_)) & (sorted_[np.minimum(spot, max(len(sorted_) - 1, 0))] <= keys + slack) if len(sorted_) else np.zeros(len(keys), dtype=bool)


def places(index: list[list[Posting]], code: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each template with any: rows, word positions in the row of its first key phrase, and
    the share of the template's pairs of neighbouring words that stand about there."""
    at = np.flatnonzero(code >= 0)
    own = code[at]
    order = np.argsort(own.astype(np.int16), kind="stable")
    cuts = np.searchsorted(own[order], np.arange(len(VOCABULARY) + 1))
    of = lambda w: at[order[cuts[w] : cuts[w + 1]]]  # noqa: E731  sorted places of a word
    for t, (template, postings) in enumerate(zip(TEMPLATES, index, strict=True)):
        starts = of(postings[0].word) - postings[0].offset
        for p in postings[1:]:
            if not len(starts):
                break
            starts = starts[_near(of(p.word) - p.offset, starts, 2 * template.slack)]
        if not len(starts):
            continue
        found = []
        for k, (phrase, offset) in enumerate(zip(template.phrases, template.offsets, strict=True)):
            p = next(p for p in postings if p.phrase == k)
            begin = of(p.word) - p.within
            begin = begin[_near(starts, begin - offset, 2 * template.slack)]
            row = np.searchsorted(edges, begin + p.within, "right") - 1
            begin = begin[(begin >= edges[row]) & (begin + len(phrase) <= edges[row + 1])]
            for i, w in enumerate(phrase):
                begin = begin[code[begin + i] == _CODE[w]]
            found.append(begin)
        first = found[0]
        row = np.searchsorted(edges, first, "right") - 1
        for begin, offset in zip(found[1:], template.offsets[1:], strict=True):
            # Only phrases of the same row: rows are moved apart by more than any slack.
            apart = len(code) + 1
            other = begin - offset + (np.searchsorted(edges, begin, "right") - 1) * apart
            ok = _near(other, first - template.offsets[0] + row * apart, template.slack)
            first, row = first[ok], row[ok]
        if len(first):
            yield t, row, first - edges[row], np.array([_cover(template, code, edges[r], edges[r + 1], p) for r, p in zip(row.tolist(), first.tolist(), strict=True)])


def _cover(t: Template, code: np.ndarray, begin: int, end: int, first: int) -> float:
    """The share of the template's distinct pairs of neighbouring words in its stretch of a row."""
    start = first - t.offsets[0]
    own = code[max(begin, start - t.slack) : min(end, start + len(t.words) + t.slack)].tolist()
    codes = [_CODE[w] for w in t.words]
    pairs = set(zip(codes, codes[1:], strict=False))
    return len(pairs & set(zip(own, own[1:], strict=False))) / len(pairs)


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """Per row of df: its id; n_words; n_base, first_word and last_word (count, smallest and
    largest start of all places of base phrases); base_labels; labels (base ones and those of
    templates with `cover` of their word pairs in place), both distinct, sorted and comma-joined;
    score, the best such share, 0 without a label; spans, the first key phrases' places by label.

    Null texts have no words. first_word and last_word are null without a place. Repeated
    rows repeat their results; an empty table has none; other columns are not looked at.
    """
    shared = df.sparkSession.sparkContext.broadcast(build_index(*document_frequencies(df, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        spans_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            n = batch.num_rows
            n_words, n_base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            starts: list[list[int]] = [[] for _ in range(n)]
            base: list[set[str]] = [set() for _ in range(n)]
            every: list[set[str]] = [set() for _ in range(n)]
            spans: list[list[dict]] = [[] for _ in range(n)]
            for at, to, texts in blocks(batch, "text"):
                code, edges = coded(texts)
                n_words[at:to] = np.diff(edges)
                for t, rows, first, share in places(index, code, edges):
                    label, size = TEMPLATES[t].label, len(TEMPLATES[t].phrases[0])
                    for r, p, s in zip((rows + at).tolist(), first.tolist(), share.tolist(), strict=True):
                        if t < len(BASE):
                            n_base[r] += 1
                            starts[r].append(p)
                            base[r].add(label)
                        if t < len(BASE) or s >= cover:
                            every[r].add(label)
                            score[r] = max(score[r], s)
                            spans[r].append({"label": label, "first": p, "last": p + size - 1})
            arrays = [
                batch.column("id"), pa.array(n_words), pa.array(n_base),
                pa.array([min(x) if x else None for x in starts], pa.int64()), pa.array([max(x) if x else None for x in starts], pa.int64()),
                pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in every]), pa.array(score), pa.array(spans, spans_type),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint>>"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
