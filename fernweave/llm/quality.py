"""Quality scores from Bradley-Terry pairwise ranking.

Features of the whole text (shares of character kinds, repeated words, word lengths) give
a linear score. Its weights maximise the likelihood of all preference pairs, a document of
label 1 over one of label 0: logistic loss on the difference of their features. The loss
depends on a pair by the difference of two scores, so sums over all pairs come from sums
over rows: scores are cut into cells, and in each the logistic curve is a polynomial
through NODES points (its error is below 1e-12). A step of Newton's method is one pass over
the labelled rows. The threshold is the quantile of all training scores at the share of
label 0; the reported score is a logistic curve that has the accepted value there.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fernweave.functions.quantiles import ranked_values
from fernweave.llm.store import stored
from fernweave.llm.text import NON_SPACE, blocks, raw, words

#: Labelled rows that are broadcast to the texts; of more, features are joined to them.
BROADCAST_ROWS = 200_000
#: Width of a cell of scores, and Chebyshev nodes in it.
CELL, NODES = 2.0, 16
_NODES = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
ACCEPT = 0.3
_KINDS = [list(range(0x41, 0x5B)), [ord("!")], [ord("|")], [ord(c) for c in "#$%&*"], list(range(0x30, 0x3A)), [ord(c) for c in "<>{}[]()=/\\_~^@+"], [0x0A], list(range(0x20)), list(range(0x80, 0x100))]
N_FEATURES = len(_KINDS) + 7


def features(texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each text; an empty text has zeros."""
    data, off = raw(texts)
    n, sizes = len(texts), np.diff(off)
    kind = np.zeros(256, dtype=np.int64)
    for k, members in enumerate(_KINDS):
        kind[members] = k + 1
    row = np.repeat(np.arange(n), sizes)
    held = np.bincount(row * (len(_KINDS) + 1) + kind[data], minlength=n * (len(_KINDS) + 1)).reshape(n, -1)
    shares = held[:, 1:] / np.maximum(sizes, 1)[:, None]
    w = words(texts, NON_SPACE)
    h, counts = w.hashes(), np.diff(w.edges)
    owner = np.repeat(np.arange(n), counts)
    of = lambda flags: np.bincount(owner[: len(flags)], weights=flags, minlength=n) / np.maximum(counts, 1)
    again = [of((h[:-d] == h[d:]) & (owner[:-d] == owner[d:])) if len(h) > d else np.zeros(n) for d in (1, 2, 3)]
    length = w.ends - w.starts
    last = w.buffer[w.ends - 1] if len(h) else np.zeros(0, np.uint8)
    odd = of((last < 0x30) | ((last > 0x39) & (last < 0x61)) | ((last > 0x7A) & (last < 0x80))) if len(h) else np.zeros(n)
    mean, long = (of(length), of(length > 25)) if len(h) else (np.zeros(n), np.zeros(n))
    return np.column_stack([np.sqrt(shares), *map(np.sqrt, again), np.sqrt(odd), np.log1p(mean), np.sqrt(long), np.log1p(counts)])


@dataclass
class Ranking:
    """A fitted score: weights on the features and the threshold on their sum."""

    weights: np.ndarray
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights - self.threshold + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _shares(s: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """A row for each score: the Lagrange polynomials of its cell's nodes there."""
    t = 2 * (s / CELL - cells) - 1
    return np.column_stack([np.prod([(t - other) / (node - other) for other in _NODES if other != node], axis=0) for node in _NODES])


def pair_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """For each (label, cell) of the scores z @ w: sums, a row a node, of 1, z and z z' by the
    rows' shares of the node. Sums of parts of the rows add up."""
    s = z @ w
    cells = np.floor(s / CELL).astype(np.int64)
    wide = np.column_stack([np.ones(len(z)), z, (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)])
    by = np.column_stack([y, cells])
    return {(int(k), int(c)): _shares(s[own], cells[own]).T @ wide[own] for k, c in np.unique(by, axis=0) for own in [(y == k) & (cells == c)]}


def _step(sums: dict[tuple[int, int], np.ndarray], w: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's step on the mean loss of all pairs of a row of label 1 and one of label 0."""
    d = len(w)

    def side(label: int):
        own = sorted(c for k, c in sums if k == label)
        held = np.concatenate([sums[label, c] for c in own])
        at = np.concatenate([(c + (_NODES + 1) / 2) * CELL for c in own])
        return at, held[:, 0], held[:, 1 : d + 1], held[:, d + 1 :].reshape(-1, d, d)

    (u, n1, x1, xx1), (v, n0, x0, xx0) = side(1), side(0)
    p = (1 - np.tanh((u[:, None] - v[None, :]) / 2)) / 2  # the chance given to the wrong order
    q = p * (1 - p)
    pairs = n1.sum() * n0.sum()
    slope = (p @ n0) @ x1 - (p.T @ n1) @ x0
    cross = x1.T @ q @ x0
    curve = np.tensordot(q @ n0, xx1, 1) + np.tensordot(q.T @ n1, xx0, 1) - cross - cross.T
    return np.linalg.solve(curve / pairs + ridge * np.eye(d), slope / pairs - ridge * w)


def _fitted(sums_at, spread: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights on features by Newton's method; sums_at(w) gives pair_sums of the features over
    spread. Rounded, as sums of parts differ in their last digits with the order of the parts."""
    w = np.zeros(len(spread))
    for _ in range(30):
        step = _step(sums_at(w), w, ridge)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return np.round(w, 9) / spread


def _even(y_bad: int, width: int) -> Ranking:
    """Without both labels every text scores the same, on the accepted side unless all are labelled 0."""
    return Ranking(np.zeros(width), 1.0 if y_bad else -1.0)


def _safe(spread: np.ndarray) -> np.ndarray:
    return np.where(spread < 1e-9, 1.0, np.round(spread, 12))


def fit_ranking(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> Ranking:
    """The ranking of rows that one process holds; learn_quality fits the same on a table."""
    bad = int((y == 0).sum())
    if not bad or bad == len(y):
        return _even(bad, x.shape[1])
    spread = _safe(x.std(axis=0))
    w = _fitted(lambda w: pair_sums(x / spread, y, w), spread, ridge)
    s = np.sort(x @ w)
    return Ranking(w, float((s[bad - 1] + s[bad]) / 2))


def held_out(id_column: Column, parts: int = 5) -> Column:
    return F.crc32(id_column.cast("string")) % parts == 0


def labelled_features(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(y, x) of every labelled row whose crc32(id) mod 5 is not 0, written. Rows without an id or a
    label teach nothing; repeated rows count again."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
        texts = texts.join(F.broadcast(own.select("id").distinct()), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([features(texts) for _, _, texts in blocks(batch, "text")] or [np.zeros((0, N_FEATURES))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "x"])

    kind = df.schema[id_col].dataType.simpleString()
    return stored(texts.mapInArrow(run, f"id {kind}, x array<double>").join(own, "id").select("y", "x"), "labelled")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("y").to_numpy(), batch.column("x").flatten().to_numpy().reshape(-1, N_FEATURES)


def table_sums(rows: DataFrame, spread: np.ndarray, w: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """pair_sums of a table (y, x): summed in tasks, then over tasks; as many rows as cells have sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            y, x = _arrays(batch)
            for key, sums in pair_sums(x / spread, y, w).items():
                held[key] = held[key] + sums if key in held else sums
        for (label, cell), sums in held.items():
            n = sums.size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, label, np.int32)), pa.array(np.full(n, cell, np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(sums.ravel())], ["y", "cell", "place", "v"])

    summed = rows.mapInArrow(run, "y int, cell long, place int, v double").groupBy("y", "cell", "place").agg(F.sum("v").alias("v")).toPandas()
    return {(int(y), int(c)): g.sort_values("place")["v"].to_numpy().reshape(NODES, -1) for (y, c), g in summed.groupby(["y", "cell"])}


def learn_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking:
    """Fit on all labelled rows (see labelled_features) and all their pairs."""
    rows = labelled_features(df, labels, id_col, text_col, label_col)
    spreads = [F.stddev_pop(F.col("x")[i]).alias(f"d{i}") for i in range(N_FEATURES)]
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("bad"), *spreads).first()
    if not total.bad or total.bad == total.n:
        return _even(total.bad, N_FEATURES)
    spread = _safe(np.array([total[f"d{i}"] for i in range(N_FEATURES)]))
    w = _fitted(lambda w: table_sums(rows, spread, w), spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_arrays(batch)[1] @ w)], ["s"])

    scores = rows.mapInArrow(run, "s double").withColumn("k", F.lit(0))
    at = ranked_values(scores, ["k"], "s", {"below": lambda n: F.lit(total.bad), "above": lambda n: F.lit(total.bad + 1)}).first()
    return Ranking(w, (at.below + at.above) / 2)


def quality_scores(df: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: its id, held_out, score in 0 to 1 and predicted (1 if score >= ACCEPT).
    Null texts score as empty ones; held_out is null where the id is; other columns are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.concatenate([ranking.scores(features(texts)) for _, _, texts in blocks(batch, "text")] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s)], ["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    scored = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def keep_quality(df: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """The rows of df that score ACCEPT or more, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.concatenate([ranking.scores(features(texts)) for _, _, texts in blocks(batch, text_col)] or [np.zeros(0)])
            yield batch.filter(pa.array(s >= ACCEPT))

    return df.mapInArrow(run, df.schema)
