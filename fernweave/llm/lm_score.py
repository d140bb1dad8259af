"""Language-model scores of whole texts: a word-count base score and a causal self-attention
model on subword ids.

All training texts give the word counts, a distributed aggregation, and from those come the
subwords' counts, which sort them into classes (see attention). The attention model is trained
in the tasks on all windows of all training texts: each subword of the training texts is a
target once. Rounds take growing, disjoint parts of the texts, and after each the weights of
the tasks are averaged, every row by how often a task has met it. A scoring pass then takes
every whole text once. Counts of the most frequent words are broadcast (a table of fixed
size); the remaining words of a text are joined with the count table, which grows with the
corpus and is never broadcast.
"""

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from fernweave.llm import attention
from fernweave.llm.store import stored
from fernweave.llm.text import LARGE, NON_SPACE, blocks, words

#: Words whose counts are broadcast, and words a worker keeps the subwords of.
FREQUENT, CACHED = 1 << 17, 300_000
#: Texts fall into PARTS parts by a hash; round r trains on the parts from ROUNDS[r] up to the next.
PARTS, ROUNDS = 8, (0, 1, 4, 8)
#: Windows in a step of each round, the last for any after: short steps move fast at first, long ones cost less a window.
STEPS = (256, 1024, 1024)
#: Step size, and bytes of text for which a task more is worth it.
RATE, TRAINER = 0.2, 4 << 20
#: Rows of weights that are averaged together.
CHUNK = 1024
#: The token after the last word of a text, as a key that no word can be.
END = b"\n"
#: Bytes of text tallied at once.
TALLIED = 16 << 20
_models: dict[str, sentencepiece.SentencePieceProcessor] = {}
_pieces: dict[str, dict[bytes, list[int]]] = {}


def held_out(id_column: Column, parts: int = 10) -> Column:
    return F.crc32(id_column.cast("string")) % parts == 0


def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _models:
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def encoded(path: str, some: list[bytes]) -> list[list[int]]:
    """Subword ids of each word; a word's do not depend on its neighbours."""
    return _model(path).encode([w.decode("utf-8", "replace") for w in some], num_threads=1)


def subwords(path: str, some: list[bytes]) -> list[list[int]]:
    """As encoded(), with a cache of the worker for words met before."""
    cache = _pieces.setdefault(path, {})
    if len(cache) > CACHED:
        cache.clear()
    new = [w for w in some if w not in cache]
    ids = dict(zip(new, encoded(path, new), strict=True))
    cache.update((w, x) for w, x in ids.items() if len(w) <= 64)
    return [ids[w] if w in ids else cache[w] for w in some]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All items in one array, and the lists' lengths."""
    lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(lengths.sum())), lengths


def dictionary(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, which of them each word is, and where each text's words begin."""
    w = words(texts, NON_SPACE)
    sizes = (w.ends - w.starts).astype(np.int64)
    off, data = np.append(0, np.cumsum(sizes)), w.buffer[:-8]
    array = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(data[NON_SPACE[data]])])
    coded = array.dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), w.edges


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, c): how often each token occurs in the texts, ends of texts included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in blocks(batch, "text", TALLIED):
                own, which, _ = dictionary(texts)
                c = np.bincount(which, minlength=len(own))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([own, pa.array([END], pa.binary())]), pa.array(np.append(c, to - at))], ["word", "c"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_counts(counts: DataFrame, most: int) -> pa.Table:
    """The rows from some c on, at most `most` of them. That c comes from a histogram
    of the counts' magnitudes, so neither a task nor the driver sorts the keys."""
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()  # 16 rows for each doubling
    least, held = None, 0
    for r in sorted(sizes, key=lambda r: -r.step):
        held += r.n
        if held > most:
            break
        least = r.step
    return (counts.where(step >= least) if least is not None else counts.limit(0)).toArrow()


def subword_counts(counts: DataFrame, path: str) -> np.ndarray:
    """Counts of all subword ids in the texts of these word counts, the end as the last one.
    Their number is bounded by the tokenizer's ids, not by the corpus."""
    width = _model(path).vocab_size() + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            own, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            ids, lengths = flat([[width - 1] if w == END else x for w, x in zip(own, encoded(path, own), strict=True)])
            np.add.at(total, ids, np.repeat(c, lengths))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    sums = counts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width, dtype=np.int64)
    out[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return out


def sequences(path: str, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of the texts; each text's words by their number there, the end as the
    last number, with the texts' edges; and the texts' subword ids with the edges of those."""
    distinct, which, edges = dictionary(texts)
    own = distinct.to_pylist()
    ids, lengths = flat([*subwords(path, own), [_model(path).vocab_size()]])
    begin = np.cumsum(lengths) - lengths
    line = np.insert(which, edges[1:], len(own))
    heads = edges + np.arange(len(edges))
    sizes = lengths[line]
    off = np.append(0, np.cumsum(sizes))
    at = np.arange(off[-1]) + np.repeat(begin[line] - off[:-1], sizes)
    return distinct, line, heads, ids[at], off[heads]


def _packed(tables: list[np.ndarray], met: list[np.ndarray]) -> Iterator[tuple[int, bytes, bytes]]:
    """Chunks of the rows of all tables, one after the other: number, how often each row was
    met, rows. Chunks that were not met are left out."""
    k = 0
    for table, n in zip(tables, met, strict=True):
        for at in range(0, len(table), CHUNK):
            if n[at : at + CHUNK].any():
                yield k, n[at : at + CHUNK].astype(np.float32).tobytes(), table[at : at + CHUNK].astype(np.float32).tobytes()
            k += 1


def _averages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (k, n, rows) sorted by k: for each k the rows' means, weighted by n, and the sums of n."""
    held: tuple | None = None
    for batch in batches:
        for k, n, rows in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "rows")), strict=True):
            n, rows = np.frombuffer(n, dtype=np.float32).astype(np.float64), np.frombuffer(rows, dtype=np.float32)
            part = rows.reshape(len(n), -1) * n[:, None]
            if held is not None and held[0] != k:
                yield _mean(*held)
                held = None
            held = (k, n, part) if held is None else (k, held[1] + n, held[2] + part)
    if held is not None:
        yield _mean(*held)


def _mean(k: int, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    rows = (total / np.maximum(n, 1)[:, None]).astype(np.float32)
    arrays = [pa.array([k], pa.int32()), pa.array([n.astype(np.float32).tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["k", "n", "rows"])


def train_round(texts: DataFrame, path: str, layout: attention.Layout, start: attention.Weights, step: int) -> attention.Weights:
    """Each task trains from `start` on all windows of all its texts (column text), `step` windows
    a step. The weights
    that the tasks end with are averaged row by row, weighted by how often a task met the row."""
    shared = texts.sparkSession.sparkContext.broadcast((layout, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, begin = shared.value
        trainer, end = attention.Trainer(begin, own, RATE), len(own.kind)
        rng = np.random.default_rng(5)
        inputs = targets = np.zeros((0, attention.LENGTH), dtype=np.int32)
        as_input, as_class = np.zeros(end + 1, dtype=np.int64), np.zeros(attention.CLASSES, dtype=np.int64)

        def learn(last: bool) -> None:
            nonlocal inputs, targets
            stop = len(inputs) if last else len(inputs) - len(inputs) % step
            for i in range(0, stop, step):
                trainer.step(inputs[i : i + step], targets[i : i + step])
            inputs, targets = inputs[stop:], targets[stop:]

        for batch in batches:
            for _, _, some in blocks(batch, "text", LARGE):
                _, _, _, ids, edges = sequences(path, some)
                x, where, fresh = attention.windows(ids.astype(np.int32), edges, end, attention.LENGTH)
                order = rng.permutation(len(x))
                y = np.where(fresh, ids.take(where, mode="clip"), -1).astype(np.int32)
                as_input += np.bincount(x[fresh], minlength=end + 1)
                as_class += np.bincount(own.kind[ids], minlength=attention.CLASSES)
                inputs, targets = np.concatenate([inputs, x[order]]), np.concatenate([targets, y[order]])
                learn(False)
        learn(True)
        if trainer.steps:
            found = list(_packed(*_tables(trainer.w, as_input, as_class, own, trainer.steps)))
            for k, n, rows in found:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.binary()), pa.array([rows], pa.binary())], ["k", "n", "rows"])

    kind = "k int, n binary, rows binary"
    means = texts.mapInArrow(run, kind).repartition("k").sortWithinPartitions("k").mapInArrow(_averages, kind).toArrow()  # a row for each chunk of the weights
    out = start.copy()
    tables, _ = _tables(out, np.zeros(len(layout.kind) + 1), np.zeros(attention.CLASSES), layout, 0)
    place = [(t, at) for t in tables for at in range(0, len(t), CHUNK)]
    for k, n, rows in zip(*(means.column(c).to_pylist() for c in ("k", "n", "rows")), strict=True):
        table, at = place[k]
        met = np.frombuffer(n, dtype=np.float32) > 0
        table[at : at + CHUNK][met] = np.frombuffer(rows, dtype=np.float32).reshape(len(met), -1)[met]
    parts = out.parts()
    for part, table in zip(parts, [tables[0], *tables[3:7], tables[7], tables[1], tables[2]], strict=True):
        part[...] = table.reshape(part.shape)
    return out


def _tables(w: attention.Weights, as_input: np.ndarray, as_class: np.ndarray, layout: attention.Layout, steps: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The weights as tables of rows (E, V, c, P, A, W, U, b), and how often each row was met."""
    of_slot = np.repeat(as_class, np.diff(layout.begin))
    small = [w.P, w.A, w.W, w.U, w.b[None, :]]
    return [w.E, w.V, w.c[:, None], *small], [as_input, of_slot, of_slot, *[np.full(len(x), steps) for x in small]]


def train(training: DataFrame, counts: DataFrame, path: str, text_col: str = "text", rounds: tuple[int, ...] = ROUNDS) -> tuple[attention.Layout, attention.Weights]:
    """Fit the classes and the weights on all windows of all training rows."""
    n = subword_counts(counts, path)
    starts = np.array([_model(path).id_to_piece(i).startswith("▁") for i in range(len(n) - 1)] + [False])
    layout = attention.Layout.of(attention.classes_of(n, starts))
    weights = attention.Weights.initial(layout, n)
    size = counts.agg(F.coalesce(F.sum(F.col("c") * (F.octet_length("word") + 1)), F.lit(0)).alias("b")).first().b
    texts = training.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = F.pmod(F.xxhash64("text"), F.lit(PARTS))
    for low, high, step in zip(rounds[:-1], rounds[1:], chain(STEPS, repeat(STEPS[-1]))):
        trainers = 1 + int(size * (high - low) / PARTS) // TRAINER
        weights = train_round(texts.where((part >= low) & (part < high)).coalesce(trainers), path, layout, weights, step)
    return layout, weights


def _score(path: str, layout: attention.Layout, weights: attention.Weights, table: dict[bytes, int], texts: pa.Array) -> tuple:
    """Of each text: log10 probability, tokens, known ones and the sum of log10(c + 0.1) over
    the tokens in the table; and its other words with how often it has them."""
    distinct, line, heads, ids, cuts = sequences(path, texts)
    own, end = distinct.to_pylist(), len(distinct)
    score = np.add.reduceat(attention.log_probabilities(weights, layout, ids, cuts).astype(np.float64), cuts[:-1]) / np.log(10)
    c = np.array([table.get(w, -1) for w in own] + [table.get(END, 0)], dtype=np.float64)
    worth = np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.1), 0)
    base, known = np.add.reduceat(worth[line], heads[:-1]), np.add.reduceat((c > 0)[line].astype(np.int64), heads[:-1])
    rare = np.flatnonzero(c[line] < 0)
    doc = np.searchsorted(heads, rare, "right") - 1
    pairs, times = np.unique(doc * (end + 1) + line[rare], return_counts=True)
    offsets = np.searchsorted(pairs // (end + 1), np.arange(len(heads)))
    rest = pa.StructArray.from_arrays([distinct.take(pa.array(pairs % (end + 1))), pa.array(times, pa.int32())], ["word", "t"])
    return score, np.diff(heads), known, base, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest)


def lm_scores(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """Per row of df: its id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Rows whose crc32(id as text) mod 10 is not 0 are learnt from; without an id none is held
    out, and held_out is false. A null or empty text is its end alone. Repeated rows are learnt
    from and scored each; an empty table gives none; other columns are not looked at. score
    depends a little on how the training rows fall into tasks, as their weights are averaged;
    n_tokens to base_score do not.
    """
    id_kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counts = stored(word_counts(training), "counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    layout, weights = train(training, counts, model_path, rounds=rounds)
    top = frequent_counts(counts, frequent)
    table = dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True))
    shared: Broadcast = df.sparkSession.sparkContext.broadcast((layout, weights, table))
    floor = float(np.log10(totals.n + 0.1 * (totals.v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_layout, own_weights, own_table = shared.value
        for batch in batches:
            for at, to, texts in blocks(batch, "text", LARGE):
                score, n_tokens, known, base, others = _score(model_path, own_layout, own_weights, own_table, texts)
                part = batch.slice(at, to - at)
                keys = [xxhash.xxh3_128_digest(f"{i}/".encode() + x) for i, x in zip(part.column("id").to_pylist(), texts.cast(pa.large_binary()).to_pylist(), strict=True)]
                arrays = [part.column("id"), part.column("held_out"), pa.array(keys, pa.binary()), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(score), others]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "held_out", "key", "n_tokens", "n_known", "base", "score", "others"])

    schema = f"id {id_kind}, held_out boolean, key binary, n_tokens long, n_known long, base double, score double, others array<struct<word:binary,t:int>>"
    scored = stored(rows.select("id", "held_out", "text").mapInArrow(run, schema), "scored")
    # Rows of one key are equal: their sums are divided by how many they are.
    rare = scored.select("key", F.explode("others").alias("o")).select("key", "o.word", "o.t")
    found = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    worth = found.groupBy("key").agg(F.sum(F.col("t") * F.log10(F.col("c") + 0.1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("also"))
    times = scored.where(F.size("others") > 0).groupBy("key").agg(F.count("*").alias("times"))
    extra = worth.join(times, "key").select("key", (F.col("more") / F.col("times")).alias("more"), F.expr("also div times").alias("also"))
    return scored.join(extra, "key", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )
