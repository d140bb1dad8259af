import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from fernweave.llm import attention as A, lm_score as L, quality as Q
from fernweave.llm.queries import QUERIES
from tests.llm.conftest import lower

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held(i, parts):
    return i is not None and zlib.crc32(str(i).encode()) % parts == 0


def base_scores(rows):
    """(held out, tokens, known, N, base score) of each row, by counting."""
    lines = [WORD.findall(lower(t)) + [None] for _, t, *_ in rows]
    counts = {}
    for (i, *_), line in zip(rows, lines, strict=True):
        if not held(i, 10):
            for w in line:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    score = lambda w: math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1)))
    return [(held(i, 10), len(x), sum(w in counts for w in x), n, sum(map(score, x))) for (i, *_), x in zip(rows, lines, strict=True)]


def check_base(rows, found):
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1:5]), x[5])
    want = sorted([(i, *b) for (i, *_), b in zip(rows, base_scores(rows), strict=True)], key=key)
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found], key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want], rtol=1e-9)


ONE_ROUND = (0, L.PARTS)


def test_lm_edge_cases(docs, rows, none):
    for frequent in (1 << 17, 5):
        found = L.lm_scores(docs, MODEL, frequent=frequent, rounds=ONE_ROUND).collect()
        check_base(rows, found)
        assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    same = [r.score for r in found if r.doc_id in (1, 2)]
    assert len(same) == 3 and max(same) - min(same) < 1e-3
    empty = [r.score for r in found if r.doc_id in (3, 4)]
    assert abs(empty[0] - empty[1]) < 1e-6
    assert L.lm_scores(none, MODEL, rounds=ONE_ROUND).collect() == []


def plain_log10(w, layout, ids):
    """The log10 probability of a text's subwords, token by token over all classes and members."""
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    total = 0.0
    for t, token in enumerate(ids):
        nth = 0 if t < A.LENGTH else -(-(t - A.LENGTH + 1) // A.STRIDE)
        start = nth * A.STRIDE
        before = [len(layout.kind) if i == 0 else ids[i - 1] for i in range(start, t + 1)]
        x = w.E[before].astype(float) + w.P[: len(before)]
        h = softmax(x[-1] @ w.A.astype(float) @ x.T / math.sqrt(A.WIDTH)) @ x
        y = x[-1] + h @ w.W
        k = layout.kind[token]
        members = [i for i in np.flatnonzero(layout.kind == k)]
        own = softmax(y @ w.V[layout.slot[members]].astype(float).T + w.c[layout.slot[members]])
        total += math.log10(softmax(y @ w.U + w.b)[k]) + math.log10(own[members.index(token)])
    return total


def subword_ids(text):
    model = L._model(MODEL)
    return [i for word in WORD.findall(lower(text)) for i in model.encode(word)] + [model.vocab_size()]


def test_lm_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = QUERIES["op8_lm_scoring"](spark, sf).collect()
    check_base(rows, found)
    training = docs.where(~L.held_out(F.col("doc_id")))
    layout, w = L.train(training, L.word_counts(training), MODEL)
    score = {r.doc_id: r.score for r in found}
    short = sorted(rows, key=lambda r: len(r[1] or ""))
    for i, text in [*short[:12], short[len(short) // 2]]:
        assert abs(score[i] - plain_log10(w, layout, subword_ids(text))) < 1e-3 * abs(score[i])
    # Held-out texts are likelier than by the subwords' shares alone, and than their own letters shuffled.
    own = [t for i, t in rows if held(i, 10) and t]
    assert len(own) > 5
    flat = A.Weights.initial(layout, L.subword_counts(L.word_counts(training), MODEL))
    flat.E[:], flat.P[:] = 0, 0
    rng = random.Random(4)
    shuffled = [" ".join("".join(rng.sample(x, len(x))) for x in t.split()) for t in own]
    mean = lambda weights, texts: np.mean([sum(A.log_probabilities(weights, layout, np.array(e := subword_ids(t)), np.array([0, len(e)]))) / len(t) for t in texts])
    assert mean(w, own) > mean(flat, own) and mean(w, own) > mean(w, shuffled)


def small(seed=1, n=400):
    rng = np.random.default_rng(seed)
    counts = (5000 / np.arange(1, n + 1)).astype(np.int64)
    layout = A.Layout.of(A.classes_of(counts, np.arange(n) % 2))
    w = A.Weights.initial(layout, counts)
    for x in w.parts():
        x += (rng.standard_normal(x.shape) * 0.2).astype(np.float32)
    return rng, layout, w


def test_every_step_is_a_distribution():
    rng, layout, w = small()
    for size in (1, 5, A.LENGTH, 40):
        prefix = rng.integers(0, 400, size - 1)
        lines = np.concatenate([np.append(prefix, i) for i in range(400)])
        last = A.log_probabilities(w, layout, lines, np.arange(401) * size)[size - 1 :: size]
        assert abs(np.exp(last.astype(float)).sum() - 1) < 1e-4


def test_scores_are_the_plain_ones_and_causal():
    rng, layout, w = small()
    lines = [rng.integers(0, 400, n) for n in (1, 2, A.LENGTH, A.LENGTH + 1, 50, 77)]
    edges = np.append(0, np.cumsum([len(x) for x in lines]))
    got = A.log_probabilities(w, layout, np.concatenate(lines), edges)
    for line, a, b in zip(lines, edges, edges[1:], strict=False):
        assert abs(got[a:b].sum() / math.log(10) - plain_log10(w, layout, line.tolist())) < 1e-2
    other = np.append(lines[5][:30], rng.integers(0, 400, 47))
    assert np.allclose(A.log_probabilities(w, layout, other, np.array([0, 77]))[:30], got[edges[5] : edges[5] + 30], atol=1e-4)
    w.U *= 400  # beyond what exp can hold
    assert np.isfinite(A.log_probabilities(w, layout, np.concatenate(lines), edges)).all()


def test_windows_take_each_token_once():
    ids, edges = np.arange(200), np.array([0, 1, 17, 33, 34, 120, 200])
    for stride in (A.STRIDE, A.LENGTH):
        inputs, where, fresh = A.windows(ids, edges, 999, stride)
        assert sorted(where[fresh].tolist()) == list(range(200))
        begins = set(edges[:-1].tolist())
        assert all(x == (999 if t in begins else t - 1) for x, t in zip(inputs[fresh].tolist(), where[fresh].tolist(), strict=True))


def test_attention_gradients():
    rng, layout, w = small()
    w = A.Weights(*[x.astype(np.float64) for x in w.parts()])
    inputs, targets = rng.integers(0, 401, (4, A.LENGTH)), rng.integers(-1, 400, (4, A.LENGTH))
    _, g = A.loss_and_gradients(w, layout, inputs, targets)
    whole = {k: np.zeros_like(getattr(w, k)) for k in ("E", "V", "c")} | {k: g[k] for k in ("P", "A", "W", "U", "b")}
    whole["E"][g["E"][0]] = g["E"][1]
    for k in ("V", "c"):
        for first, end, values in g[k]:
            whole[k][first:end] += values
    for k, grad in whole.items():
        flat, own = getattr(w, k).reshape(-1), np.asarray(grad).reshape(-1)
        for at in [int(np.abs(own).argmax()), *rng.choice(len(flat), 5)]:
            was = flat[at]
            sides = []
            for d in (1e-5, -1e-5):
                flat[at] = was + d
                sides.append(A.loss_and_gradients(w, layout, inputs, targets)[0])
            flat[at] = was
            assert abs((sides[0] - sides[1]) / 2e-5 - own[at]) < 1e-5


def test_training_lowers_the_loss():
    rng, layout, w = small()
    line = np.tile([1, 5, 2, 70, 300], 40)
    at = rng.integers(0, 150, 64)
    inputs, targets = np.stack([line[i : i + A.LENGTH] for i in at]), np.stack([line[i + 1 : i + A.LENGTH + 1] for i in at])
    trainer = A.Trainer(w, layout, 0.1)
    first = trainer.step(inputs, targets)
    for _ in range(60):
        last = trainer.step(inputs, targets)
    assert last < first / 3 and trainer.steps == 61


def test_weights_are_averaged_by_how_often_rows_are_met():
    a, b = np.ones((1500, 2), np.float32), np.full((1500, 2), 4, np.float32)
    na, nb = np.zeros(1500, np.int64), np.zeros(1500, np.int64)
    na[3], nb[3], nb[1200] = 2, 1, 5
    parts = sorted([*L._packed([a], [na]), *L._packed([b], [nb])])
    assert [k for k, *_ in parts] == [0, 0, 1]
    batches = [pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.binary()), pa.array([r], pa.binary())], ["k", "n", "rows"]) for k, n, r in parts]
    out = {b.column("k")[0].as_py(): (np.frombuffer(b.column("n")[0].as_py(), np.float32), np.frombuffer(b.column("rows")[0].as_py(), np.float32).reshape(-1, 2)) for b in L._averages(iter(batches))}
    assert out[0][0][3] == 3 and (out[0][1][3] == 2).all() and (out[1][1][1200 - L.CHUNK] == 4).all() and out[0][0].sum() == 3


def auc(scores, labels):
    good, bad = [s for s, y in zip(scores, labels, strict=True) if y], [s for s, y in zip(scores, labels, strict=True) if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_quality_on_held_out_labels(spark, sf):
    sf = f"{sf.rpartition('/')[0]}/sf0.01"  # enough labels
    found = {r.doc_id: r for r in QUERIES["op9_quality"](spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    own = [(found[i], y) for i, y in labels if held(i, 5)]
    assert all(r.held_out == held(i, 5) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in found.items())
    assert auc([r.score for r, _ in own], [y for _, y in own]) > 0.9
    assert sum(r.predicted == y for r, y in own) / len(own) > 0.85


def test_quality_edge_cases(spark, docs, rows, none):
    labels = spark.createDataFrame([(1, 1), (6, 0), (9, 0), (2, 1), (None, 1), (8, None)], "doc_id long, quality int")
    ranking = Q.learn_quality(docs, labels)
    found = Q.quality_scores(docs, ranking).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    empty = [r.score for r in found if r.doc_id in (3, 4)]
    assert empty[0] == empty[1]
    assert [r.held_out for r in found if r.doc_id is None] == [None]
    assert Q.quality_scores(none, ranking).collect() == [] and Q.learn_quality(none, labels.limit(0)).weights.sum() == 0
    kept = Q.keep_quality(docs, ranking)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in found)


def test_ranking_orders_pairs():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 5))
    y = (x[:, 0] - 2 * x[:, 3] + 0.3 * rng.standard_normal(400) > 0).astype(int)
    r = Q.fit_ranking(x, y)
    assert auc(r.scores(x), y) > 0.95
    assert abs((r.scores(x) >= Q.ACCEPT).mean() - y.mean()) < 0.02


def test_features_of_rows_do_not_depend_on_neighbours():
    texts = ["One two two.", "", "ÄÖ ü! ü! 12", "x" * 100]
    whole = Q.features(pa.array(texts))
    assert np.allclose(whole, np.concatenate([Q.features(pa.array([t])) for t in texts]))
    assert not whole[1].any()


def test_words_are_counted_once_for_each_partition_count(docs):
    total = lambda d: sorted((bytes(r.word), r.c) for r in L.word_counts(d).collect())
    assert total(docs) == total(docs.coalesce(1)) and total(docs.where(F.lit(False))) == []


def test_every_label_and_every_pair_teaches(spark):
    """More labelled rows than were once read, against the same fit in one process."""
    rng = np.random.default_rng(5)
    n = 22_000
    y = (rng.random(n) < 0.7).astype(int)
    words = rng.integers(0, 9, n)
    texts = [("Aa!| #9" * (1 + (i % 3)) if not k or i % 7 == 0 else "some plain words " * (1 + int(m))) + " x" * (i % 11) for i, (k, m) in enumerate(zip(y, words, strict=True))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)], "doc_id long, quality int")
    own = np.array([i for i in range(n) if not held(i, 5)])
    rows = Q.labelled_features(docs, labels, "doc_id", "text", "quality")
    assert rows.count() == len(own)
    whole = Q.fit_ranking(Q.features(pa.array([texts[i] for i in own])), y[own])
    found = Q.learn_quality(docs, labels)
    assert np.allclose(found.weights, whole.weights, atol=1e-6) and abs(found.threshold - whole.threshold) < 1e-6


def test_sums_over_cells_are_sums_over_pairs():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 4)) * [1, 2, 5, 0.3]
    y = (x[:, 0] + rng.standard_normal(300) > 0.4).astype(int)
    w = np.array([0.4, -1.2, 0.8, 2.0])
    d = (x[y == 1][:, None, :] - x[y == 0][None, :, :]).reshape(-1, 4)
    p = 1 / (1 + np.exp(d @ w))
    want = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(4), d.T @ p / len(d) - 1e-3 * w)
    assert np.allclose(Q._step(Q.pair_sums(x, y, w), w, 1e-3), want, rtol=1e-8, atol=1e-9)
    parts = [Q.pair_sums(x[i::3], y[i::3], w) for i in range(3)]
    added = {k: sum(q[k] for q in parts if k in q) for q0 in parts for k in q0}
    assert np.allclose(Q._step(added, w, 1e-3), want, rtol=1e-8, atol=1e-9)
