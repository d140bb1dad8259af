import random
import re
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from fernweave.llm import license_texts as Z, token_counts as T
from fernweave.llm.decontaminate import _scan, build_index, contaminated_spans, drop_contaminated, spans
from fernweave.llm.licenses import license_scan
from fernweave.llm.queries import QUERIES, op7_decontamination
from fernweave.llm.text import ALNUM, words as text_words
from fernweave.llm.token_counts import token_counts
from tests.llm.conftest import lower

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(lower(text))


def key(t):
    return tuple((x is None, x) for x in t)


def test_token_counts_are_the_librarys(docs, rows, none):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted([tuple(r) for r in token_counts(docs, MODEL, limit=100, entries=5).collect()], key=key)
    n = [len(model.encode(t or "")) for _, t, *_ in rows]
    assert got == sorted([(i, len((t or "").encode()), k, k > 100) for (i, t, *_), k in zip(rows, n, strict=True)], key=key)
    assert token_counts(none, MODEL).collect() == []


def test_token_counts_on_documents(spark, sf):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op1_token_counts"](spark, sf).collect()}
    assert got == {i: len(model.encode(t)) for i, t in docs.items()}


def test_lengths_of_pretokens_add_up():
    model, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(1)
    parts = [" ", "  ", "\t", "\n", "▁", "▁▁", "\u3000", "\xa0", "\u200b", "\x00", "\x01", "\x1f", "\x7f", "a", "the", "License", "ing", "é", "漢", "ﬁ", "Ａ", "1", "<s>", "</s>", "<unk>"]
    texts = ["", " ", "a ", "hello world ", "hello\n ", *("".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(20_000))]
    coded, begins = T.pretokens(pa.array(texts))
    lengths = np.array(T._lengths(MODEL, coded.dictionary.to_pylist()))
    sums = np.add.reduceat(lengths[coded.indices.to_numpy()], begins)
    assert [n if t else 0 for n, t in zip(sums.tolist(), texts, strict=True)] == [len(model.encode(t)) for t in texts]


def test_token_counts_of_texts_that_end_in_spaces(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["", " ", "  ", "a ", "a  ", " a", "hello world ", "hello\n ", "▁", "a▁"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for entries in (0, 5, 1000):
        assert {r.doc_id: r.n_tokens for r in token_counts(df, MODEL, entries=entries).collect()} == {i: len(model.encode(t)) for i, t in enumerate(texts)}


def windows(text):
    w = words(text)
    return {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        for v in windows(item):
            for k in range(len(w) - len(v) + 1):
                if tuple(w[k : k + len(v)]) == v:
                    hit.update(range(k, k + len(v)))
                    found.add(name)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


def test_decontamination_edge_cases(docs, rows, none, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    for most in (64 << 20, 60):
        found = contaminated_spans(docs, benchmark, index_bytes=most).collect()
        got = [(r.doc_id, r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans or []), list(r["items"] or [])) for r in found]
        assert sorted(got, key=lambda x: (x[0] is None, x[0] or 0)) == sorted([(i, *brute(t, items)) for i, t, *_ in rows], key=lambda x: (x[0] is None, x[0] or 0))
    clean = drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns
    assert clean.count() == sum(brute(t, items)[1] == 0 for _, t, *_ in rows)
    assert contaminated_spans(none, benchmark).collect() == [] and drop_contaminated(docs, benchmark.limit(0)).count() == len(rows)


def scanned(texts, items):
    index, w = build_index(items), text_words(pa.array(texts), ALNUM)
    found, names = _scan(index, spans(index, w.hashes(), w.edges), w)
    return [(sum(b - a + 1 for a, b in s or []), sorted({str(x) for x in n or [] if x is not None})) for s, n in zip(found, names, strict=True)]


def test_repeated_words_cost_a_lookup_each():
    items = [(i, " ".join(["row"] * n)) for i, n in ((1, 2000), (2, 12), (3, 9))] + [(4, "cell " * 300 + "row " * 20)]
    tracemalloc.start()
    began = time.perf_counter()
    assert scanned(["row " * 20_000], items) == [(20_000, ["1", "2", "3", "4"])]
    assert time.perf_counter() - began < 2 and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_few_words_in_all_orders():
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(40)))) for i in range(12)]
    texts = [" ".join(rng.choice("ab" if k % 2 else "aaab") for _ in range(rng.randrange(60))) for k in range(200)]
    assert scanned(texts, items) == [brute(t, items)[1:] for t in texts]


def test_decontamination_on_documents(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in op7_decontamination(spark, sf).collect()}
    index = {}
    for name, item in items:
        for v in windows(item):
            index.setdefault(v, set()).add(name)
    for r in docs:
        w, hit, found = words(r.text), set(), set()
        for n in {len(v) for v in index}:
            for k in range(len(w) - n + 1):
                if names := index.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        assert got[r.doc_id] == (len(w), len(hit), len(found))


PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def licences(text):
    w = words(text)
    at = [(k, label) for label, p in PHRASES.items() for k in range(len(w)) if w[k : k + len(p)] == p]
    places = [k for k, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))


def test_license_scan(docs, rows, none):
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan(docs).collect()]
    assert sorted(got, key=key) == sorted([(i, *licences(t)) for i, t, *_ in rows], key=key)
    own = license_scan(docs).where("doc_id is null").first()
    assert own.labels == "apache,gpl,mit,mit-notice" and own.score == 1.0
    assert [s["label"] for s in own.spans].count("mit") == 2
    assert license_scan(none).collect() == []


def labelled(text):
    """Labels and score by looking at every place of every template."""
    w, labels, score = words(text), set(), 0.0
    for label, template, phrases in Z.BASE + Z.NOTICES + Z.TEXTS:
        own, keys = words(template), [words(p) for p in phrases]
        at = [next(i for i in range(len(own)) if own[i : i + len(k)] == k) for k in keys]
        slack = len(own) // 8
        held = [[i for i in range(len(w)) if w[i : i + len(k)] == k] for k in keys]
        for p in held[0]:
            if all(any(abs((q - p) - (o - at[0])) <= slack for q in qs) for qs, o in zip(held[1:], at[1:], strict=True)):
                part = w[max(0, p - at[0] - slack) : max(0, p - at[0] + len(own) + slack)]
                pairs = set(zip(own, own[1:], strict=False))
                share = len(pairs & set(zip(part, part[1:], strict=False))) / len(pairs)
                if share >= 0.6:
                    labels.add(label)
                    score = max(score, share)
    return ",".join(sorted(labels)), score


def licence_files():
    """Whole licences between other words, with words left out, added and changed, cut, and without a key phrase."""
    rng, out = random.Random(12), []
    for _, text, phrases in Z.TEXTS:
        w = text.split()
        noise = [f"n{rng.randrange(99)}" for _ in range(60)]
        out += [" ".join(noise[:30] + w + noise[30:]), " ".join(w + w), " ".join(w[: len(w) // 2])]
        for k in (1, 3, 8, len(w) // 3):
            v = list(w)
            for i in sorted(rng.sample(range(len(v)), min(k, len(v))), reverse=True):
                v[i : i + 1] = rng.choice(([], [v[i], "extra"], ["other"]))
            out.append(" ".join(noise[: rng.randrange(40)] + v))
        out.append(" ".join(words(text)).replace(phrases[-1], "something else"))
    return out


def test_labels_and_scores_by_hand(spark):
    texts = licence_files()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: labelled(t) for i, t in enumerate(texts)}
    got = {r.doc_id: (r.labels, r.score) for r in license_scan(df).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-9 for i in want)
    whole = [want[i][0].split(",") for i in range(0, len(texts), 8)]
    assert all(label in found for (label, *_), found in zip(Z.TEXTS, whole, strict=True))
    assert all(label not in want[i][0].split(",") for (label, *_), i in zip(Z.TEXTS, range(7, len(texts), 8), strict=True))


def test_license_scan_on_documents(spark, sf):
    got = {r.doc_id: ((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels), (r.labels, round(r.score, 9))) for r in QUERIES["op5_license_scan"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        labels, score = labelled(r.text)
        assert got[r.doc_id] == (licences(r.text), (labels, round(score, 9)))


def test_partitioning_does_not_matter(docs, benchmark):
    rank = lambda d: sorted(map(str, contaminated_spans(d, benchmark).collect()))
    assert rank(docs) == rank(docs.coalesce(1).orderBy(F.desc("doc_id")))
