"""Collocations, divergence of sources and quality rules against plain loops."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fernweave.llm import collocations as C, divergence as D, quality_rules as Q
from fernweave.llm.queries import QUERIES
from fernweave.llm.store import stored
from tests.llm.conftest import SCHEMA, lower

PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")


def pieces(text):
    return [w for p in PIECE.split(lower(text)) if (w := re.findall(r"[^\x20\x09]+", p))]


def plain_collocations(rows, least, most, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for m in range(1, most + 1):
                f[lang].update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, own in f.items():
        often = {p: c for p, c in own.items() if c >= least}
        found = []
        for p, a in often.items():
            longer = [c for q, c in often.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if len(p) > 1 and not any(100 * c >= 100 * a for c in longer):
                cuts = [(1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("least", "most", "top"), [(2, 5, 2000), (1, 3, 7), (3, 2, 2)])
def test_collocations_are_those_of_a_loop(spark, docs, rows, least, most, top):
    more = [(20 + i, t, lang, "s", 0) for i in range(3) for lang, t in (("en", "a b a b a, a a a a\nb a b"), ("en", "The end. The end of the end"), (None, "É é. x\ty x y; x y"), ("und", "x y"))]
    few = [r for r in rows if r[0] != 6]
    df = spark.createDataFrame([*few, *more], SCHEMA).repartition(3)
    got = C.collocations(df, least=least, most=most, top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations([(r[2], r[1]) for r in [*few, *more]], least, most, top)


def test_collocations_of_other_columns_and_no_rows(docs, none):
    assert C.collocations(docs, least=2).count() > 0
    assert C.collocations(none, least=1).collect() == []


@pytest.mark.parametrize(("stretch", "probes"), [(64, 1), (128, 50), (1 << 16, 50), (1 << 16, 1 << 20)])
def test_bitmaps_extend_phrases_as_windows_do(stretch, probes):
    rng = np.random.default_rng(3)
    ids = rng.integers(-1, 6, 5000).astype(np.int32)
    ids[60:70] = 2  # a run over the edge of a lane
    a, b = np.repeat(np.arange(6), 6), np.tile(np.arange(6), 6)
    some = (a + 2 * b) % 7 > 0
    row, n = C.shard_phrases(ids, a[some], b[some], 4, stretch, probes)
    allowed = set(zip(a[some].tolist(), b[some].tolist(), strict=True))
    windows = (ids[k : k + m].tolist() for m in (2, 3, 4) for k in range(len(ids) - m + 1))
    want = Counter(tuple(w + [-1] * (4 - len(w))) for w in windows if min(w) >= 0 and set(itertools.pairwise(w)) <= allowed)
    assert dict(zip(map(tuple, row.tolist()), n.tolist(), strict=True)) == dict(want) and len(row) == len(want)


def test_a_task_sends_each_phrase_once_and_none_around_a_rare_three():
    """Five words deal all their pairs often; of the threes in a row only one is frequent."""
    rng = np.random.default_rng(4)
    gids = np.sort(rng.integers(-(1 << 62), 1 << 62, 40))
    shards = []
    for _ in range(3):
        ids = rng.integers(0, 40, 3000).astype(np.int32)
        ids[::7], ids[1::7], ids[2::7], ids[3::7] = -1, 1, 2, 3  # 1 2 3 in each piece
        shards.append(pa.RecordBatch.from_arrays([pa.array([gids.tolist()], pa.list_(pa.int64())), pa.array([ids.tobytes()], pa.binary())], ["gids", "ids"]))
    windows = Counter()
    for shard in shards:
        ids = np.frombuffer(shard.column("ids")[0].as_py(), dtype=np.int32)
        windows += Counter(tuple(ids[k : k + m].tolist()) for m in (2, 3, 4, 5) for k in range(len(ids) - m + 1) if ids[k : k + m].min() >= 0)

    def frequent(packed, least):
        rows = sorted(((r["bucket"], r["codes"], r["counts"]) for b in packed for r in b.to_pylist()), key=lambda r: r[0])
        batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], ["bucket", "codes", "counts"])
        found = np.concatenate([b.column("code").to_numpy() for b in C._often(iter([batch.slice(0, 5), batch.slice(5)]), least)])
        marks = np.zeros(1 << 16, dtype=np.uint64)
        np.bitwise_or.at(marks, (found & ((1 << 22) - 1)) >> 6, np.uint64(1) << (found & 63).astype(np.uint64))
        return found, marks

    pairs, twos = frequent(C._packed(C._pairs(iter(shards)), 3), 3)
    assert len(pairs) == sum(n >= 3 for w, n in windows.items() if len(w) == 2)
    triples, threes = frequent(C._packed(C._threes(iter(shards), twos), 20), 20)
    assert len(triples) == sum(n >= 20 for w, n in windows.items() if len(w) == 3)
    got = [(tuple(np.searchsorted(gids, r["p"]).tolist()), r["c"]) for b in C._mined(iter(shards), 5, twos, threes) for r in b.to_pylist()]
    fits = lambda w: all(windows[x] >= 3 for x in itertools.pairwise(w)) and all(windows[x] >= 20 for x in zip(w, w[1:], w[2:], strict=False))
    assert sorted(got) == sorted((w, n) for w, n in windows.items() if fits(w))


def test_rows_of_frequent_words_are_short_and_end_between_pieces(monkeypatch):
    monkeypatch.setattr(C, "PIECE", 50)
    rng = np.random.default_rng(5)
    hashes = np.sort(rng.integers(-(1 << 62), 1 << 62, 30))
    ids = rng.integers(-1, 30, 2000).astype(np.int32)
    marks = np.zeros(1 << 16, dtype=np.uint64)
    bit = C._code(hashes[:20], hashes[:20]) & ((1 << 22) - 1)
    np.bitwise_or.at(marks, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
    shard = pa.RecordBatch.from_arrays([pa.array([hashes.tolist()], pa.list_(pa.int64())), pa.array([ids.tobytes()], pa.binary())], ["hashes", "ids"])
    rows = [r for b in C._frequent_ids(iter([shard]), marks) for r in b.to_pylist()]
    parts = [np.frombuffer(r["ids"], dtype=np.int32) for r in rows]
    assert len(rows) > 10 and all(50 <= len(x) < 100 and x[-1] == -1 for x in parts[:-1])
    assert all(set(x[x >= 0].tolist()) == set(range(len(r["gids"]))) for x, r in zip(parts, rows, strict=True))
    got = [r["gids"][k] if k >= 0 else None for x, r in zip(parts, rows, strict=True) for k in x.tolist()]
    want = [int(hashes[k]) if 0 <= k < 20 else None for k in ids.tolist()]
    assert got == [w for k, w in enumerate(want) if w is not None or (k and want[k - 1] is not None)]


@pytest.mark.parametrize("held", [1, 40, 1 << 20])
def test_phrases_cross_in_buckets_and_keep_their_counts(monkeypatch, held):
    monkeypatch.setattr(C, "COUNTED", held)
    monkeypatch.setattr(C, "BUCKETS", 4)
    rng = np.random.default_rng(6)
    words, total, dealt = rng.integers(-(1 << 62), 1 << 62, 6), Counter(), []
    for _ in range(20):
        own = Counter({tuple(words[rng.integers(0, 6, m)].tolist()): int(rng.integers(1, 1 << 33)) for m in (2, 2, 3, 4, 5) for _ in range(30)})
        total += own
        batch = pa.RecordBatch.from_arrays([pa.array([list(p) for p in own], pa.list_(pa.int64())), pa.array(list(own.values()), pa.int64())], ["p", "c"])
        rows = [r for b in C._dealt(iter([batch, batch.slice(0, 0)]), 5) for r in b.to_pylist()]
        assert len(rows) <= 4 * 4 < len(own)
        dealt += [(r["bucket"], r["words"], r["counts"]) for r in rows]
    dealt.sort(key=lambda r: r[0])
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*dealt, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "words", "counts"])
    got = [(tuple(r["p"]), r["f"]) for b in C._counted(iter([batch.slice(0, 7), batch.slice(7)]), 5, 1 << 32) for r in b.to_pylist()]
    assert sorted(got) == sorted((p, n) for p, n in total.items() if n >= 1 << 32)


def test_large_rows_are_stored_in_row_groups_of_bounded_size(spark):
    table = stored(spark.range(0, 40, 1, 1).select(F.expr("array_join(transform(sequence(1, 16384), i -> sha2(concat(id, '-', i), 256)), '')").alias("x")), "large", large=True)
    found = pq.ParquetFile(table.inputFiles()[0].removeprefix("file://")).metadata
    assert found.num_rows == 40 and max(found.row_group(i).num_rows for i in range(found.num_row_groups)) <= 20


def test_scores_beyond_64_bits(spark):
    df = spark.sql("select cast(4e15 as bigint) a, cast(9e15 as bigint) n, cast(5e15 as bigint) l, cast(6e15 as bigint) r")
    exact = df.selectExpr("cast((cast(1000 * a as decimal(20,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint) as s").first().s
    assert exact == 1000 * 4 * 9 // 30


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, least, k):
    count, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        key = (lang or "", source or "")
        groups.add(key)
        own = TERM.findall(lower(text))
        count[key].update(own)
        seen[key[0]].update(set(own))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        mine = sorted(g for g in groups if g[0] == lang)
        every = Counter()
        for g in mine:
            every.update(count[g])

        def p(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        ps, q = {g: p(count[g]) for g in mine}, p(every)
        for g in mine:
            pairs = [(-sum((ps[g][t] - ps[h][t]) ** 2 // ps[h][t] for t in kept), h[1].encode()) for h in mine if h != g]
            terms = [(-((ps[g][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[g][t] and ps[g][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:k])):
                out += [(*g, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "k"), [(1, 200), (1, 2), (2, 3), (3, 200)])
def test_divergence_is_that_of_a_loop(docs, rows, none, least, k):
    got = D.source_divergence(docs, least=least, k=k)
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence([(r[1], r[2], r[3]) for r in rows], least, k)
    assert D.source_divergence(none).collect() == []


def test_unseen_buckets_are_strictly_below_the_last_term(spark):
    """Ties at the k-th value lie in several buckets: all are evaluated, terms decide."""
    rng = np.random.default_rng(5)
    texts = [(" ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in rng.zipf(1.3, 400) % 400), "en", f"s{j % 3}") for j in range(60)]
    df = spark.createDataFrame(texts, "text string, lang string, source string")
    for k in (1, 5, 50):
        assert sorted(tuple(r) for r in D.source_divergence(df, k=k).collect()) == plain_divergence(texts, 3, k)


def plain_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {i for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics_are_those_of_a_loop(docs, rows, none):
    extra = ["a\nb\na\n\na \na", "x y z " * 9, "A a A a", "\n\n", "one two three four five six seven eight " * 2 + "nine", "a\r\nb\r\na\r\n", "# | <b> $5 %&*\n" * 3, "l" * 4000 + "\n" + "l" * 4000 + "\n" + "l" * 3999 + "m"]
    texts = [r[1] for r in rows] + extra
    got = Q.statistics(pa.array([t or "" for t in texts]))
    want = [plain_statistics(t) for t in texts]
    for i, name in enumerate(Q.COUNTS[:5]):
        assert got[name].tolist() == [x[i] for x in want], name
    found = sorted((r.doc_id is None, r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in Q.quality_rules(docs, []).collect())
    base = lambda s: s[0] < 20 or 100 * s[4] > 30 * s[0]
    assert found == sorted((r[0] is None, r[0], *plain_statistics(r[1]), base(plain_statistics(r[1])), not base(plain_statistics(r[1]))) for r in rows)
    assert Q.quality_rules(none, []).collect() == []


def test_the_list_is_an_ordered_case_of_what_it_covers(spark):
    """Bad rows have many symbols, or few distinct words in long texts: two rules."""
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(Q.FEATURES)))
    at = {n: i for i, n in enumerate(Q.FEATURES)}
    bad = (x[:, at["symbols_a_word"]] > 0.8) | (x[:, at["distinct_a_word"]] < 0.2) & (x[:, at["n_words"]] > 0.5)
    rules = Q.learn_list(x, bad)
    rejected = np.logical_or.reduce([Q.covered(r, x) for r in rules])
    assert 2 <= len(rules) <= Q.RULES and (rejected == bad).mean() > 0.97 and (rejected & ~bad).sum() <= 0.02 * (~bad).sum()
    counts = spark.createDataFrame([tuple(range(1, len(Q.COUNTS) + 1)), tuple(7 * i % 11 for i in range(len(Q.COUNTS)))], ", ".join(f"{c} long" for c in Q.COUNTS))
    values = counts.selectExpr("*", *[f"{e} as f{i}" for i, e in enumerate(Q.FEATURES.values())])
    got = [r[0] for r in counts.select(Q.rejected_by(rules)).collect()]
    rows = np.array([r[-len(Q.FEATURES) :] for r in values.collect()])
    want = [next((" and ".join(map(str, rule)) for rule in rules if Q.covered(rule, row[None])[0]), None) for row in rows]
    assert got == want
    assert Q.learn_list(x, np.zeros(3000, bool)) == [] and Q.learn_list(x[:0], bad[:0]) == []


def test_quality_rules_on_documents(spark, sf):
    """On labels that taught nothing: the bad are rejected, the good kept."""
    sf = sf.replace("sf0.001", "sf0.1")
    got = {r.doc_id: r for r in QUERIES["op12_quality_rules"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    y = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality", "crc32(cast(doc_id as string)) % 5 = 0 as held").where("held").collect()
    good, bad = ([got[r.doc_id] for r in y if r.quality == q] for q in (1, 0))
    assert sum(r.rule is None for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.03 * len(bad)
    assert all(r.kept == (r.rule is None and not r.base_failed) for r in got.values())
