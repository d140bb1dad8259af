import random

import numpy as np
import xxhash

from fernweave.llm import simhash as H
from fernweave.llm.components import connected_components
from fernweave.llm.queries import QUERIES
from tests.llm.conftest import lower


def reference(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(fps):
    """The smallest position each can reach over links of 3 bits or fewer."""
    out = list(range(len(fps)))
    while True:
        new = [min(out[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        if new == out:
            return out
        out = new


def test_components(docs, rows, none):
    got = H.simhash_components(docs).collect()
    fps = [reference(t) for _, t, *_ in rows]
    assert sorted((r.fingerprint, r.doc_id or -1) for r in got) == sorted((f"{f:016x}", i or -1) for f, (i, *_) in zip(fps, rows, strict=True))
    names = groups(fps)
    least = {g: min((rows[i][0] for i in range(len(rows)) if names[i] == g and rows[i][0] is not None), default=None) for g in set(names)}
    want = sorted([(f"{fps[i]:016x}", rows[i][0] or -1, least[names[i]]) for i in range(len(rows))], key=str)
    assert sorted([(r.fingerprint, r.doc_id or -1, r.component_id) for r in got], key=str) == want
    assert H.simhash_components(none).collect() == []


def test_one_document_of_each_group_stays(docs, none):
    kept = H.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 6, 7, 8, 9, 10]
    assert kept.where("doc_id is null").count() == 1
    assert H.drop_near_duplicates(none).collect() == []


def test_links_join_what_all_close_pairs_join(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << rng.randrange(64) for _ in range(n)) for b in base for n in (1, 2, 3, 4)]
    chain = [base[0]]
    for i in range(12):  # far ends only meet through the links between
        chain.append(chain[-1] ^ (7 << (5 * i)))
    fps = list(dict.fromkeys(fps + chain))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = H.simhash_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    root = {r.node: r.root for r in connected_components(links).collect()}
    got = {}
    for i, f in enumerate(signed):
        got.setdefault(root.get(f, f), set()).add(i)
    want = {}
    for i, g in enumerate(groups(fps)):
        want.setdefault(g, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_postings_are_split(spark, monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << rng.randrange(40) for _ in range(rng.randrange(1, 9))) for _ in range(300)}
    fps |= {f ^ (1 << rng.randrange(64)) for f in list(fps)[:80]} | {rng.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = groups(sorted(fps))
    for compared in (4096, 40, 3):  # no posting is long, some are, parts are too
        monkeypatch.setattr(H, "COMPARED", compared)
        root = {r.node: r.root for r in connected_components(H.simhash_links(df)).collect()}
        got = {}
        for i, f in enumerate(signed):
            got.setdefault(root.get(f, f), set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(sorted(i for i, g in enumerate(want) if g == k) for k in set(want))


def test_batches_that_cut_runs():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    key = np.sort(rng.integers(0, 6, 200))
    fp = (rng.integers(0, 4, 200) << 3 | np.arange(200) % 8) + key * 1000
    whole = H.linked_in_postings(key.astype(np.uint64), fp.astype(np.uint64))
    cuts = [slice(a, b) for a, b in zip([0, 1, 40, 41, 120, 121, 130], [1, 40, 41, 120, 121, 130, 200], strict=True)]
    parts = [pa.RecordBatch.from_arrays([pa.array(key[c]), pa.array(fp[c])], ["key", "fp"]) for c in cuts]
    out = pa.Table.from_batches(H._links(False)(iter(parts))).to_pydict()
    assert sorted(zip(out["a"], out["b"], strict=True)) == sorted(zip(*(x.tolist() for x in whole), strict=True)) and len(out["a"]) > 50


def test_components_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps, ids = [reference(r.text) for r in docs], [r.doc_id for r in docs]
    names = groups(fps)
    want = {ids[i]: (f"{fps[i]:016x}", min(ids[j] for j in range(len(ids)) if names[j] == names[i])) for i in range(len(ids))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, sf).collect()} == want


def test_equal_ids_of_different_texts(spark):
    a, b = "the cat sat on the mat and slept all day long", "a wholly different line about ships at sea and storms"
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (3, b, "u"), (3, b, "u"), (4, b + " now", "v"), (None, a, "w"), (None, None, None), (5, "own words in this one stand alone here", "p"), (5, "own words in this one stand alone here", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    for options in ({}, {"shingle": 5, "similarity": 0.8}):
        kept = H.drop_near_duplicates(df, **options)
        got = sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect())
        assert kept.columns == df.columns and kept.where("doc_id is null").count() == 2
        assert (1, a) in got and (2, b) in got and (2, a) not in got and (3, b) not in got
        assert sum(i == 5 for i, _ in got) == 1


def test_components_of_links(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (7, 20), (None, 4), (3, 2), (30, 31), (31, 32), (33, 32), (33, 34), (34, 35), (35, 36)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 7: 7, 8: 7, 9: 7, 20: 7} | {i: 30 for i in range(30, 37)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
