import random

import numpy as np

import corpus_pipeline as P
from fernweave.llm import similar as L
from fernweave.llm.simhash import drop_near_duplicates
from tests.llm.conftest import lower


def shingles(text, k=5):
    w = lower(text).split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({" ".join(w)} if w else set())


def stay(rows, bound=0.8):
    """Ids that no smaller id is joined with, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    like = lambda a, b: len(a & b) >= bound * len(a | b) - 1e-9
    near = [[j for j, b in enumerate(sets) if like(a, b)] for a in sets]
    out = [i for i, _ in rows]
    while (new := [min(out[j] for j in js) for js in near]) != out:
        out = new
    return sorted(set(out))


def edited():
    """Texts, each with copies of a few changed words: likenesses on both sides of 0.8."""
    rng = random.Random(11)
    rows = []
    for _ in range(30):
        w = [f"w{rng.randrange(900)}" for _ in range(rng.choice((4, 30, 100, 250)))]
        for changes in (0, 1, 2, 4, 9):
            v = list(w)
            for at in rng.sample(range(len(v)), min(changes, len(v))):
                v[at] = "new" + str(rng.randrange(99))
            rows.append((len(rows), " ".join(v)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(len(rows) + i, f"{passage} {' '.join(f'o{i}x{j}' for j in range(i % 30))}") for i in range(60)]
    return rows


def test_stage_drops_all_pairs_of_five_word_likeness(spark, tmp_path):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in P.near_duplicates(spark, docs, str(tmp_path)).collect())
    assert got == stay(rows)
    assert len(got) < drop_near_duplicates(docs).count()  # the 3-bit rule leaves near copies


def test_postings_by_pairs_and_in_blocks_agree(spark, monkeypatch):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for short, block in ((1, 4), (1, 256), (4, 16)):
        monkeypatch.setattr(L, "SHORT", short)
        monkeypatch.setattr(L, "BLOCK", block)
        assert sorted(r.doc_id for r in drop_near_duplicates(docs, shingle=5, similarity=0.8).collect()) == stay(rows)


def test_postings_that_chain_all_texts_compare_few_pairs(spark):
    """5,000 texts, each posting of 71 shares a member with the next: linear, not all pairs."""
    members = [(p, 70 * p + i, 70 * p + i, 71) for p in range(71) for i in range(71)]
    again = [(1000 + s, *rest) for s, *rest in members]  # the same members under another shingle
    units = L.block_units(spark.createDataFrame(members + again, "s long, node long, root long, k long"))
    sizes = units.groupBy("unit").pivot("side", [0, 1]).count().na.fill(0).collect()
    pairs = sum(r["0"] * r["1"] or r["0"] * (r["0"] - 1) // 2 for r in sizes)
    assert pairs == 71 * 71 * 70 // 2


def test_shingles_of_one_text_alone_come_first_and_are_no_postings(spark):
    """400 texts that share four passages pairwise rarely: their own words fill the prefixes."""
    rng = random.Random(5)
    shared = [" ".join(f"s{k}x{j}" for j in range(5)) for k in range(120)]
    rows = [(i, " ".join([f"o{i}x{j}" for j in range(80)] + [shared[rng.randrange(120)] for _ in range(4)])) for i in range(400)]
    rows += [(400, " ".join(shared[:9])), (401, " ".join(shared[:9]) + " more")]
    sets = L.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5).cache()
    node = {r.id: r.node for r in sets.collect()}
    assert {r.node for r in L._postings(sets, 0.8).collect()} == {node[400], node[401]}


def test_shared_postings_compare_a_pair_once():
    a, b = np.arange(10), np.arange(1, 10)
    rows = [(0, n, n, np.array([3, 8]), x) for n, x in ((5, a), (6, b))]
    assert [x.tolist() for x in L._compared(3, rows, 0.8)] == [[5], [6]]
    assert [x.tolist() for x in L._compared(8, rows, 0.8)] == [[], []]


def test_nulls_empty_and_repeated_rows(docs, rows, none):
    kept = drop_near_duplicates(docs, shingle=5, similarity=0.8)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == stay([r[:2] for r in rows if r[0] is not None])
    assert kept.where("doc_id is null").count() == 1
    assert drop_near_duplicates(none, shingle=5, similarity=0.8).collect() == []
