import uuid

import corpus_pipeline as P
from fernweave.llm import quality as Q
from fernweave.llm.mixing import mix_sources
from tests.llm.test_counts_and_scans import brute
from tests.llm.test_similar import stay


def test_stages_on_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before, seen = docs.columns, docs, {}
    for name, stage in P.STAGES:
        stage(spark, before, sf).write.parquet(path := f"file://{tmp_path}/{uuid.uuid4().hex}")
        seen[name] = (before, before := spark.read.parquet(path))
    assert list(seen) == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    assert all(after.columns == columns for name, (_, after) in seen.items() if name != "sharding")
    rows = {name: ({r.doc_id: r for r in a.collect()}, {r.doc_id: r for r in b.collect()}) for name, (a, b) in seen.items()}

    had, kept = rows["quality classifier"]
    ranking = Q.learn_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(kept) == {r.doc_id for r in Q.quality_scores(docs, ranking).collect() if r.predicted}
    assert 0 < len(kept) < len(had)

    had, kept = rows["SimHash near-dedup"]
    assert sorted(kept) == stay([(i, had[i].text) for i in sorted(had)])

    had, kept = rows["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {i for i, r in had.items() if brute(r.text, items)[1]}
    assert set(kept) == set(had) - hit

    before, after = seen["mixing sources to target weights"]
    drawn = mix_sources(before, max_repeat=P.MAX_REPEAT)
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in drawn.collect())

    before, after = seen["sharding"]
    found = after.collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in before.collect())
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_run_returns_the_last_stage(spark, sf):
    out = P.run(spark, sf)
    assert {"doc_id", "shard", "slot", "text_crc32"} <= set(out.columns) and out.count() > 0
