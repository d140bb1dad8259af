"""Every rule of corpus manifests is broken somewhere in the query; a sound one breaks none."""

from fernweave.operators import manifests as N
from fernweave.plans.catalogue import QUERIES

HASH = "0e" * 32


def test_sound_and_empty(spark):
    schemas = (
        "manifest int, version int, status string, min_total int, min_per_category int, scope string, memory_coverage double, p95_ms long, max_ms long, p95_bytes long, max_bytes long",
        "manifest int, id string, category string, tags array<string>, file string, sha256 string, duration_s double, generator string, input string, source_sha256 string, rights string, pixel_format string",
        "manifest int, kind string, name string",
        "manifest int, place int, id string, mode string, width int, fps int, colours int, encoder string, experimental boolean, target_id string, target_constraint string, target_scale double",
    )
    sound = (
        [(1, 1, "complete", 1, 1, "stable_profiles", 1.0, 1, 1, 1, 1)],
        [(1, "f_1", "x", ["t", "u"], "a/b.mkv", HASH, 30.0, "external", "in/a", HASH, "own", "rgb24")],
        [(1, "category", "x"), (1, "tag", "u")],
        [(1, 0, "a", "best_gif", 32, 60, 2, "gif", False, None, None, None), (1, 1, "b", "target_size", 3840, 1, 256, "gif", True, "a", None, None), (1, 2, "c", "target_size", 99, 1, 9, "gif", True, "a", "hard_cap", 0.25)],
    )
    found = lambda rows: sorted((r.rule, r.detail) for r in N.manifest_violations(*[spark.createDataFrame(r, s) for r, s in zip(rows, schemas, strict=True)]).collect())
    assert found(sound) == [] and found([[], [], [], []]) == []
    assert found([sound[0], [], sound[2], []]) == [("budget.profiles", "1"), ("coverage.category", "x"), ("coverage.tag", "u"), ("coverage.total", "1"), ("no fixtures", "1"), ("no profiles", "1")]
    null = (1, None, None, None, None, None, None, None, None, None, None, None)
    profile = {r for r, _ in found([sound[0], sound[1], sound[2], [*sound[3], null]])}
    assert profile == {f"profile.{n}" for n in ("id", "mode", "width", "fps", "colours", "encoder")}


def test_every_rule_fires(spark, sf):
    rules = {r.rule for r in QUERIES["corpus_violations"](spark, sf).select("rule").distinct().collect()}
    assert {r.split(".")[0] for r in rules} == {"version", "status", "complete without hashes", "coverage", "budget", "fixture", "profile", "target"}
    assert {"target.later", "target.missing", "target.mode", "target.scale", "target.symmetric_scale", "target.unasked", "target.constraint"} <= rules
