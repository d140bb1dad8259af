"""Gates by small cases: what passes, what each rule alone keeps from passing, empty tables."""

from pyspark.sql import functions as F

from fernweave.operators import gates as G

VOTES, EXPECTED = "reviewer string, pair string, outcome string", "pair string, category string, formal boolean"


def checks(spark, votes, expected):
    got = G.reviewer_gate(spark.createDataFrame(votes, VOTES), spark.createDataFrame(expected, EXPECTED)).collect()
    assert len({(r.check, r.category) for r in got}) == len(got)
    return {(r.check, r.category) for r in got if not r.passed}


def test_reviewer_gate(spark):
    expected = [("p", "x", True), ("q", "y", True), ("r", "z", False)]
    votes = [(who, pair, "win") for who in "abc" for pair in "pq"]
    assert checks(spark, votes, expected) == set()
    assert checks(spark, votes + [("a", "r", "loss"), (None, "p", "loss"), ("a", "p", "win")], expected) == set()
    assert checks(spark, votes[:-1], expected) == {("coverage", None), ("complete reviewers", None)}
    assert checks(spark, votes[:4], expected) == {("reviewers", None)}
    ties = [(w, p, "tie" if p == "q" else o) for w, p, o in votes]
    assert checks(spark, ties, expected) == {("category", "y")}
    lost = [(w, p, "loss" if p == "q" else o) for w, p, o in votes]
    assert checks(spark, lost, expected) == {("overall", None), ("category", "y")}
    assert checks(spark, [], expected) == {("reviewers", None), ("coverage", None), ("overall", None), ("category", "x"), ("category", "y")}
    assert checks(spark, [], []) == {("reviewers", None), ("coverage", None), ("overall", None)}


def violations(spark, sources, compared):
    metrics = ["vmaf_neg_mean", "edge_error"]
    slices = G.acceptance_slices(spark.createDataFrame(sources, "fixture int, category string"), spark.createDataFrame(compared, "fixture int, metric string, outcome string, improvement double, tie_units double, severe boolean"), metrics)
    return {(r.rule, r.category, r.metric) for r in G.acceptance_violations(slices).collect()}


def test_acceptance(spark):
    sources = [(i, f"c{i % 7}") for i in range(28)]
    compared = [(i, m, "win", 0.5, 1.0, False) for i in range(28) for m in ("vmaf_neg_mean", "edge_error")]
    assert violations(spark, sources, compared) == set()
    assert violations(spark, sources, compared[2:]) == {("coverage", None, None), ("category", "c0", None)}
    assert violations(spark, sources[:27], compared) == {("pairs", None, None)}
    few = [(i, f"c{i % 6}") for i in range(28)]
    assert violations(spark, few, compared) == {("categories", None, None)}
    severe = [(*compared[0][:5], True)] + compared[1:]
    assert violations(spark, sources, severe) == {("overall", None, "vmaf_neg_mean"), ("category", "c0", None)}
    weak = [(f, m, o, 0.49 if m == "vmaf_neg_mean" else x, u, s) for f, m, o, x, u, s in compared]
    assert violations(spark, sources, weak) == {("overall", None, "vmaf_neg_mean")}
    # A metric that only one category has passes there and, by its limits, overall.
    one = [r for r in compared if r[1] == "vmaf_neg_mean" or r[0] % 7 == 0]
    assert violations(spark, sources, one) == set()
    none = [r for r in compared if r[1] == "vmaf_neg_mean"]
    assert violations(spark, sources, none) == {("overall", None, "edge_error")}
    assert {r for r, _, _ in violations(spark, [], [])} == {"pairs", "coverage", "categories", "overall"}


SOUND = {
    "bundle": 1, "place": 0, "evidence_id": "ev-1", "policy_id": "wechat_sticker", "policy_revision": "1", "tested_at": "2026-06-30T23:59:59.999Z", "name": "app", "version": "1", "os_version": "11",
    "platform": "ios", "artifact_sha256": "0f" * 32, "format": "gif", "width": 240.0, "height": 240.0, "fps": 12.0, "duration_s": 3.0, "size_bytes": 503316.0,
} | dict.fromkeys(G.LIFECYCLE, True)
CASES = [
    ("evidence_id", "Ev", {"invalid_evidence_id"}), ("policy_id", "other", {"unknown_policy_id", "policy_revision_mismatch"}), ("policy_revision", None, {"policy_revision_mismatch"}),
    ("tested_at", "2026-06-31T00:00:00Z", {"invalid_iso_date"}), ("tested_at", "2026-07-01T00:00:00.001Z", {"future_date"}), ("tested_at", "2026-01-01T23:59:59Z", {"evidence_expired"}),
    ("name", "", {"invalid_string"}), ("platform", "dos", {"invalid_platform"}), ("artifact_sha256", "0F" * 32, {"invalid_sha256"}), ("format", "webp", {"format_outside_policy"}),
    ("format", "bmp", {"format_outside_policy", "invalid_format"}), ("width", 241.0, {"width_exceeds_policy"}), ("width", 237.0, {"aspect_outside_policy"}), ("height", 240.5, {"invalid_positive_integer"}),
    ("fps", 12.5, {"fps_exceeds_policy"}), ("fps", float("inf"), {"invalid_positive_number", "fps_exceeds_policy"}), ("duration_s", 3.1, {"duration_exceeds_policy"}), ("duration_s", 0.0, {"invalid_positive_number"}),
    ("size_bytes", 503317.0, {"size_exceeds_policy"}), ("size_bytes", None, {"invalid_positive_integer"}), ("forward", False, {"lifecycle_incomplete"}),
]


def test_evidence(spark):
    rows = [SOUND, SOUND | {"bundle": 99}, SOUND | {"bundle": 99, "place": 1}] + [SOUND | {"bundle": i, field: value} for i, (field, value, _) in enumerate(CASES, 2)]
    types = {"bundle": "int", "place": "int"} | dict.fromkeys(("width", "height", "fps", "duration_s", "size_bytes"), "double") | dict.fromkeys(G.LIFECYCLE, "boolean")
    schema = ", ".join(f"{n} {types.get(n, 'string')}" for n in SOUND)
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    now = F.lit("2026-07-01T00:00:00Z").cast("timestamp")
    got = {}
    for r in G.evidence_errors(frame, now).collect():
        got.setdefault(r.bundle, set()).add((r.place, r.code))
    assert got == {i: {(0, c) for c in codes} for i, (_, _, codes) in enumerate(CASES, 2)} | {99: {(1, "duplicate_evidence_id")}}
    assert G.evidence_errors(frame.limit(0), now).count() == 0
