"""Project tables: every rule by one small case, nulls, and the sound project that breaks none."""

import re

from fernweave.operators import projects as P

SCHEMAS = {
    "projects": "project long, revision long, width int, height int, fps int, background string, max_bytes long",
    "assets": "project long, id string, path string, name string, kind string, width int, height int, duration_us long",
    "clips": "project long, id string, asset_id string, in_us long, out_us long, rate double, hold_us long, duration_us long, fit string",
    "layers": "project long, id string, kind string, start_us long, end_us long, asset_id string, width double, font_size double, stroke_width double, colour string, visible boolean",
    "keyframes": "project long, layer_id string, place int, time_us long",
}
SOUND = {
    "projects": (1, 0, 480, 480, 15, "#00aaFF", None),
    "assets": (1, "a", "C:/a.gif", "a.gif", "gif", 10, 10, 1000),
    "clips": (1, "c", "a", 0, 1000, 1.0, 0, None, "cover"),
    "layers": (1, "l", "media", 0, 500, "a", 0.3, None, None, None, True),
    "keyframes": (1, "l", 0, 0),
}
# Which field of the sound row takes which value, and the rules that it breaks.
CASES = [
    ("projects", 1, -1, {"project.revision"}), ("projects", 2, 95, {"canvas.width"}), ("projects", 3, None, {"canvas.height"}), ("projects", 4, 61, {"canvas.fps"}),
    ("projects", 5, "red", {"canvas.background"}), ("projects", 6, 1023, {"output.max_bytes"}),
    ("assets", 1, "b", {"clip.asset", "layer.asset"}), ("assets", 2, "\t", {"asset.path"}), ("assets", 4, "audio", {"asset.kind"}), ("assets", 5, 0, {"asset.size"}),
    ("assets", 7, -1, {"asset.duration", "clip.source"}), ("assets", 7, 999, {"clip.source"}), ("assets", 1, None, {"id.empty", "clip.asset", "layer.asset"}),
    ("clips", 1, "l", {"id.repeated"}), ("clips", 1, " ", {"id.empty"}), ("clips", 3, -1, {"clip.times"}), ("clips", 4, 0, {"clip.range", "clip.duration"}),
    ("clips", 5, 0.04, {"clip.rate"}), ("clips", 5, None, {"clip.rate", "clip.duration", "project.duration"}), ("clips", 6, 300_000_001, {"project.duration"}), ("clips", 8, None, {"clip.fit"}),
    ("layers", 2, "shape", {"layer.kind"}), ("layers", 2, "text", {"layer.text"}), ("layers", 4, 0, {"layer.times"}), ("layers", 6, 2.1, {"layer.width"}),
    ("keyframes", 3, 501, {"keyframe.time"}), ("keyframes", 2, 1, {"keyframe.order"}), ("keyframes", 1, "m", {"keyframe.time"}),
]


def frames(spark, rows):
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}


def test_every_rule_and_none(spark):
    """One project for each case, all at once; project 0 is sound."""
    rows = {name: [(0, *row[1:])] for name, row in SOUND.items()}
    want = {0: set()}
    for i, (name, place, value, rules) in enumerate(CASES, 1):
        for n, row in SOUND.items():
            new = [i, *row[1:]]
            if n == name:
                new[place] = value
            rows[n].append(tuple(new))
        want[i] = rules
    n = len(CASES) + 1
    rows["assets"] += [(n, f"a{i}", "x", "x", "gif", 1, 1, 9) for i in range(129)]
    rows["layers"] += [(n, f"l{i}", "media", 0, 500, "a0", 0.3, None, None, None, True) for i in range(65)]
    rows["clips"] += [(n, f"c{i}", "a0", 0, 9, 1.0, 0, None, "cover") for i in range(2049)]
    rows["keyframes"] += [(n, "l0", i, i) for i in range(129)]
    want[n] = {f"too many {name}" for name in P.LIMITS}
    got = {i: set() for i in want}
    for r in P.project_violations(**frames(spark, rows)).collect():
        got[r.project].add(r.rule)
    assert got == want


def test_empty_tables(spark):
    none = frames(spark, {name: [] for name in SCHEMAS})
    assert P.project_violations(**none).count() == 0 and P.used_assets(none["clips"], none["layers"]).count() == 0


def test_layers_and_files(spark):
    rows = {name: [row] for name, row in SOUND.items()} | {"keyframes": [(1, "l", 0, 0), (1, "l", 1, 400), (1, "gone", 0, 0)]}
    t = frames(spark, rows)
    patched = lambda **new: P.updated_layers(t["layers"], spark.createDataFrame([(1, "l", *new.values())], "project long, id string, " + ", ".join(f"{n} {'string' if n == 'kind' else 'long'}" for n in new)))
    assert [(r.kind, r.refused) for r in patched(kind="text").collect()] == [("media", "kind")]
    assert [(r.end_us, r.refused) for r in patched(start_us=600).collect()] == [(500, "times")]
    short = patched(end_us=399)
    assert [(r.end_us, r.refused) for r in short.collect()] == [(399, None)]
    assert [(r.layer_id, r.time_us) for r in P.kept_keyframes(t["keyframes"], short).collect()] == [("l", 0)]
    asked = spark.createDataFrame([(1, "a", " D:\\n\\b.PNG\t"), (1, "zz", "b.png"), (1, "a", None), (1, "a", "b.txt"), (1, "a", "png")], "project long, id string, path string")
    plans = P.replacement_plans(t["assets"], asked)
    assert sorted(str(r.reason) for r in plans.collect()) == ["None", "empty path", "unknown asset", "unsupported format", "unsupported format"]
    assert [(r.id, r.path, r.name, r.kind, r.width) for r in P.relinked_assets(t["assets"], plans).collect()] == [("a", "D:\\n\\b.PNG", "b.PNG", "image", None)]
    other = plans.withColumn("old_path", plans.new_path)
    assert [(r.path, r.width) for r in P.relinked_assets(t["assets"], other).collect()] == [("C:/a.gif", 10)]
    paths = spark.createDataFrame([(1, 0, "d:/n/B.png"), (1, 1, "c:\\A.gif"), (1, 2, "x")], "project long, place int, path string")
    assert sorted((r.place, r.path) for r in P.replaced_paths(paths, plans).collect()) == [(0, "d:/n/B.png"), (2, "x")]


def test_keyframes_are_dealt_out_once(spark):
    """One exchange of keyframes serves their order, their layers' lengths and their number."""
    rows = {name: [] for name in SCHEMAS} | {
        "layers": [(1, "l", "text", 0, 50, None, None, 9.0, 1.0, "#00ff00", True), (1, "l", "text", 0, 80, None, None, 9.0, 1.0, "#00ff00", True)],
        "keyframes": [(1, "l", 2, 30), (1, "l", 0, 0), (1, "l", 1, 30), (1, "l", 3, 81), (1, "l", 5, 82), (1, "x", 0, 0), (1, None, 0, 0), (None, "l", 0, 0), (1, "l", None, 40)],
    }
    found = P.project_violations(**frames(spark, rows))
    got = sorted(((r.project, r.rule, r.detail) for r in found.collect() if r.rule.startswith("keyframe")), key=str)
    late, order = [(1, "keyframe.time", "l")] * 2, [(1, "keyframe.order", "l")] * 3  # places 3 and 5; places 2, 5 and none
    assert got == sorted([*late, *order, (1, "keyframe.time", "x"), (1, "keyframe.time", None), (None, "keyframe.time", "l")], key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(project#\d+L?, layer_id", plan.split("Initial Plan")[0])) == 1
