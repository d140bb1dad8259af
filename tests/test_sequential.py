"""Operators without an SQL form, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from fernweave.functions import media as M
from fernweave.operators import edits as E, pixels as X, schedule as C, search as R
from fernweave.functions import quantiles
from fernweave.operators import history
from fernweave.operators.history import history_state
from fernweave.plans import editing
from fernweave.sources import documents as SD, reports as SR

FRAMES = "clip long, frame int, duration_us long, excluded boolean, motion double, changed_area double, scene_change double, importance double"


def some_frames(seed, n):
    rng = random.Random(seed)
    return [(seed, i, rng.choice([30_000, 50_000, 90_000]), rng.random() < 0.15, rng.choice([0.0, 0.002, 0.03]), rng.choice([0.0, 0.002, 0.05, 0.2]), rng.choice([0.0, 0.01, 0.6]) if rng.random() < 0.2 else 0.0, rng.random()) for i in range(n)]


def spikes(rows):
    out = []
    for i, r in enumerate(rows):
        near = sorted(rows[j][5] for j in range(max(0, i - 2), min(len(rows), i + 3)) if j not in (0, i) and not rows[j][3])
        if i == 0 or r[3] or not near or not 0.004 <= r[5] <= 0.08:
            out.append(False)
            continue
        m = len(near) // 2
        base = near[m] if len(near) % 2 else (near[m - 1] + near[m]) / 2
        out.append(r[5] - base >= 0.003 and r[5] >= base * 3)
    return out


def schedule(rows, ratio=0.7):
    kept, free, spike = set(), [i for i, r in enumerate(rows) if not r[3]], spikes(rows)
    if not free:
        return kept
    kept |= {free[0], free[-1]} | {i for i in free if rows[i][6] >= 0.42}
    held, seen = 0, False
    for i, r in enumerate(rows):
        if i in kept:
            held, seen = 0, False
            continue
        held += r[2]
        if r[3]:
            continue
        seen = seen or r[4] >= 0.0005 or r[5] >= 0.001 or r[6] >= 0.001
        if spike[i] or (seen and held >= 160_000):
            kept.add(i)
            held, seen = 0, False
    target = max(-(-len(free) * 7 // 10), len(kept))
    while len(kept) < target:
        best = None
        for i in free:
            if i in kept:
                continue
            r, gap = rows[i], min(abs(i - k) for k in kept) / len(rows)
            score = r[7] + gap * 0.35
            rescue = (r[4] > 0.001 or r[5] > 0.001 or r[6] > 0.001) and gap >= 0.08
            normal = r[4] > 0.004 or r[5] > 0.008
            if (rescue or (normal and score >= 0.05)) and (best is None or score > best[0]):
                best = (score, i)
        if best is None:
            break
        kept.add(best[1])
    return kept


def test_kept_frames(spark):
    clips = {s: some_frames(s, n) for s, n in ((1, 1), (2, 2), (3, 30), (4, 60), (5, 7))}
    clips[6] = [(6, i, 10_000, True, 0.1, 0.1, 0.1, 0.5) for i in range(3)]
    df = spark.createDataFrame([r for c in clips.values() for r in c], FRAMES)
    for parts in (1, 5):
        got = {}
        for r in C.keep_frames(df.repartition(parts)).collect():
            got.setdefault(r.clip, set()).update({r.frame} if r.kept else set())
        assert got == {s: schedule(rows) for s, rows in clips.items()}
    assert C.keep_frames(df.limit(0)).collect() == []


def test_simplified_keyframes(spark):
    def simple(p, a, b):
        far, at = 0.0, None
        for i in range(a + 1, b):
            line = p[a][1] + (p[b][1] - p[a][1]) * (p[i][0] - p[a][0]) / (p[b][0] - p[a][0])
            d = abs(p[i][1] - line) + max(0.55 - p[i][2], 0) * 4
            if d > far:
                far, at = d, i
        return set() if at is None or far <= 0.7 else {at} | simple(p, a, at) | simple(p, at, b)

    def capped(p, kept, most):
        """kept places, at most `most` of them."""
        kept = sorted(kept)
        if len(kept) <= most:
            return set(kept)
        chosen = {0, len(kept) - 1}
        for i in sorted((i for i in range(1, len(kept) - 1) if p[kept[i]][2] < 0.55), key=lambda i: p[kept[i]][2]):
            if len(chosen) < max(2, most):
                chosen.add(i)
        rest = [i for i in range(len(kept)) if i not in chosen]
        slots = max(2, most) - len(chosen)
        return {kept[i] for i in chosen | {rest[min(len(rest) - 1, max(0, int((s + 1) * (len(rest) + 1) / (slots + 1) + 0.5) - 1))] for s in range(slots)}}

    rng = random.Random(3)
    tracks = {k: [(float(t), rng.random() * 4, rng.choice([0.2, 0.5, 0.9])) for t in range(n)] for k, n in ((1, 1), (2, 2), (3, 40), (4, 90))}
    rows = [(k, *p) for k, v in tracks.items() for p in v]
    df = spark.createDataFrame(rows, "track int, t double, x double, confidence double").repartition(3)
    for most, gap in ((None, 12), (28, 1000), (20, 1000), (2, 1000)):
        got = {}
        for r in C.simplified_keyframes(df, "track", "t", ["x"], "confidence", most=most, gap=gap).collect():
            got.setdefault(r.track, set()).add(int(r.t))
        want = {k: {0, len(v) - 1} | simple(v, 0, len(v) - 1) for k, v in tracks.items()}
        assert got == (want if most is None else {k: capped(tracks[k], v, most) for k, v in want.items()})


def test_held_colours(spark):
    rng = random.Random(9)
    rows = [(0, f, 0, x, 100 + rng.randrange(4), 100 + rng.randrange(3), 3) for x in range(6) for f in range(12)]
    df = spark.createDataFrame(rows, "clip int, frame int, y int, x int, own int, src int, delay int").repartition(4)
    got = {(r.frame, r.x): r.held for r in X.held_colours(df, "own", "src", "delay", 1).collect()}
    want = {}
    for x in range(6):
        held = prior = anchor = None
        n = t = 0
        for _, f, _, _, own, src, delay in sorted(r for r in rows if r[3] == x):
            if held is not None and abs(src - prior) <= 1 and abs(src - anchor) <= 1 and abs(held - src) <= abs(own - src) and n < 2 and t + delay <= 16:
                n, t = n + 1, t + delay
            else:
                held, anchor, n, t = own, src, 0, 0
            prior = src
            want[f, x] = held
    assert got == want


def plain_history(log, depth):
    past, now, ahead = [], None, []
    for _, action, revision in sorted(log):
        if action == "commit":
            past, now, ahead = [*past, *([] if now is None else [now])][-depth:], revision, []
        elif action == "undo" and past:
            ahead, now = [*ahead, now], past.pop()
        elif action == "redo" and ahead:
            past, now = [*past, now][-depth:], ahead.pop()
    return now, len(past), len(ahead)


def test_history(spark):
    log = [(1, i, a, r) for i, (a, r) in enumerate([("undo", 0), ("commit", 1), ("commit", 2), ("undo", 0), ("redo", 0), ("undo", 0), ("commit", 3), ("redo", 0)])]
    log += [(2, i, "commit", i) for i in range(9)] + [(3, 0, "undo", 0)]
    df = spark.createDataFrame(log, "project int, seq int, action string, revision int").repartition(3)
    assert sorted(map(tuple, history_state(df, depth=4).collect())) == [(1, 3, 1, 0), (2, 8, 4, 0), (3, None, 0, 0)]


@pytest.mark.parametrize(("depth", "stretch"), [(100, 40), (3, 10), (7, 500), (100, 1 << 14)])
def test_history_by_any_stretches_is_that_of_a_fold(spark, depth, stretch):
    rng, log = random.Random(depth), []
    for project in (*range(5), None):
        kinds = rng.choice((("commit", "undo", "redo"), ("commit", "commit", "undo"), ("undo", "undo", "redo", "commit")))
        log += [(project, i, rng.choice(kinds) if i else "undo", 1000 * i) for i in range(rng.choice((1, 30, 700, 1500)))]
    df = spark.createDataFrame(log, "project int, seq int, action string, revision int").repartition(3)
    got = {r.project: tuple(r)[1:] for r in history_state(df, depth, stretch).collect()}
    assert got == {p: plain_history([x[1:] for x in log if x[0] == p], depth) for p in {x[0] for x in log}}


def test_many_short_logs_meet_in_batches(spark, monkeypatch):
    """No call of Python a project where logs are short, and no bounds of logs that are not cut."""
    measured = []
    monkeypatch.setattr(history, "measured", lambda held, *more: measured.append(held.count()) or quantiles.measured(held, *more))
    log = [(p, i, ("commit", "commit", "undo", "redo", "undo")[(p + i) % 5], 10 * p + i) for p in range(300) for i in range(p % 9 + 1)]
    log += [(-1, i, "commit" if i % 3 else "undo", i) for i in range(60)] + [(7, 99, "commit", None)]
    df = spark.createDataFrame(log, "project int, seq int, action string, revision int").repartition(3)
    got = {r.project: tuple(r)[1:] for r in history_state(df, 4, 50).collect()}
    assert measured == [60]
    assert got == {p: plain_history(sorted(x[1:] for x in log if x[0] == p), 4) for p in {x[0] for x in log}}


def test_edits_of_frames_do_not_hold_their_sorts_at_once(spark, sf, monkeypatch):
    """Every written step has a few sorts, and the last one only joins totals."""
    plans, real = [], editing.written
    monkeypatch.setattr(editing, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    plans.append(editing.frame_edits(spark, sf)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 5 and plans[-1].count("Sort [") <= 4 and max(p.count("Sort [") for p in plans) <= 16


def test_split_near_an_end_holds_the_shorter_part(spark):
    clips = spark.createDataFrame([(1, 0, "a", 100, 103, 0.001, False, 0, None)], "project int, pos int, id string, in_us long, out_us long, rate double, reverse boolean, hold_us long, duration_us long")
    cut = E.split_clips(clips, spark.createDataFrame([(1, 10)], "project int, at_us long"))
    assert sorted((r.id, r.in_us, r.out_us, r.hold_us, r.duration_us) for r in cut.collect()) == [("a", 100, 100, 10, None), ("a:b", 100, 103, 0, 2990)]
    assert E.timeline(cut).agg(F.max("end_us")).first()[0] == 3000
    same = E.split_clips(clips, spark.createDataFrame([(1, 3000)], "project int, at_us long"))
    assert same.count() == 1


def test_anchor_colours_are_apart(spark):
    colours = [(1, 10 * i, 5 * i, 250 - 8 * i) for i in range(25)]
    palette = spark.createDataFrame(colours, "key int, r int, g int, b int")
    others = palette.withColumn("segment", F.explode(F.array(F.lit(0), F.lit(1))))
    found = R.separated_colours(R.shared_colours(palette, others))
    assert 2 <= found.count() <= R.ANCHORS


def test_search_without_a_next_candidate(spark):
    obs = spark.createDataFrame([(1, 0, 100, 640, 96, 1, 3, 5, 500), (2, 0, 100, 640, 640, 10, 128, 2, 50)], "search int, seq int, target long, base_width int, width int, fps int, colours int, bayer int, size long")
    assert {r.search: r.step for r in R.next_candidates(obs).collect()} == {1: None, 2: None}


def test_empty_and_null_rows(spark):
    none = spark.createDataFrame([], "clip long, frame int, y int, x int, r int, g int, b int")
    for f in (X.spatial_signals, X.scene_changes, X.change_boxes):
        assert f(none).collect() == []
    assert X.pair_metrics(none, none).collect() == []
    one = spark.createDataFrame([(1, 0, 0, 0, 255, 0, 0)], none.schema)
    s = X.spatial_signals(one).first()
    assert (s.pixels, s.edge_text, s.noise) == (1, 0.0, 0.0)
    assert X.pair_metrics(one, one).first().static_ratio == 1.0
    vals = spark.createDataFrame([(None,), ("permission denied",), ("ffmpeg not found",)], "t string").select(M.failure_category(F.col("t")))
    assert [r[0] for r in vals.collect()] == ["unknown", "permission", "dependency"]


def test_malformed_documents_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}\n{oops\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILED_READ"):
        SD.read_typed(spark, f"file://{tmp_path}/a.json", "x int").collect()
    snap = SD.read_snapshots(spark, f"file://{tmp_path}/a.json", "x int").first()
    assert snap.bytes == 15 and len(snap.sha256) == 64


def test_bundle_of_all_roles_is_sound(spark, tmp_path):
    for name in ("report.json", "report.csv", "build-provenance.json", "pages/a.html", "pages/b.gif", SR.OWN_MANIFEST):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    found = SR.bundle_entries(spark, str(tmp_path))
    assert sorted(r.role for r in found.collect()) == ["blind_asset", "blind_html", "build_provenance", "report_csv", "report_json"]
    assert SR.bundle_violations(found, found).collect() == []
    changed = found.withColumn("sha256", F.when(F.col("role") == "report_csv", "0").otherwise(F.col("sha256")))
    assert [tuple(r) for r in SR.bundle_violations(found, changed).collect()] == [("report.csv", "changed")]
