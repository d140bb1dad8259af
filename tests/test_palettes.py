"""Palettes against plain loops."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from fernweave.functions.scalar import TO_LAB, TO_LMS
from fernweave.operators import palettes as P
from fernweave.operators.clusters import weighted_kmeans
from fernweave.plans.palettes import COLOURS, segment_palettes
from fernweave.plans.frames import _pixels


def lab(rgb):
    light = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in rgb]
    cone = [math.cbrt(sum(k * c for k, c in zip(row, light, strict=True))) for row in TO_LMS]
    return np.array([sum(k * c for k, c in zip(row, cone, strict=True)) for row in TO_LAB])


def srgb(v):
    cone = np.linalg.solve(np.array(TO_LAB), v) ** 3
    light = np.linalg.solve(np.array(TO_LMS), cone)
    channel = [12.92 * x if x <= 0.0031308 else 1.055 * max(x, 0) ** (1 / 2.4) - 0.055 for x in light]
    return tuple(math.floor(min(max(c, 0), 1) * 255 + 0.5) for c in channel)


def test_choices_from_buckets_are_those_of_all_entries(spark):
    """Palettes of 256 scattered, of 40 crowded and of one entry; few colours meet all entries."""
    rng = random.Random(4)
    sizes = {"many": [tuple(rng.randrange(256) for _ in range(3)) for _ in range(256)], "crowd": [(120 + rng.randrange(5), 120 + rng.randrange(5), 120) for _ in range(40)], "one": [(1, 2, 3)], None: [(9, 9, 9), (9, 9, 9), (200, 0, 0)]}
    palette = [(k, i, *c) for k, cs in sizes.items() for i, c in enumerate(cs)]
    colours = [(k, *(rng.randrange(256) for _ in range(3))) for k in sizes for _ in range(400)] + [("crowd", 121, 122, 120), (None, 9, 9, 9)]
    known = spark.createDataFrame(palette, "k string, entry int, r int, g int, b int")
    got = P.palette_choices(spark.createDataFrame(colours + colours[:9], "k string, r int, g int, b int"), known, ["k"]).collect()
    assert len(got) == len(set(colours))
    labs = {k: np.array([lab(c) for c in cs]) for k, cs in sizes.items()}
    for r in got:
        own, entries = lab((r.r, r.g, r.b)), labs[r.k]
        d = ((entries - own) ** 2).sum(axis=1)
        order = sorted(range(len(d)), key=lambda i: (round(d[i], 13), i))
        n, s = order[0], order[1] if len(order) > 1 else order[0]
        assert (r.nearest, r.second) == (n, s), (r, d[[n, s, r.nearest, r.second]])
        way = entries[s] - entries[n]
        share = 0.0 if way @ way <= 2.3e-16 else min(max((own - entries[n]) @ way / (way @ way), 0), 0.5)
        assert abs(r.share - share) < 1e-7
    many = [r.bucketed for r in got if r.k == "many"]
    assert 0.5 < sum(many) / len(many) and not all(r.bucketed for r in got)


def plain_fit(points, k, fixed=()):
    """points: (lab, weight) in the order of bins."""
    x, w = np.array([p for p, _ in points]), np.array([v for _, v in points])
    centres, left = [np.array(f) for f in fixed][:k], list(range(len(x)))
    if not fixed and k >= len(x):
        return list(x)
    while len(centres) < min(k, len(x) + len(fixed)):
        far = lambda i: w[i] * min(((x[i] - c) ** 2).sum() for c in centres) if centres else w[i]
        best = max(left, key=lambda i: (far(i), -i))
        left.remove(best)
        centres.append(x[best])
    if len(centres) <= len(fixed):
        return centres
    for _ in range(P.STEPS):
        at = [int(np.argmin([((p - c) ** 2).sum() for c in centres])) for p in x]
        moved = 0.0
        for i in range(len(fixed), len(centres)):
            own = [j for j, a in enumerate(at) if a == i]
            if own:
                new = (x[own] * w[own, None]).sum(axis=0) / w[own].sum()
                moved = max(moved, ((new - centres[i]) ** 2).sum())
                centres[i] = new
        if moved <= P.STILL:
            break
    return centres


def bins(pixels):
    held = {}
    for r, g, b, w in pixels:
        s = held.setdefault((r >> 3) << 10 | (g >> 3) << 5 | b >> 3, np.zeros(4))
        s += np.array([r * w, g * w, b * w, w])
    return [(lab(s[:3] / s[3]), s[3]) for _, s in sorted(held.items())]


def distance(x, y):
    return math.dist(lab(x), lab(y))


def plain_palettes(pixels, k):
    """(clip, segment) to (sorted colours, anchors)."""
    by, out = {}, {}
    for c, s, *p in pixels:
        by.setdefault(c, {}).setdefault(s, []).append(p)
    for c, segments in by.items():
        emit = lambda points, fixed=(): sorted(set(map(srgb, plain_fit(points, k, fixed))))
        alone = {s: emit(bins(p)) for s, p in segments.items()}
        anchors = []
        if len(segments) > 1:
            near = [(col, [min(distance(col, x) for x in a) for a in alone.values()]) for col in emit(bins([p for ps in segments.values() for p in ps]))]
            for _, _, col in sorted((max(d), sum(d), col) for col, d in near if max(d) <= 0.05):
                if len(anchors) < min(8, k // 12) and all(distance(col, a) >= 0.025 for a in anchors):
                    anchors.append(col)
        for s, p in segments.items():
            out[c, s] = (emit(bins(p), [lab(a) for a in sorted(anchors)]) if anchors else alone[s], len(anchors))
    return out


def test_palettes_of_segments_are_those_of_a_loop(spark, sf):
    pixels = [(r.clip, r.frame // 8, r.r, r.g, r.b, r.delay) for r in _pixels(spark, sf).collect()]
    want = plain_palettes(pixels, COLOURS)
    got = {(r.clip, r.segment): r for r in segment_palettes(spark, sf).collect()}
    assert got.keys() == want.keys() and any(n for _, n in want.values())
    for key, (colours, anchors) in want.items():
        assert got[key].colours == ",".join("%02x%02x%02x" % c for c in colours) and got[key].anchors == anchors
        rgba = b"".join(bytes([*c, 255]) for c in [*colours, *[colours[-1]] * (256 - len(colours))])
        assert got[key].sha256 == hashlib.sha256(rgba).hexdigest()


def test_no_step_of_a_fit_passes_the_driver(spark, monkeypatch):
    """Models take their steps inside tasks: one aggregation, no table of centres a step."""
    def no(*_):
        raise AssertionError("a table of each step's centres")

    monkeypatch.setattr(P, "written", no)
    rng = np.random.default_rng(3)
    rows = [(m, *map(int, rng.integers(0, 256, 3))) for m in "ab" for _ in range(200)]
    pixels = spark.createDataFrame(rows, "k string, r int, g int, b int")
    models = {r.k: r for r in P.fit_palettes(P.histogram(pixels, ["k"], F.lit(1)), ["k"], 5).collect()}
    for m in "ab":
        points = bins([(*p, 1) for k, *p in rows if k == m])
        assert np.allclose([[c[x] for x in P.LAB] for c in models[m].centres], plain_fit(points, 5), atol=1e-9)


def test_models_of_few_points_and_reserved_entries(spark):
    rows = [("few", 8, 8, 8), ("few", 240, 8, 8), ("one", 9, 9, 9), ("one", 9, 9, 9)]
    pixels = spark.createDataFrame(rows, "k string, r int, g int, b int")
    models = P.fit_palettes(P.histogram(pixels, ["k"], F.lit(1)), ["k"], 4)
    got = {r.k: r for r in P.emitted(models, ["k"], transparent=True).collect()}
    assert [tuple(c) for c in got["few"].colours] == [(8, 8, 8), (240, 8, 8)] and len(got["one"].colours) == 1
    assert got["one"].sha256 == hashlib.sha256(bytes([9, 9, 9, 255]) * 255 + bytes(4)).hexdigest()
    assert P.fit_palettes(P.histogram(pixels.limit(0), ["k"], F.lit(1)), ["k"], 4).collect() == []


def test_weighted_kmeans_is_that_of_a_loop(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.3, (60, 64)) for c in (-2, 0, 3)])
    df = spark.createDataFrame([(i, [float(a) for a in v], float(1 + i % 3)) for i, v in enumerate(x)], "id long, v array<double>, w double").repartition(3)
    got = weighted_kmeans(df, 5)
    want = plain_fit([(v, 1 + i % 3) for i, v in enumerate(x)], 5)
    assert np.allclose(got, want, atol=1e-9)
