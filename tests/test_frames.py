"""Kernels over whole frames against loops over their pixels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernweave.operators import frames as X, pixels


def luma(frame):
    """Rows of limited-range luma as it is presented."""
    h, w = len(frame), len(frame[0])
    own = [[min(((66 * r + 129 * g + 25 * b + 128) >> 8) + 16, 235) for r, g, b in row] for row in frame]
    scale = min(320 / w, 180 / h, 1.0)
    if scale == 1.0:
        return own
    th, tw = (max(1, int(n * scale + 0.5)) for n in (h, w))
    out = []
    for y in range(th):
        sy = min(max((y + 0.5) * h / th - 0.5, 0), h - 1)
        row = []
        for x in range(tw):
            sx = min(max((x + 0.5) * w / tw - 0.5, 0), w - 1)
            y0, x0 = int(sy), int(sx)
            y1, x1, fy, fx = min(y0 + 1, h - 1), min(x0 + 1, w - 1), sy - y0, sx - x0
            top, low = (own[r][x0] * (1 - fx) + own[r][x1] * fx for r in (y0, y1))
            row.append(int(top * (1 - fy) + low * fy + 0.5))
        out.append(row)
    return out


def plain_banding(frame):
    v = luma(frame)
    h, w = len(v), len(v[0])
    at = lambda m, y, x: m[min(max(y, 0), len(m) - 1)][min(max(x, 0), len(m[0]) - 1)]
    image = [[at(v, y, x) + at(v, y, x + 1) + at(v, y + 1, x) + at(v, y + 1, x + 1) for x in range(w)] for y in range(h)]
    still = [[at(image, y, x + 1) == image[y][x] == at(image, y + 1, x) for x in range(w)] for y in range(h)]
    area, bits = max((w >> 6) * (h >> 6), 1), 0
    while 1 << bits < area:
        bits += 1
    least = max(int((49 + 3 * (bits - 11) - 1) / 2), 1)
    mask = [[sum(still[j][i] for j in range(max(y - 3, 0), min(y + 4, h)) for i in range(max(x - 3, 0), min(x + 4, w))) > least for x in range(w)] for y in range(h)]
    mode = lambda a, b, c: a if a in (b, c) else b if b == c else min(a, b, c)
    total = 0.0
    for weight in (16, 8, 4, 2, 1):
        h, w = len(image), len(image[0])
        image = [[mode(at(image, y, x - 1), image[y][x], at(image, y, x + 1)) for x in range(w)] for y in range(h)]
        image = [[mode(at(image, y - 1, x), image[y][x], at(image, y + 1, x)) for x in range(w)] for y in range(h)]
        values = []
        for y in range(h):
            for x in range(w):
                near = [image[j][i] - image[y][x] for j in range(max(y - 2, 0), min(y + 3, h)) for i in range(max(x - 2, 0), min(x + 3, w)) if mask[j][i]] if mask[y][x] else []
                best, same = 0.0, near.count(0)
                for d, limit in zip((1, 2, 3, 4), (178, 305, 432, 559), strict=True):
                    n = max(near.count(d), near.count(-d))
                    if n and image[y][x] <= limit:
                        best = max(best, d * same * n / (same + n))
                values.append(best)
        pool = max(len(values) * 3 // 5, 1)
        total += weight * sum(sorted(values, reverse=True)[:pool]) / pool / 25
        image, mask = ([row[::2] for row in m[::2]] for m in (image, mask))
    return total / 31


def some_frame(rng, w, h, step):
    return [[tuple(min(255, 30 + (x // step) * 2 + (y // 7) + k + (rng.randrange(3) if rng.random() < 0.02 else 0)) for k in range(3)) for x in range(w)] for y in range(h)]


@pytest.mark.parametrize(("w", "h"), [(1, 1), (7, 5), (40, 23), (64, 64), (330, 12), (9, 190), (130, 70)])
def test_banding_of_a_frame_is_that_of_loops(w, h):
    rng = random.Random(w)
    for step in (3, 9):
        frame = some_frame(rng, w, h, step)
        assert X.frame_banding(np.array(frame)) == pytest.approx(plain_banding(frame), abs=1e-12)
    if w >= 40 and h >= 20:
        assert X.frame_banding(np.array(some_frame(rng, w, h, 9))) > 0 == X.frame_banding(np.full((h, w, 3), 77))


def test_banding_of_clips_looks_at_evenly_chosen_frames(spark):
    rng = random.Random(1)
    clips = {(c, f): some_frame(rng, 24, 16, 3 + f % 5) for c, n in ((1, 1), (2, 12), (3, 30)) for f in range(n)}
    rows = [(c, f, y, x, *p) for (c, f), frame in clips.items() for y, row in enumerate(frame) for x, p in enumerate(row)]
    df = spark.createDataFrame(rows, "clip int, frame int, y int, x int, r int, g int, b int").repartition(5)
    got = {r.clip: (r.frames, r.banding) for r in X.banding(df, *map(F.col, "rgb")).collect()}
    for c, n in ((1, 1), (2, 12), (3, 30)):
        own = [plain_banding(clips[c, i * n // min(n, 12)]) for i in range(min(n, 12))]
        assert got[c] == (len(own), pytest.approx(sum(own) / len(own), abs=1e-12))


def test_spatial_sums_of_large_frames_with_holes(spark):
    """Against loops: neighbours count where both pixels are there."""
    rng = random.Random(6)
    for w, h in ((70, 66), (1, 9), (5, 1)):
        there = {(y, x): tuple(rng.choice((rng.randrange(256), 120, 128)) for _ in range(3)) for y in range(h) for x in range(w) if rng.random() < 0.97 or (y, x) == (h - 1, w - 1)}
        rgb, mask = np.zeros((h, w, 3), dtype=np.int64), np.zeros((h, w), dtype=bool)
        for (y, x), c in there.items():
            rgb[y, x], mask[y, x] = c, True
        got = dict(zip([f.split()[0] for f in X.SPATIAL.split(", ")], X.spatial_sums(rgb, mask, pixels.EDGE, pixels.SMOOTH), strict=True))
        l = {p: (54 * c[0] + 183 * c[1] + 19 * c[2]) >> 8 for p, c in there.items()}  # noqa: E741
        near = {(y, x): [q for q in ((y, x + 1), (y + 1, x)) if q in there] for y, x in there}
        grad = {p: sum(abs(l[p] - l[q]) for q in qs) // len(qs) for p, qs in near.items() if qs}
        inner = [p for p in there if all((p[0] + a, p[1] + b) in there for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
        bend = sum(abs(4 * l[y, x] - l[y, x + 1] - l[y, x - 1] - l[y + 1, x] - l[y - 1, x]) for y, x in inner)
        smooth = sum(1 <= max(abs(a - b) for a, b in zip(there[p], there[q], strict=True)) <= pixels.SMOOTH for p, qs in near.items() for q in qs)
        mid = [p for p in there if w // 4 <= p[1] < w - w // 4 and h // 4 <= p[0] < h - h // 4]
        want = {"pixels": len(there), "colours": len({tuple(v >> 4 for v in c) for c in there.values()}), "n_c": len(mid), "l_c": sum(l[p] for p in mid), "n_g": len(grad), "s_g": sum(grad.values()), "n_edge": sum(g >= pixels.EDGE for g in grad.values()), "ng_c": sum(p in grad for p in mid), "g_c": sum(grad.get(p, 0) for p in mid), "n_smooth": smooth, "n_steps": sum(map(len, near.values())), "s_lap": bend, "n_lap": len(inner)}
        assert {k: got[k] for k in want} == want


def plain_reuse(pixels, w, h, threshold):
    """pixels: place to colour; in reading order, against the original neighbours and the new ones before."""
    apart = lambda a, b: max(abs(p - q) for p, q in zip(a, b, strict=True))
    out = dict(pixels)
    for y in range(h):
        for x in range(w):
            around = [(y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)]
            if (y, x) not in pixels or any(n not in pixels or apart(pixels[n], pixels[y, x]) > 24 for n in around):
                continue
            own = pixels[y, x]
            near = [out[n] for n in (around[0], around[2]) if 0 < apart(out[n], own) <= threshold]
            if near:
                out[y, x] = min(near, key=lambda c: apart(c, own))
    return out


def test_reuse_is_that_of_a_loop(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for frame, (w, h, threshold_like) in enumerate(((1, 1, 0), (3, 3, 2), (31, 17, 3), (16, 40, 8), (64, 64, 14))):
        there = {(y, x): tuple(100 + rng.randrange(threshold_like + 1) + (60 if rng.random() < 0.01 else 0) for _ in range(3)) for y in range(h) for x in range(w) if rng.random() < 0.99 or (y, x) == (h - 1, w - 1)}
        rows += [(0, frame, y, x, *c) for (y, x), c in there.items()]
        want[frame] = (there, plain_reuse(there, w, h, 5))
    df = spark.createDataFrame(rows, "clip int, frame int, y int, x int, r int, g int, b int").repartition(5)
    got = X.reused_colours(X.packed(df, *map(F.col, "rgb")), 5).collect()
    assert len(got) == len(want)
    for r in got:
        before, after = want[r.frame]
        assert r.changed == sum(before[k] != after[k] for k in before)
        assert r.rgb == [after[k][0] << 16 | after[k][1] << 8 | after[k][2] for k in sorted(after)]
    assert sum(r.changed for r in got) > 100


def test_levels_of_all_neighbours_are_counted_at_once(monkeypatch):
    """No shifted copies for each of 25 neighbours; the counts of a plain loop."""
    monkeypatch.setattr(X, "_shifted", None)
    rng = np.random.default_rng(2)
    for shape in ((9, 7), (1, 4), (16, 16)):
        image, flat = rng.integers(400, 408, shape), rng.random(shape) < 0.7
        values = []
        for y, x in np.ndindex(shape):
            near = [int(image[j, i] - image[y, x]) for j in range(max(y - 2, 0), min(y + 3, shape[0])) for i in range(max(x - 2, 0), min(x + 3, shape[1])) if flat[j, i]]
            same, n = near.count(0), [max(near.count(-k), near.count(k)) for k in range(1, 5)]
            seen = [k for k in range(1, 5) if n[k - 1] and image[y, x] <= X.VISIBLE[k - 1] and flat[y, x]]
            values.append(max((k * same * n[k - 1] / (same + n[k - 1]) for k in seen), default=0.0))
        pooled = max(len(values) * 3 // 5, 1)
        assert abs(X._steps(image, flat) - sum(sorted(values)[::-1][:pooled]) / pooled / 25) < 1e-12


def test_a_pixel_crosses_the_shuffle_as_one_number(spark):
    """The largest places, channels beyond 255 and none at all; a missing frame has no row."""
    rows = [(1, 0, 0, 65_535, 255, 0, 7), (1, 0, 2, 0, 40_000, 3, 0), (1, 1, 40_000, 1, 0, 0, 0), (2, 0, 1, 1, 1, 2, 300)]
    df = spark.createDataFrame(rows, "clip long, frame int, y int, x int, r int, g int, b int")
    found = X.packed(df, *map(F.col, "rgb"))
    got = {(r.clip, r.frame): (r.width, r.height, sorted(zip(r.at, r.rgb, strict=True))) for r in found.collect()}
    wide = (40_000 << 16 | 3 << 8) - (1 << 32)  # as a 32-bit number
    assert got == {(1, 0): (65_536, 3, [(65_535, 255 << 16 | 7), (131_072, wide)]), (1, 1): (2, 40_001, [(80_001, 0)]), (2, 0): (2, 2, [(3, 1 << 16 | 2 << 8 | 300)])}
    assert "struct" not in found._jdf.queryExecution().analyzed().toString() and found.schema["rgb"].dataType.simpleString() == "array<int>"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(_p" in plan
