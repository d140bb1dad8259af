"""Size searches, process trees and ranks against plain loops."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fernweave.functions import quantiles as Q
from fernweave.operators import aggregate as A, search as R, select as O
from fernweave.operators.presentation import presentations_equal
from fernweave.plans.judging import ATTEMPTS, TOLERANCE, next_candidates, search_observations
from fernweave.sources import reports


def even(v):
    return int(v) // 2 * 2


def half_up(v):
    return math.floor(v + 0.5)


def plain_next(measured, attempts, tolerance, symmetric, least_width=96):
    """The next candidate (step, width, fps, colours, bayer) of one search; measured in order of
    seq: a candidate that comes again has a new size in its old place."""
    obs, attempts = [], min(max(attempts, 1), 12)
    for m in measured:
        m = m | {"width": min(max(m["width"], 96), 1920) // 2 * 2, "fps": min(max(m["fps"], 1), 60), "colours": min(max(m["colours"], 3), 256), "bayer": min(m["bayer"], 5)}
        old = [o for o in obs if all(o[c] == m[c] for c in ("width", "fps", "colours", "bayer"))]
        if old:
            old[0]["size"] = m["size"]
        else:
            obs.append(dict(m))
    target, base = obs[-1]["target"], obs[-1]["base_width"]
    t = min(max(tolerance, 1), 25) / 100
    low_end, ceiling = math.ceil(target * (2 - t) / (2 + t)), math.floor(target * (2 + t) / (2 - t)) if symmetric else target
    if len(obs) >= attempts or any(low_end <= o["size"] <= ceiling for o in obs):
        return None
    last = obs[-1]
    same = [o for o in obs if (o["fps"], o["colours"]) == (last["fps"], last["colours"])]
    tried = {(o["width"], o["fps"], o["colours"], o["bayer"]) for o in obs}
    w, fps, colours, bayer, ratio = last["width"], last["fps"], last["colours"], last["bayer"], target / max(last["size"], 1)
    scaled = lambda r: max(even(half_up(w * math.sqrt(r) * R.SAFETY)), least_width)

    def discrete():
        for f in (f for f in R.FPS_LADDER if f < fps):
            c = (min(scaled(min(max(ratio * fps / f, 0.01), 16.0)), base), f, colours, bayer)
            if c not in tried:
                return ("fps", *c)
        for k in (k for k in R.COLOUR_LADDER if k < colours):
            if (w, fps, k, bayer) not in tried:
                return ("colours", w, fps, k, bayer)
        return ("bayer", w, fps, colours, bayer + 1) if bayer < 5 else None

    def smaller():
        under = [o["width"] for o in same if o["size"] <= target]
        if under and max(under) < even((max(under) + w) / 2) < w:
            return ("halve", even((max(under) + w) / 2), fps, colours, bayer)
        wider = [o for o in same if o["bayer"] == bayer and o["width"] > w and o["size"] > last["size"]]
        if symmetric and len(obs) + 1 == attempts and last["size"] > ceiling and wider:
            near = min(wider, key=lambda o: (o["width"], o["seq"]))
            slope = (near["size"] - last["size"]) / (near["width"] ** 2 - w * w)
            v = even(math.floor(math.sqrt(max(w * w - (last["size"] - ceiling) / slope, least_width**2))))
            v = min(max(v, least_width), max(w - 2, 0))
            if v + 2 < w:
                return ("slope", v, fps, colours, bayer)
        v = scaled(min(max(ratio, 0.05), 0.99))
        return ("scale", v, fps, colours, bayer) if v + 2 < w else discrete()

    def larger():
        over = [o["width"] for o in same if o["size"] > target]
        if over and w < even((w + min(over)) / 2) < min(over):
            return ("halve", even((w + min(over)) / 2), fps, colours, bayer)
        if w < base:
            v = min(max(min(scaled(min(max(ratio, 1.0), 16.0)), base), w + 2), base)
            if v > w:
                return ("scale", v, fps, colours, bayer)
        faster = [o["fps"] for o in obs if o["size"] > target and (o["width"], o["colours"]) == (w, colours) and o["fps"] > fps]
        if faster and fps < (fps + min(faster)) // 2 < min(faster):
            return ("fps", w, (fps + min(faster)) // 2, colours, bayer)
        return None

    found = smaller() if last["size"] > target else larger()
    return discrete() if found is not None and found[1:] in tried else found


def by_loops(rows, attempts, tolerance, symmetric):
    searches = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["seq"]):
        searches[r["search"]].append(r)
    return {k: plain_next(v, attempts, tolerance, symmetric) or (None,) * 5 for k, v in searches.items()}


def test_next_candidates_of_random_searches(spark):
    """Candidates that come again among them; budgets and tolerances beyond their limits."""
    rng, rows = random.Random(7), []
    for search in range(1500):
        for seq in range(rng.randrange(1, 15)):
            c = (rng.choice((96, 98, 100, 120, 200, 320, 322, 640)), rng.choice((1, 2, 3, 10, 12, 15)), rng.choice((3, 4, 128)), rng.choice((2, 5)))
            if rows and rows[-1]["search"] == search and rng.random() < 0.2:
                c = tuple(rng.choice([tuple(r[k] for k in ("width", "fps", "colours", "bayer")) for r in rows if r["search"] == search]))
            size = rng.choice((0, 500, 9_000, 9_801, 9_899, 10_000, 10_099, 10_202, 10_203, 14_000, 90_000))
            rows.append({"search": search, "seq": seq, "target": 10_000, "base_width": 640, "width": c[0], "fps": c[1], "colours": c[2], "bayer": c[3], "size": size})
    schema = "search int, seq int, target int, base_width int, width int, fps int, colours int, bayer int, size long"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).persist()
    for attempts, tolerance, symmetric in ((4, 2.0, True), (40, 0.5, True), (8, 2.0, False)):
        want = by_loops(rows, attempts, tolerance, symmetric)
        got = {r.search: tuple(r)[1:] for r in R.next_candidates(df, max_attempts=attempts, tolerance_percent=tolerance, symmetric=symmetric).collect()}
        assert got == want
        assert {w[0] for w in want.values()} >= {"halve", "scale", "fps", "colours", None}


def test_next_candidates_of_orders(spark, sf):
    rows = [r.asDict() for r in search_observations(spark, sf).collect()]
    found = next_candidates(spark, sf).collect()
    for symmetric in (False, True):
        assert {r.search: tuple(r)[1:-1] for r in found if r.symmetric == symmetric} == by_loops(rows, ATTEMPTS, TOLERANCE, symmetric)


def test_no_table_of_all_searches_is_sent_to_the_driver(spark, monkeypatch):
    plans, real = [], R.written
    monkeypatch.setattr(R, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    sizes = spark.range(40).selectExpr("cast(id as int) AS search", "explode(sequence(1, 100)) AS quality", "explode(array('default', 'extra')) AS mode").selectExpr("*", "cast(90 * quality + search AS long) AS bytes")
    found = R.quality_search(spark.range(40).selectExpr("cast(id as int) AS search", "200 * id AS target"), lambda rows: rows.join(sizes.hint("merge"), ["search", "quality", "mode"]))
    assert found.count() == 40
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)


def test_no_quality_is_measured_twice_and_gaps_end_a_search(spark):
    """Sizes of a table with holes: each setting is asked for once, against a loop a search."""
    rng = random.Random(3)
    sizes = {(s, q, m): 100 * q + rng.randrange(400) + (m == "extra") * rng.randrange(-50, 50) for s in range(12) for q in range(1, 101) for m in ("default", "extra") if s < 9 or rng.random() < 0.7}
    targets = {s: rng.choice((1, 60, 2_000, 5_000, 9_999, 40_000)) for s in range(12)}
    known = spark.createDataFrame([(*k, v) for k, v in sizes.items()], "search int, quality int, mode string, bytes long")
    asked = []

    def measure(rows):
        asked.extend(map(tuple, rows.collect()))
        return known.join(rows, ["search", "quality", "mode"])

    got = {r.search: tuple(r)[1:] for r in R.quality_search(spark.createDataFrame(list(targets.items()), "search int, target long"), measure).collect()}
    assert len(asked) == len(set(asked))
    for s, target in targets.items():
        memo, low, high = {}, 1, 100

        def ask(q, m="default", s=s, memo=memo):
            if (q, m) not in memo and (s, q, m) in sizes:
                memo[q, m] = sizes[s, q, m]
            return memo.get((q, m))

        while low <= high:
            q = (low + high) // 2
            b = ask(q)
            if b is None:
                high = low - 1
            elif b < target:
                low = q + 1
            else:
                high = q - 1
        gap = lambda b, target=target: (abs(b - target) * 200.0 / (b + target), abs(b - target))
        first = list(memo)
        for q in sorted({1, 100, 90, *range(max(1, low - 4), min(100, low + 4) + 1)}):
            ask(q)
        turn = lambda k, first=first: first.index(k) if k in first else len(first)
        near = min(memo, key=lambda k: (gap(memo[k]), turn(k), k[0]))[0]
        for q in {100, *range(max(1, near - 4), min(100, near + 4) + 1)}:
            ask(q, "extra")
        best = min(memo, key=lambda k: (gap(memo[k]), -k[0], k[1] != "extra"))
        assert got[s][:3] == (*best, memo[best]) and got[s][4] == len(memo), s


def test_presentations(spark):
    """Frames split in another way show the same, one unit more or less does not; with a short
    delay every frame counts; a run over the seam is one run."""
    def frames(clip, *shown):
        return [(clip, i, h, d) for i, (h, d) in enumerate(shown)]

    a = frames(1, ("x", 4), ("y", 3)) + frames(2, ("x", 4), ("y", 3)) + frames(3, ("x", 1), ("x", 3)) + frames(4, ("x", 2), ("y", 5), ("x", 3)) + frames(5, ("x", 4)) + frames(6, ("x", 0), ("y", 0), ("x", 4)) + frames(7, ("x", 2))
    b = frames(1, ("x", 2), ("x", 2), ("y", 3)) + frames(2, ("x", 2), ("x", 2), ("y", 4)) + frames(3, ("x", 2), ("x", 2)) + frames(4, ("x", 2), ("y", 2), ("y", 3), ("x", 3)) + frames(5, ("x", 4)) + frames(6, ("x", 0), ("y", 0), ("x", 4))
    schema = "clip int, frame int, hash string, delay int"
    sides = [spark.createDataFrame(x, schema).repartition(3) for x in (a, b)]
    canvas = [spark.createDataFrame([(c, 8, 8 + (c == 5 and i), 0 if c != 3 else None) for c in range(1, 8)], "clip int, width int, height int, repeat int") for i in range(2)]
    got = {r.clip: (r.equal, r.reason) for r in presentations_equal(*sides, *canvas).collect()}
    assert got == {1: (True, None), 2: (False, "display"), 3: (False, "display"), 4: (True, None), 5: (False, "canvas"), 6: (True, None), 7: (False, "frames")}


def plain_skyline(rows):
    worse = lambda a, b: all(y <= x for x, y in zip(a, b, strict=True)) and a != b
    return {r for r in rows if None in r or not any(None not in o and worse(r, o) for o in rows)}


@pytest.mark.parametrize(("d", "part"), [(1, 1 << 15), (2, 100), (3, 200)])
def test_skylines_of_cells(spark, monkeypatch, d, part):
    monkeypatch.setattr(O, "PART", part)
    monkeypatch.setattr(O, "CELLS", 27)
    rng, rows = random.Random(d), []
    for key in ("wide", "ties", "line", None):
        for _ in range(600):
            v = [rng.random() * 9 if key == "wide" else rng.randrange(4) for _ in range(d)]
            if key == "line":
                v[-1] = -sum(v[:-1])
            rows.append((key, *(None if rng.random() < 0.003 else float(x) for x in v)))
    names = [f"v{i}" for i in range(d)]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = sorted(map(str, (tuple(r) for r in O.skyline(df, ["k"], names, []).collect())))
    want = [r for r in rows if r[1:] in plain_skyline({x[1:] for x in rows if x[0] == r[0]})]
    assert got == sorted(map(str, want))


def test_a_long_anti_correlated_line_is_a_skyline(spark):
    df = spark.range(200_000).selectExpr("id as x", "1000000 - id as y", "1 as k")
    assert O.skyline(df, ["k"], ["x", "y"], []).count() == 200_000


def test_trees_of_any_depth_and_cycles(spark):
    chain = [(i, i - 1 if i else None, 10 + i, 1) for i in range(70)]
    cycle = [(1000, 1002, 5, 3), (1001, 1000, 5, 7), (1002, 1001, 5, 7)]
    reused = [(2000, None, 50, 1), (2001, 2000, 40, 9), (2002, 2000, 0, 9), (2003, 2000, 60, 2)]
    df = spark.createDataFrame(chain + cycle + reused, "pid long, parent long, started long, rss long")
    roots = spark.createDataFrame([(0,), (0,), (60,), (1000,), (2000,), (None,)], "pid long")
    got = {r.root: (r.processes, r.rss, r.largest) for r in R.process_trees(df, roots).collect()}
    assert got == {0: (70, 70, 0), 60: (10, 10, 60), 1000: (3, 17, 1001), 2000: (2, 3, 2003)}


def groups():
    rng = random.Random(2)
    values = {
        "spread": [rng.lognormvariate(0, 9) for _ in range(500)],
        "narrow": [1e9 + rng.random() for _ in range(301)],
        "signs": [rng.choice((-1, 1)) * rng.lognormvariate(0, 5) for _ in range(200)],
        "ties": [float(rng.randrange(3)) for _ in range(100)],
        "one": [4.5],
        None: [float(x) for x in range(10)],
        "odd": [float("-inf"), 1.0, 2.0, float("inf"), float("nan")],
    }
    return values


def test_ranks_of_groups(spark):
    rows = [(g, v) for g, vs in groups().items() for v in vs] + [("one", None), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ranks = {"p05": Q.rank_nearest(0.05), "p95": Q.rank_nearest(0.95), "index": Q.rank_rounded_index(0.9), "upper": Q.rank_upper_median, "lower": Q.rank_lower_median}
    got = {r.g: tuple(map(str, r[1:])) for r in Q.ranked_values(df, ["g"], "v", ranks).collect()}
    order = lambda v: (math.isnan(v), v)
    want = {}
    for g, vs in groups().items():
        s, n = sorted(vs, key=order), len(vs)
        at = (max(1, math.ceil(n * 0.05)), max(1, math.ceil(n * 0.95)), math.floor((n - 1) * 0.9 + 0.5) + 1, n // 2 + 1, (n + 1) // 2)
        want[g] = tuple(str(s[k - 1]) for k in at)
    assert got == want
    assert Q.ranked_values(df.limit(0), ["g"], "v", ranks).collect() == []


@pytest.mark.parametrize(("ordered", "cells"), [(4, 8), (30, 16)])
def test_ranks_of_groups_that_are_cut_again_and_again(spark, monkeypatch, ordered, cells):
    monkeypatch.setattr(Q, "ORDERED", ordered)
    monkeypatch.setattr(Q, "CELLS", cells)
    test_ranks_of_groups(spark)


def test_an_outlier_leaves_cells_of_like_numbers(spark):
    """20,000 values of one group, one of them 1e15: no cell holds more than a few percent."""
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.when(F.col("id") == 7, 1e15).otherwise(F.col("id") / 1000).alias("v"))
    held = Q.counted(df, ["g"], "v", F.count("*"))
    cells = Q.joined(held, Q.measured(held, ["g"], "v"), ["g"]).withColumn("_d", F.lit(1 << 40)).groupBy(Q.cell_of("v").alias("c")).count().collect()
    assert len(cells) > 200 and max(r["count"] for r in cells) < 0.02 * 20_000


def test_slices_count_nulls_and_grains(spark):
    rows = [("a", "x", 1.0, None), ("a", None, 3.0, 5.0), (None, "x", None, None), ("b", "x", 2.0, 7.0)]
    df = spark.createDataFrame(rows, "k string, f string, m double, n double")
    found = A.slices(df, {"overall": [], "k": ["k"]}, ["k", "f"], ["m", "n"])
    got = {(r.grain, r.k): (r["rows"], r.m_count, r.m_p50, r.m_p95, r.m_max, r.n_count, r.n_p50) for r in found.collect()}
    assert got == {("overall", None): (4, 3, 2.0, 3.0, 3.0, 2, 5.0), ("k", "a"): (2, 2, 1.0, 3.0, 3.0, 1, 5.0), ("k", None): (1, 0, None, None, None, 0, None), ("k", "b"): (1, 1, 2.0, 2.0, 2.0, 1, 7.0)}


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Cluster:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        reports.scratch(Cluster, "x")


def test_the_first_of_equal_rungs_fits(spark):
    rows = [("a", seq, 10, 20, 7) for seq in (9, 4, 6)] + [("a", 1, 30, 20, 8), ("b", 3, 20, 20, 1)]
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: -r[1])):
        df = spark.createDataFrame(order, "k string, seq long, bytes int, cap int, rung int").coalesce(1)
        assert sorted(map(tuple, O.first_fit(df, ["k"], "bytes", "cap", "rung", "seq", ["seq", "rung"]).collect())) == [("a", 4, 7), ("b", 3, 1)]


@pytest.mark.parametrize("met", [100, 4096])
def test_cells_meet_in_blocks(spark, monkeypatch, met):
    monkeypatch.setattr(O, "PART", 64)
    monkeypatch.setattr(O, "MET", met)
    joins, real = [], O.joined
    monkeypatch.setattr(O, "joined", lambda left, right, *more: joins.append(right) or real(left, right, *more))
    rng = random.Random(3)
    rows = sorted({("a", *(rng.randrange(60) for _ in range(4))) for _ in range(800)}) + [("b", 1, 2, 3, 4), ("b", 2, 1, 3, 4), ("b", 2, 2, 3, 4)]
    df = spark.createDataFrame(rows, "k string, w int, x int, y int, z int")
    got = sorted(map(tuple, O.skyline(df, ["k"], ["w", "x", "y", "z"], []).collect()))
    assert got == sorted((k, *r) for k in "ab" for r in plain_skyline({x[1:] for x in rows if x[0] == k}))
    meetings = [d for d in joins if "_with" in d.columns][0]
    assert met == 100 or meetings.count() == 1  # one a key of several cells, not one a pair of cells
