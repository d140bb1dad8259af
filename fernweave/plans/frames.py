"""Frames and pixels, made from orders: 8 x 8 pixels a frame, 16 frames a clip."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweave.functions import scalar as S
from fernweave.operators import pixels as X, schedule as C
from fernweave.plans.registry import query, table

_V = "CAST(floor(o_totalprice) AS BIGINT)"
_SHAPE = {
    "clip": "o_orderkey DIV 1024", "frame": "o_orderkey DIV 64 % 16", "y": "o_orderkey DIV 8 % 8", "x": "o_orderkey % 8", "v": _V,
}
_COLOUR = {
    "r": "(x * 9 + frame * 2 + v % 7 + CASE WHEN x >= 5 AND y >= 4 THEN 120 ELSE 0 END + CASE WHEN frame >= 8 THEN 60 ELSE 0 END) % 256",
    "g": "(y * 11 + x * 3 + clip * 20 + v % 5 + CASE WHEN x >= 5 AND y >= 4 THEN 60 ELSE 0 END) % 256",
    "b": "(frame + y * 4 + v % 3 * 3) % 256",
    "a": "CASE WHEN v % 13 = 0 THEN 0 ELSE 255 END",
    "delay": "frame % 5 + 1",
}
_AFTER = {
    "dr": "least(255, greatest(0, r + v % 5 - 2))", "dg": "least(255, greatest(0, g + v % 3 - 1))", "db": "least(255, b + v % 2)", "da": "CASE WHEN v % 17 = 0 THEN 0 ELSE 255 END",
}


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _SHAPE.items()])
    return p.selectExpr("*", *[f"{e} AS {n}" for n, e in _COLOUR.items()]).selectExpr("*", *[f"{e} AS {n}" for n, e in _AFTER.items()])


def _sql(parts: dict) -> str:
    return ", ".join(f"{e.replace(' DIV ', ' // ')} AS {n}" for n, e in parts.items())


PX = f"p0 AS (SELECT {_sql(_SHAPE)} FROM orders), p1 AS (SELECT *, {_sql(_COLOUR)} FROM p0), px AS (SELECT *, {_sql(_AFTER)} FROM p1)"
_L = "((54 * r + 183 * g + 19 * b) >> 8)"
_SKIN = "((r > 95 AND g > 40 AND b > 20 AND greatest(r, g, b) - least(r, g, b) > 15 AND abs(r - g) > 15 AND r > g AND r > b) OR (r > 200 AND g > 170 AND b > 120 AND r >= g AND g > b AND abs(r - g) <= 45))"


def _delta(a: str, b: str) -> str:
    return "greatest(" + ", ".join(f"abs({a.format(c)} - {b.format(c)})" for c in "rgb") + ")"


@query(f"""
WITH {PX}, l AS (SELECT clip, frame, y, x, r, g, b, {_L} AS l, max(x) OVER f + 1 AS w, max(y) OVER f + 1 AS h FROM px WINDOW f AS (PARTITION BY clip, frame)),
n AS (SELECT *, lead(l) OVER a AS lr, lead(l) OVER d AS ld, lag(l) OVER a AS ll, lag(l) OVER d AS lu,
  {_delta("{}", "lead({}) OVER a")} AS sr, {_delta("{}", "lead({}) OVER d")} AS sd FROM l WINDOW a AS (PARTITION BY clip, frame, y ORDER BY x), d AS (PARTITION BY clip, frame, x ORDER BY y)),
c AS (SELECT *, (lr IS NOT NULL)::INT + (ld IS NOT NULL)::INT AS steps, coalesce(abs(l - lr), 0) + coalesce(abs(l - ld), 0) AS gsum,
  x >= w // 4 AND x < w - w // 4 AND y >= h // 4 AND y < h - h // 4 AS center, CASE WHEN ll IS NOT NULL AND lr IS NOT NULL AND lu IS NOT NULL AND ld IS NOT NULL THEN abs(4 * l - ll - lr - lu - ld) END AS lap, {_SKIN} AS skin FROM n),
g AS (SELECT *, CASE WHEN steps > 0 THEN gsum // steps END AS gm FROM c),
s AS (SELECT clip, frame, count(*) AS pixels, count(DISTINCT ((r >> 4) << 8) | ((g >> 4) << 4) | (b >> 4)) AS colours, count(*) FILTER (skin) / count(*) AS skin_ratio, count(*) FILTER (gm >= 24) / nullif(count(gm), 0) AS density,
  coalesce(avg(gm), 0) / 255 AS mg, coalesce(avg(lap), 0) / 1020 AS lap, coalesce(avg(l) FILTER (center), 0) / 255 AS lc, coalesce(avg(l) FILTER (NOT center), 0) / 255 AS lo, coalesce(avg(gm) FILTER (center), 0) / 255 AS gc, coalesce(avg(gm) FILTER (NOT center), 0) / 255 AS go,
  coalesce(count(*) FILTER (center AND skin) / nullif(count(*) FILTER (center), 0), 0) AS sc, coalesce((count(*) FILTER (sr BETWEEN 1 AND 16) + count(*) FILTER (sd BETWEEN 1 AND 16)) / nullif(sum(steps), 0), 0) AS smooth FROM g GROUP BY ALL),
t AS (SELECT *, least(1, greatest(0, lap * 2.8 - density * 0.24)) AS noise, colours / least(pixels, 512) AS cx FROM s)
SELECT clip, frame, pixels, colours, round(least(1, greatest(0, density * 1.15 + mg * 1.35 + density * (1 - cx) * 0.45 - noise * 0.2)), 6) AS edge_text, round(least(1, greatest(0, abs(lc - lo) * 1.9 + greatest(gc - go, 0) * 2.1 + sc * 0.52)), 6) AS subject_saliency,
  round(skin_ratio, 6) AS skin_ratio, round(noise, 6) AS noise, round(smooth, 6) AS smooth_gradient_ratio, round(cx, 6) AS color_complexity FROM t""")
def spatial_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each frame holds."""
    found = X.spatial_signals(_pixels(spark, sf_dir))
    return found.select("clip", "frame", "pixels", "colours", *[F.round(c, 6).alias(c) for c in found.columns[4:]])


_HIST = ", ".join(f"count(*) FILTER ({c} >> 4 = {i})" for c in "rgb" for i in range(16))
_SCENE = f"""h AS (SELECT clip, frame, count(*) AS n, [{_HIST}] AS h FROM px GROUP BY ALL),
hd AS (SELECT clip, frame, coalesce(list_sum([abs(a[1] - a[2]) FOR a IN list_zip(h, lag(h) OVER w)]) / (n * 6.0), 0) AS histogram, row_number() OVER w AS k FROM h WINDOW w AS (PARTITION BY clip ORDER BY frame)),
mv AS (SELECT clip, frame, abs({_L} - lag({_L}) OVER w) AS dl, {_delta("{}", "lag({}) OVER w")} AS d FROM px WINDOW w AS (PARTITION BY clip, y, x ORDER BY frame)),
tr AS (SELECT clip, frame, coalesce(sum(dl), 0) / count(*) / 255 AS motion, count(*) FILTER (d >= 12) / count(*) AS changed_area FROM mv GROUP BY ALL),
sg AS (SELECT clip, frame, histogram, motion, changed_area, CASE WHEN k = 1 THEN 0 ELSE least(1, histogram * 0.72 + motion * 0.42) END AS scene_change FROM hd JOIN tr USING (clip, frame))"""


@query(f"""WITH {PX}, {_SCENE} SELECT clip, frame, round(histogram, 6) AS histogram, round(motion, 6) AS motion, round(changed_area, 6) AS changed_area, round(scene_change, 6) AS scene_change FROM sg""")
def scene_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from frame to frame."""
    found = X.scene_changes(_pixels(spark, sf_dir))
    return found.select("clip", "frame", *[F.round(c, 6).alias(c) for c in ("histogram", "motion", "changed_area", "scene_change")])


@query(f"""
WITH {PX}, {_SCENE}, m AS (SELECT clip, avg(motion) AS motion, avg(changed_area) AS changed_area FROM sg GROUP BY 1)
SELECT clip, round(motion, 6) AS motion, round(changed_area, 6) AS changed_area, 'motion' AS focus FROM m WHERE motion >= 0.025 OR changed_area >= 0.04""")
def moving_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a clip's signals and the focus they speak for."""
    from fernweave.functions.media import resolve_focus

    m = X.scene_changes(_pixels(spark, sf_dir)).groupBy("clip").agg(F.avg("motion").alias("motion"), F.avg("changed_area").alias("changed_area"))
    still = {n: F.lit(0.0) for n in ("smooth_gradient_ratio", "edge_text", "noise", "subject_saliency", "skin_ratio")}
    found = m.withColumn("focus", resolve_focus({"motion": F.col("motion"), "changed_area": F.col("changed_area"), **still}))
    return found.where("focus = 'motion'").select("clip", F.round("motion", 6).alias("motion"), F.round("changed_area", 6).alias("changed_area"), "focus")


def clip_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their signals, durations and importance."""
    s = X.scene_changes(_pixels(spark, sf_dir))
    importance = S.clamp(F.col("motion") * 0.5 + F.col("scene_change") * 0.5, 0.0, 1.0)
    return s.select(F.col("clip").cast("long"), F.col("frame").cast("int"), (F.col("frame") % 3 * 10_000 + 30_000).cast("long").alias("duration_us"), (F.col("frame") % 7 == 6).alias("excluded"), "motion", "changed_area", "scene_change", importance.alias("importance"))


@query()
def kept_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that a schedule keeps; sequential in each clip."""
    return C.keep_frames(clip_signals(spark, sf_dir)).select("clip", "frame", "kept")


@query(f"""
WITH {PX}, {_SCENE}, k AS (SELECT clip, frame, frame % 3 <> 1 AS kept, 1 + frame % 4 AS held, motion, changed_area, scene_change FROM sg),
s AS (SELECT *, coalesce(sum(kept::INT) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slot, sum(kept::INT) OVER (PARTITION BY clip) AS slots, abs(motion - lag(motion) OVER w) AS sm, abs(changed_area - lag(changed_area) OVER w) AS sa FROM k WINDOW w AS (PARTITION BY clip ORDER BY frame)),
q AS (SELECT *, scene_change * 0.68 + sm * 0.18 + sa * 0.14 AS score FROM s WHERE slot > 0 AND slot < slots AND sm IS NOT NULL),
c AS (SELECT clip, frame, slot, slots, scene_change >= 0.42 AS hard, CASE WHEN scene_change >= 0.42 THEN 'hard_cut' WHEN scene_change >= 0.22 AND changed_area >= 0.08 THEN 'color_drift' WHEN (sm >= 0.08 OR sa >= 0.15) AND score >= 0.28 THEN 'motion_shift' END AS reason,
  CAST(round(greatest(0, least(1, CASE WHEN scene_change >= 0.42 THEN greatest(score, 1) ELSE score END)) * 1000) AS INT) AS score FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY clip, slot ORDER BY hard DESC, score DESC, frame) AS n FROM c WHERE reason IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY hard DESC, score DESC, slot) AS m FROM o WHERE n = 1 AND (hard OR slots >= 3)),
g AS (SELECT s.clip, s.frame, s.held, s.slot, t.reason, t.score FROM s LEFT JOIN (SELECT * FROM t WHERE m < 4) t ON s.clip = t.clip AND s.slot = t.slot WHERE kept),
z AS (SELECT *, sum((reason IS NOT NULL)::INT) OVER (PARTITION BY clip ORDER BY slot) AS segment FROM g)
SELECT clip, CAST(segment AS INT) AS segment, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frames, CAST(sum(held) AS BIGINT) AS duration, max(reason) AS reason, coalesce(max(score), 0) AS score FROM z GROUP BY clip, segment""")
def palette_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries between frames and the segments they make."""
    s = X.scene_changes(_pixels(spark, sf_dir)).withColumn("kept", F.col("frame") % 3 != 1).withColumn("held", F.col("frame") % 4 + 1)
    return C.palette_segments(s)


def _lab(r: str, g: str, b: str) -> list[str]:
    """DuckDB text of l, a and b of a colour."""
    lin = [f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END)" for c in (r, g, b)]
    lms = [f"cbrt({m[0]} * {lin[0]} + {m[1]} * {lin[1]} + {m[2]} * {lin[2]})" for m in S.TO_LMS]
    return [f"({m[0]} * {lms[0]} + {m[1]} * {lms[1]} + {m[2]} * {lms[2]})" for m in S.TO_LAB]


def _apart(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"pow({a.format(c)} - {b.format(c)}, 2)" for c in ("l", "a", "b")) + ")"


_LABS = ", ".join(f"{e} AS {n}" for n, e in zip(["al", "aa", "ab", "bl", "ba", "bb"], [*_lab("r", "g", "b"), *_lab("dr", "dg", "db")], strict=True))


def _sobel(v: str) -> str:
    at = {(i, j): f"{v}{i}{j}" for i in range(3) for j in range(3)}
    gx = f"({at[2, 0]} - {at[0, 0]} + 2 * ({at[2, 1]} - {at[0, 1]}) + {at[2, 2]} - {at[0, 2]})"
    gy = f"({at[0, 2]} - {at[0, 0]} + 2 * ({at[1, 2]} - {at[1, 0]}) + {at[2, 2]} - {at[2, 0]})"
    return f"sqrt({gx} * {gx} + {gy} * {gy}) / 4"


_ROW3 = ", ".join(f"lag({v}) OVER a AS {v}0, {v} AS {v}1, lead({v}) OVER a AS {v}2" for v in ("la", "lb"))
_BOX3 = ", ".join(f"lag({v}{i}) OVER d AS {v}{i}0, {v}{i} AS {v}{i}1, lead({v}{i}) OVER d AS {v}{i}2" for v in ("la", "lb") for i in range(3))


@query(f"""
WITH {PX}, c AS (SELECT clip, frame, y, x, {_LABS}, (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255 AS la, (0.2126 * dr + 0.7152 * dg + 0.0722 * db) / 255 AS lb FROM px),
t AS (SELECT *, {_apart("a{}", "b{}")} AS err, {_apart("lag(a{}) OVER t", "a{}")} AS mv, {_apart("lag(b{}) OVER t", "b{}")} AS dm,
  CASE WHEN row_number() OVER t = 1 THEN {_apart("a{}", "last_value(a{}) OVER u")} END AS sa, CASE WHEN row_number() OVER t = 1 THEN {_apart("b{}", "last_value(b{}) OVER u")} END AS sb
  FROM c WINDOW t AS (PARTITION BY clip, y, x ORDER BY frame), u AS (PARTITION BY clip, y, x ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
rw AS (SELECT *, {_ROW3} FROM t WINDOW a AS (PARTITION BY clip, frame, y ORDER BY x)), bx AS (SELECT *, {_BOX3} FROM rw WINDOW d AS (PARTITION BY clip, frame, x ORDER BY y)),
e AS (SELECT clip, err, mv, dm, sa, sb, {_sobel("la")} AS ea, {_sobel("lb")} AS eb FROM bx),
m AS (SELECT clip, avg(err) AS mean_error, coalesce(avg(err) FILTER (mv <= 0.012), 0) AS static_error, coalesce(avg(abs(dm - mv)) FILTER (mv <= 0.012), 0) AS static_residual, coalesce(count(*) FILTER (mv <= 0.012) / nullif(count(mv), 0), 1) AS static_ratio,
  coalesce(avg(least(abs(eb - ea) / greatest(ea, 0.08), 1)) FILTER (ea >= 0.08), 0) AS edge_error, coalesce(count(*) FILTER (ea >= 0.08) / nullif(count(ea), 0), 0) AS edge_ratio, coalesce(avg(sa), 0) AS reference_seam, coalesce(avg(sb), 0) AS output_seam FROM e GROUP BY 1)
SELECT clip, {", ".join(f"round({c}, 6) AS {c}" for c in ("mean_error", "static_error", "static_residual", "static_ratio", "edge_error", "edge_ratio", "reference_seam", "output_seam"))}, round(1 - edge_error, 6) AS edge_preservation, round(greatest(output_seam - reference_seam, 0), 6) AS seam_excess FROM m""")
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distorted frames against their reference."""
    p = _pixels(spark, sf_dir)
    after = p.select("clip", "frame", "y", "x", *[F.col(f"d{c}").alias(c) for c in "rgb"])
    found = X.pair_metrics(p, after)
    return found.select("clip", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


@query(f"""WITH {PX} SELECT clip, round(avg(abs(a - da)) / 255, 9) AS mean_absolute_error, round(avg(((a >= 128) <> (da >= 128))::INT), 9) AS coverage_error FROM px GROUP BY 1""")
def alpha_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two alpha channels."""
    return X.alpha_metrics(_pixels(spark, sf_dir), "a", "da").select("clip", F.round("mean_absolute_error", 9).alias("mean_absolute_error"), F.round("coverage_error", 9).alias("coverage_error"))


_NEAR = " OR ".join(f"coalesce({f}(a) OVER {w} <> a OR {_delta('{}', f + '({}) OVER ' + w)} > 24, false)" for f, w in (("lag", "al"), ("lead", "al"), ("lag", "dn"), ("lead", "dn")))


@query(f"""
WITH {PX}, n AS (SELECT *, {_NEAR} AS strong, {_delta("{}", "d{}")} AS d, (r - dr) * (r - dr) + (g - dg) * (g - dg) + (b - db) * (b - db) AS sq FROM px WINDOW al AS (PARTITION BY clip, frame, y ORDER BY x), dn AS (PARTITION BY clip, frame, x ORDER BY y)),
f AS (SELECT clip, frame, max(d) FILTER (a > 0) AS m, sqrt(coalesce(sum(sq) FILTER (a > 0), 0) / (greatest(count(*) FILTER (a > 0), 1) * 3)) AS rmse, bool_and(a = a) AS al, bool_and(NOT (a > 0 AND d > 0 AND strong)) AS ed FROM n GROUP BY ALL)
SELECT clip, coalesce(max(m), 0) AS max_channel_change, round(max(rmse), 6) AS worst_frame_rmse, bool_and(al) AS alpha_exact, bool_and(ed) AS strong_edges_exact FROM f GROUP BY 1""")
def pixel_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest changes of visible pixels, and whether strong edges are exact."""
    p = _pixels(spark, sf_dir).withColumn("a2", F.col("a"))
    return X.pixel_envelope(p, ["r", "g", "b"], ["dr", "dg", "db"], ("a", "a2")).withColumn("worst_frame_rmse", F.round("worst_frame_rmse", 6))


@query(f"""
WITH {PX}, b AS (SELECT clip, frame, y // 4 AS by, x // 4 AS bx, (abs(sum(dr - r)) + abs(sum(dg - g)) + abs(sum(db - b))) / count(*) / 3 AS bias, count(*) * greatest(max(delay), 1) AS w FROM px GROUP BY ALL),
t AS (SELECT clip, delay, {_delta("{}", "lag({}) OVER t")} AS d, {_delta("d{}", "lag(d{}) OVER t")} AS o, ({" + ".join(f"abs((d{c} - lag(d{c}) OVER t) - ({c} - lag({c}) OVER t))" for c in "rgb")}) / 3 AS res FROM px WINDOW t AS (PARTITION BY clip, y, x ORDER BY frame)),
r AS (SELECT clip, coalesce(sum(res * delay) FILTER (d <= 4) / nullif(sum(delay) FILTER (d <= 4), 0), 0) AS residual, count(*) FILTER (d <= 4 AND o > 0) AS flips FROM t GROUP BY 1)
SELECT clip, round(mean_bias, 6) AS mean_bias, round(max_bias, 6) AS max_bias, round(residual, 6) AS residual, flips FROM (SELECT clip, sum(bias * w) / sum(w) AS mean_bias, max(bias) AS max_bias FROM b GROUP BY 1) JOIN r USING (clip)""")
def temporal_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block bias, residual motion of still places, and their flips."""
    p, before, after = _pixels(spark, sf_dir), ["r", "g", "b"], ["dr", "dg", "db"]
    both = X.block_bias(p, before, after, "delay", 4).join(X.temporal_residual(p, before, after, "delay"), "clip")
    return both.select("clip", *[F.round(c, 6).alias(c) for c in ("mean_bias", "max_bias", "residual")], "flips")


_CELL = f"cl AS (SELECT *, y * 2 // (max(y) OVER f + 1) AS cy, x * 2 // (max(x) OVER f + 1) AS cx, {_L} AS l FROM px WINDOW f AS (PARTITION BY clip, frame))"
_BEND = "greatest(" + ", ".join(f"abs(4 * {c} - lag({c}) OVER al - lead({c}) OVER al - lag({c}) OVER dn - lead({c}) OVER dn)" for c in "rgb") + ")"


@query(f"""
WITH {PX}, {_CELL}, n AS (SELECT *, coalesce(abs(l - lead(l) OVER al), 0) + coalesce(abs(l - lead(l) OVER dn), 0) AS e, (lead(l) OVER al IS NOT NULL)::INT + (lead(l) OVER dn IS NOT NULL)::INT AS ne,
  CASE WHEN lag(l) OVER al IS NOT NULL AND lead(l) OVER al IS NOT NULL AND lag(l) OVER dn IS NOT NULL AND lead(l) OVER dn IS NOT NULL THEN {_BEND} / 1020.0 END AS hf, coalesce({_delta("{}", "lag({}) OVER t")}, 0) / 255.0 AS t
  FROM cl WINDOW al AS (PARTITION BY clip, frame, cy, cx, y ORDER BY x), dn AS (PARTITION BY clip, frame, cy, cx, x ORDER BY y), t AS (PARTITION BY clip, y, x ORDER BY frame)),
f AS (SELECT clip, frame, cy, cx, max(delay) AS w, sqrt(greatest(avg(l / 255.0 * (l / 255.0)) - avg(l / 255.0) * avg(l / 255.0), 0)) AS spatial_std, sum(e) / 255 / greatest(sum(ne), 1) AS edge, avg({_SKIN}::INT) AS skin_ratio, avg(t) AS temporal_delta, coalesce(avg(hf), 0) AS noise FROM n GROUP BY ALL)
SELECT clip, CAST(cy AS INT) AS cy, CAST(cx AS INT) AS cx, {", ".join(f"round(sum(w * {c}) / sum(w), 6) AS {c}" for c in ("spatial_std", "edge", "skin_ratio", "temporal_delta", "noise"))} FROM f GROUP BY clip, cy, cx""")
def region_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the cells of a raster."""
    found = X.region_grid(_pixels(spark, sf_dir), 2, "delay")
    return found.select("clip", "cy", "cx", *[F.round(c, 6).alias(c) for c in ("spatial_std", "edge", "skin_ratio", "temporal_delta", "noise")])


@query(f"""
WITH {PX}, c AS (SELECT *, y // 4 AS cy, x // 4 AS cx FROM px), s AS (SELECT *, {_delta("{}", "lead({}) OVER al")} AS sx, {_delta("{}", "lead({}) OVER dn")} AS sy, {_delta("{}", "lag({}) OVER t")} AS st
  FROM c WINDOW al AS (PARTITION BY clip, frame, cy, cx, y ORDER BY x), dn AS (PARTITION BY clip, frame, cy, cx, x ORDER BY y), t AS (PARTITION BY clip, y, x ORDER BY frame))
SELECT clip, frame, cy, cx, greatest(max(r) - min(r), max(g) - min(g), max(b) - min(b)) AS range, round(coalesce((coalesce(sum(sx), 0) + coalesce(sum(sy), 0)) / nullif(count(sx) + count(sy), 0), 0), 6) AS mean_step, count(*) FILTER (sx > 24) + count(*) FILTER (sy > 24) AS edges,
  coalesce(avg(st) >= 12 OR count(*) FILTER (st > 24) * 4 >= count(*), false) AS cut FROM s GROUP BY clip, frame, cy, cx""")
def cell_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients of cells and cuts between frames."""
    return X.cell_steps(_pixels(spark, sf_dir), 4).withColumn("mean_step", F.round("mean_step", 6))


_DISPOSAL = "CASE frame % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'previous' ELSE 'background' END"
_DRAWS = "dr AS (SELECT clip, frame, y, x, CASE WHEN v % 4 > 0 THEN r END AS drawn FROM px WHERE x >= frame % 4 AND y <= 4 + frame % 3)"


@query(f"""
WITH {PX}, {_DRAWS}, pl AS (SELECT DISTINCT clip, y, x FROM dr), fr AS (SELECT DISTINCT clip, frame, {_DISPOSAL} AS disposal FROM px),
j AS (SELECT pl.clip, fr.frame, pl.y, pl.x, disposal, drawn, dr.frame IS NOT NULL AS inside FROM pl JOIN fr USING (clip) LEFT JOIN dr ON dr.clip = pl.clip AND dr.frame = fr.frame AND dr.y = pl.y AND dr.x = pl.x),
w AS (SELECT *, CASE WHEN disposal = 'keep' AND drawn IS NOT NULL THEN drawn WHEN disposal = 'background' AND inside THEN -1 END AS lft FROM j)
SELECT clip, frame, y, x, coalesce(drawn, nullif(last_value(lft IGNORE NULLS) OVER (PARTITION BY clip, y, x ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)) AS shown FROM w""")
def displayed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What frames with three ways of disposal show."""
    p = _pixels(spark, sf_dir)
    draws = p.where("x >= frame % 4 and y <= 4 + frame % 3").select("clip", "frame", "y", "x", F.expr("CASE WHEN v % 4 > 0 THEN r END").alias("drawn"))
    return X.displayed(draws, p.select("clip", "frame", F.expr(_DISPOSAL).alias("disposal")).distinct(), "drawn")


@query(f"""
WITH {PX}, h AS (SELECT clip, frame, sha256(unhex(string_agg(CASE WHEN a > 0 THEN printf('%02X%02X%02X', r, g, b) ELSE '000000' END || printf('%02X', a), '' ORDER BY y, x))) AS hash FROM px GROUP BY ALL) SELECT clip, frame, hash FROM h""")
def frame_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of what is visible."""
    return X.frame_hashes(_pixels(spark, sf_dir), "a")


@query(f"""
WITH {PX}, s AS (SELECT clip, frame, y, x, r // 64 AS r, g // 64 AS g, b // 64 AS b FROM px), d AS (SELECT clip, frame, y, x, coalesce({_delta("{}", "lag({}) OVER w")} > 0, true) AS d FROM s WINDOW w AS (PARTITION BY clip, y, x ORDER BY frame))
SELECT clip, frame, count(*) FILTER (d) AS changed, min(x) FILTER (d) AS x0, min(y) FILTER (d) AS y0, max(x) FILTER (d) AS x1, max(y) FILTER (d) AS y1 FROM d GROUP BY ALL""")
def change_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of change."""
    p = _pixels(spark, sf_dir).selectExpr("clip", "frame", "y", "x", *[f"{c} div 64 AS {c}" for c in "rgb"])
    return X.change_boxes(p)


@query(f"""
WITH {PX}, u AS (SELECT DISTINCT clip, r // 16 * 5 AS idx FROM px), n AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY idx) - 1 AS compact, count(*) OVER (PARTITION BY clip) AS n FROM u)
SELECT clip, idx, CAST(compact AS INT) AS compact, CAST(greatest(2, pow(2, ceil(log2(n)))) AS INT) AS table_size FROM n""")
def compact_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Used palette entries renumbered."""
    return X.compact_indices(_pixels(spark, sf_dir).select("clip", F.expr("r div 16 * 5").alias("idx")), ["clip"], "idx")


_PALETTE = [(0, 0, 0), (60, 40, 20), (120, 80, 40), (180, 120, 60), (240, 160, 80), (128, 128, 128)]
_KNOWN = ", ".join(f"{e} AS k{i}{n}" for i, c in enumerate(_PALETTE) for n, e in zip(("l", "a", "b"), _lab(*[f"CAST({v} AS DOUBLE)" for v in c]), strict=True))
_FAR = ", ".join(f"struct_pack(d := {_apart('al_{}'.replace('al_', 'a'), f'k{i}' + '{}')}, i := {i})" for i in range(len(_PALETTE)))
_XOR = "xor(x, y)"
_BAYER = " + ".join(f"((({_XOR}) >> {i}) & 1) * {1 << (5 - 2 * i)} + ((y >> {i}) & 1) * {1 << (4 - 2 * i)}" for i in range(3))


@query(f"""
WITH {PX}, k AS (SELECT {_KNOWN}), c AS (SELECT clip, frame, y, x, {", ".join(f"{e} AS a{n}" for n, e in zip(("l", "a", "b"), _lab("r", "g", "b"), strict=True))} FROM px),
f AS (SELECT clip, frame, y, x, list_sort([{_FAR}])[1:2] AS two, ({_BAYER} + 0.5) / 64.0 AS t FROM c CROSS JOIN k)
SELECT clip, frame, y, x, CASE WHEN coalesce(two[1].d / nullif(two[1].d + two[2].d, 0), 0) * 160 / 255.0 > t THEN two[2].i ELSE two[1].i END AS index FROM f""")
def ordered_dither(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest or second nearest palette entry by an ordered threshold."""
    return X.ordered_dither(_pixels(spark, sf_dir).select("clip", "frame", "y", "x", "r", "g", "b"), _PALETTE, 160).select("clip", "frame", "y", "x", "index")


@query()
def held_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values held over frames; a fold over each place's frames."""
    return X.held_colours(_pixels(spark, sf_dir), "dg", "g", "delay", 4)


@query(f"""
WITH {PX}, g AS (SELECT clip, frame, y, x, {_L} AS l FROM px), n AS (SELECT *, lag(l) OVER al AS ll, lead(l) OVER al AS lr, lag(l) OVER dn AS lu, lead(l) OVER dn AS ld, abs(l - lag(l) OVER t) AS d FROM g WINDOW al AS (PARTITION BY clip, frame, y ORDER BY x), dn AS (PARTITION BY clip, frame, x ORDER BY y), t AS (PARTITION BY clip, y, x ORDER BY frame)),
i AS (SELECT clip, (abs(lr - ll) + abs(ld - lu)) // 2 AS gr, abs(4 * l - ll - lr - lu - ld) AS bend FROM n WHERE ll IS NOT NULL AND lr IS NOT NULL AND lu IS NOT NULL AND ld IS NOT NULL),
s AS (SELECT clip, avg((gr BETWEEN 4 AND 48 AND bend <= 16)::INT) AS smooth_ratio, avg((gr >= 64)::INT) AS edge_ratio, avg(bend) / 255 AS noise FROM i GROUP BY 1),
f AS (SELECT clip, frame, sum(d) / (64.0 * 255) AS delta, count(*) FILTER (d >= 12) / 64.0 AS changed, coalesce((max(x) FILTER (d >= 12) - min(x) FILTER (d >= 12) + 1) * (max(y) FILTER (d >= 12) - min(y) FILTER (d >= 12) + 1) / 64.0, 0) AS area FROM n GROUP BY ALL),
c AS (SELECT clip, count(*) AS frames, avg(delta) AS mean_delta, list_sort(list(delta) FILTER (delta IS NOT NULL))[count(delta) // 2 + 1] AS median_delta, avg((delta < 0.012 AND changed < 0.08)::INT) FILTER (delta IS NOT NULL) AS static_ratio, avg((delta > 0.18 AND changed > 0.65)::INT) FILTER (delta IS NOT NULL) AS cut_ratio, avg(area) FILTER (delta IS NOT NULL) AS mean_area,
 count(*) FILTER (delta > 0.18 AND changed > 0.65) AS cuts FROM f GROUP BY 1)
SELECT clip, frames, cuts, {", ".join(f"round({c}, 6) AS {c}" for c in ("mean_delta", "median_delta", "static_ratio", "cut_ratio", "mean_area", "smooth_ratio", "edge_ratio", "noise"))} FROM c LEFT JOIN s USING (clip)""")
def content_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quick look at clips by grey samples."""
    p = _pixels(spark, sf_dir).select("clip", "frame", "y", "x", S.luma8(F.col("r"), F.col("g"), F.col("b")).alias("l"))
    found = X.content_probe(p, 8, 4.0)
    return found.select("clip", "frames", F.size("cut_times").cast("long").alias("cuts"), *[F.round(c, 6).alias(c) for c in ("mean_delta", "median_delta", "static_ratio", "cut_ratio", "mean_area", "smooth_ratio", "edge_ratio", "noise")])


@query(f"""
WITH {PX}, n AS (SELECT *, {_delta("{}", "lead({}) OVER al")} AS sx, {_delta("{}", "lead({}) OVER dn")} AS sy FROM px WINDOW al AS (PARTITION BY clip, frame, y ORDER BY x), dn AS (PARTITION BY clip, frame, x ORDER BY y)),
l AS (SELECT clip, {_LABS}, 1 + greatest(coalesce(sx, 0), coalesce(sy, 0)) / 255.0 AS w FROM n), e AS (SELECT clip, w, {_apart("a{}", "b{}")} AS e FROM l),
o AS (SELECT clip, avg(e) AS mean_error, quantile_disc(e, 0.95) AS p95_error, sum(e * w) / sum(w) AS edge_weighted_error FROM e GROUP BY 1),
b AS (SELECT clip, {", ".join(f"round(avg({c})) AS {c}" for c in ("r", "g", "b", "dr", "dg", "db"))} FROM px GROUP BY clip, frame, y // 4, x // 4), q AS (SELECT clip, {_LABS} FROM b), z AS (SELECT clip, avg({_apart("a{}", "b{}")}) AS low FROM q GROUP BY 1)
SELECT clip, round(mean_error, 6) AS mean_error, round(p95_error, 6) AS p95_error, round(edge_weighted_error, 6) AS edge_weighted_error, round(low, 6) AS low_error_4 FROM o JOIN z USING (clip)""")
def candidate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a quantised candidate."""
    found = X.candidate_errors(_pixels(spark, sf_dir), ["r", "g", "b"], ["dr", "dg", "db"], (4,))
    return found.select("clip", *[F.round(c, 6).alias(c) for c in ("mean_error", "p95_error", "edge_weighted_error", "low_error_4")])


@query(f"""
WITH {PX}, f AS (SELECT clip, frame, max(x) + 1 AS w, max(y) + 1 AS h, max(delay) AS d, CASE WHEN frame % 2 = 0 THEN 16 END AS t, {_DISPOSAL} AS disposal FROM px GROUP BY clip, frame)
SELECT clip, count(*) AS frames, CAST(sum(w * h) AS BIGINT) AS pixels, CAST(sum(d) AS BIGINT) AS delay_cs, CAST(coalesce(sum(t), 0) AS BIGINT) AS entries, count(*) FILTER (disposal = 'keep') AS kept, count(*) FILTER (disposal = 'background') AS cleared, count(*) FILTER (disposal = 'previous') AS restored FROM f GROUP BY 1""")
def write_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of what a writer is given."""
    frames = _pixels(spark, sf_dir).groupBy("clip", "frame").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.max("delay").alias("delay_cs"))
    return X.write_totals(frames.withColumn("table_size", F.when(F.col("frame") % 2 == 0, 16)).withColumn("disposal", F.expr(_DISPOSAL)))


def large_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 64 by 64: each order is a block of 8 by 8 pixels, 16 frames a clip. Colours
    rise in steps, as quantised skies do, with some noise of the order's price."""
    blocks = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey DIV 1024 AS clip", "o_orderkey DIV 64 % 16 AS frame", "cast(o_orderkey DIV 8 % 8 * 8 as int) AS y0", "cast(o_orderkey % 8 * 8 as int) AS x0", f"{_V} AS v"
    )
    p = blocks.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63)))).selectExpr("clip", "frame", "y0 + p DIV 8 AS y", "x0 + p % 8 AS x", "v")
    wave = {"r": "20 + (x + clip * 7) DIV 9 * 2 + y DIV 16", "g": "40 + (x + y + frame) DIV 12 * 3 + CASE WHEN v % 5 = 0 THEN x % 2 ELSE 0 END", "b": "60 + y DIV 10 * 2 + CASE WHEN v % 7 = 0 THEN v % 90 ELSE 0 END"}
    return p.selectExpr("clip", "frame", "y", "x", *[f"cast({e} as int) AS {c}" for c, e in wave.items()])


@query()
def banding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible steps in frames of 64 by 64. A stencil over five scales; a test holds it
    against plain loops."""
    from fernweave.operators.frames import banding

    found = banding(large_pixels(spark, sf_dir), *map(F.col, "rgb"))
    return found.select("clip", "frames", F.round("banding", 9).alias("banding"))


@query()
def reused_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """neighbours' colours reused within a bound of 6, in frames of 64 by 64. Each pixel
    follows those before it; a test holds it against a plain loop."""
    from fernweave.operators.frames import packed, reused_colours

    found = reused_colours(packed(large_pixels(spark, sf_dir), *map(F.col, "rgb")), 6)
    return found.select("clip", "frame", "changed", F.size(F.array_distinct("rgb")).alias("colours"), F.sha2(F.array_join(F.col("rgb").cast("array<string>"), ","), 256).alias("sha256"))
