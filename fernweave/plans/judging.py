"""Judgements of results, delivery plans, searches and trees, over parts, orders and customers."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweave.functions import delivery as D, media as M, quantiles as Q, scalar as S
from fernweave.operators import gates as G, relational as J, search as R, select as O
from fernweave.plans.registry import query, table
from fernweave.sources import documents as SD

_PAIR = "pr AS (SELECT p_partkey AS id, p_size * 1000 + 1 AS a, p_size * 1000 + p_partkey % 7 * 300 - 900 + 1 AS b, p_partkey % 60 + 0.25 AS sa, p_partkey % 60 + 0.25 + p_partkey % 5 * 0.4 - 0.8 AS sb, p_brand FROM part)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    score = (k % 60 + F.lit(0.25)).cast("double")
    return table(spark, sf_dir, "part").select(k.alias("id"), (F.col("p_size") * 1000 + 1).alias("a"), (F.col("p_size") * 1000 + k % 7 * 300 - 900 + 1).alias("b"), score.alias("sa"), (score + (k % 5).cast("double") * 0.4 - 0.8).alias("sb"), "p_brand")


@query(f"""
WITH {_PAIR}, w AS (SELECT *, CASE WHEN round(sb - sa, 6) > 0.5 THEN 'challenger' WHEN round(sb - sa, 6) < -0.5 THEN 'incumbent' ELSE 'tie' END AS winner, CASE WHEN a + b = 0 THEN 0 ELSE abs(a - b) * 200.0 / (a + b) END <= 5 AS near, least(sa, sb) >= 20 AS reliable FROM pr)
SELECT id, winner, CASE WHEN near AND reliable THEN 'near_size_' || winner WHEN near THEN 'near_size_metric_floor' WHEN b < a AND round(sb - sa, 6) >= -0.5 THEN 'other_smaller_quality_tie' WHEN b < a THEN 'other_smaller_quality_tradeoff' ELSE 'unmatched_other' END AS class,
 round(100.0 * b / 30000, 2)::DOUBLE AS fill FROM w""")
def comparison_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wins a pair, and what kind of comparison it is."""
    winner = D.quality_winner(F.col("sb") - F.col("sa"), "challenger", "incumbent")
    kind = D.comparison_class(F.col("a"), F.col("b"), F.col("sa"), F.col("sb"), winner)
    return _pairs(spark, sf_dir).select("id", winner.alias("winner"), kind.alias("class"), D.cap_fill(F.col("b"), F.lit(30000)).alias("fill"))


@query(f"""
WITH {_PAIR}, d AS (SELECT *, round(sb - sa, 6) AS delta, CASE WHEN a + b = 0 THEN 0 ELSE abs(a - b) * 200.0 / (a + b) END AS gap, least(sa, sb) >= 20 AS ok FROM pr)
SELECT p_brand, count(*) AS pairs, count(*) FILTER (delta > 0.5) AS wins, count(*) FILTER (ok) AS reliable, count(*) FILTER (ok AND delta > 0.5) AS reliable_wins, count(*) FILTER (ok AND gap <= 5) AS eligible, count(*) FILTER (gap <= 5) AS near_size,
 round(avg(delta), 6) AS mean_delta, round(median(delta), 6)::DOUBLE AS median_delta, round(avg(gap), 6) AS mean_gap, round(max(abs(sa - sb)), 6)::DOUBLE AS largest FROM d GROUP BY 1""")
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides' pairs under three filters."""
    p = _pairs(spark, sf_dir).withColumn("delta", F.round(F.col("sb") - F.col("sa"), 6)).withColumn("gap", S.symmetric_delta_percent(F.col("a"), F.col("b"))).withColumn("ok", F.least("sa", "sb") >= D.RELIABLE)
    won, near = F.col("delta") > D.WINNER_BAND, F.col("gap") <= D.NEAR_SIZE
    whole = p.groupBy("p_brand").agg(
        F.count("*").alias("pairs"), F.count_if(won).alias("wins"), F.count_if("ok").alias("reliable"), F.count_if(F.col("ok") & won).alias("reliable_wins"), F.count_if(F.col("ok") & near).alias("eligible"), F.count_if(near).alias("near_size"),
        F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.max(F.abs(F.col("sa") - F.col("sb"))), 6).alias("largest"),
    )
    return Q.joined(whole, Q.medians(p, ["p_brand"], "delta", "median_delta"), ["p_brand"], "left").withColumn("median_delta", F.round("median_delta", 6))


@query("""
SELECT p_partkey AS id, ['ffmpeg_fast', 'ffmpeg_best_guard_baseline', 'x', 'ffmpeg_best_smooth_gradient'][p_partkey % 4 + 1] AS encoder,
 CASE p_partkey % 4 WHEN 1 THEN 'guard_fallback_to_fast' WHEN 3 THEN 'ffmpeg_best_smooth_gradient' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'rust_perceptual' WHEN p_partkey % 4 = 0 AND p_partkey % 5 > 0 THEN 'alpha_safe_ffmpeg' ELSE 'ffmpeg' END END AS route,
 p_partkey % 4 <> 1 AND p_partkey % 3 > 0 AND p_partkey % 5 > 0 AS formal FROM part""")
def route_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes by encoder and backend, and pairs that count."""
    k = F.col("p_partkey")
    encoder = F.element_at(F.array(*map(F.lit, ["ffmpeg_fast", "ffmpeg_best_guard_baseline", "x", "ffmpeg_best_smooth_gradient"])), (k % 4 + 1).cast("int"))
    backend, sha = F.when(k % 3 == 0, "rust.x").otherwise("ffmpeg"), F.when(k % 5 > 0, "abc")
    formal = D.formal_pair(F.when(k % 4 == 1, 9.0).otherwise(1.0), 5.0, k % 3 > 0, F.lit(True), sha, F.lit(False))
    return table(spark, sf_dir, "part").select(k.alias("id"), encoder.alias("encoder"), D.route_label(encoder, backend, sha).alias("route"), formal.alias("formal"))


@query("""
WITH v AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1)
SELECT user_id, round(CASE WHEN user_id % 3 = 0 THEN 7.5 ELSE list_avg(v) END, 6) AS pooled, round(CASE WHEN user_id % 3 = 0 THEN 7.5 ELSE list_min(v) END, 6) AS least, CASE WHEN user_id % 3 <> 0 AND 0 = 1 THEN 1 END AS none FROM v""")
def pooled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pooled values, or the mean of the finite frames' values."""
    odd = F.explode(F.array(F.col("value"), F.lit(float("nan")), F.lit(float("inf"))))  # two frames without a measure beside each
    frames = table(spark, sf_dir, "events").select("user_id", odd.alias("value"))
    v = frames.groupBy("user_id").agg(*[D.pooled(F.col("value"), least).alias(n) for n, least in (("mean", False), ("min", True))])
    stored = F.when(F.col("user_id") % 3 == 0, 7.5).when(F.col("user_id") % 3 == 1, float("nan"))
    own = lambda c: F.when(D.finite(stored), stored).otherwise(F.col(c))
    return v.select("user_id", F.round(own("mean"), 6).alias("pooled"), F.round(own("min"), 6).alias("least"), S.guarded_rate(F.lit(1), F.lit(0)).cast("int").alias("none"))


@query("""
WITH c AS (SELECT p_partkey AS k FROM part) SELECT k, CASE WHEN k % 2 = 0 AND k % 4 = 0 AND k % 3 = 0 AND k % 5 > 0 THEN 'single' WHEN k % 4 = 1 THEN 'diff' ELSE 'full' END AS stats, CASE WHEN k % 2 = 0 THEN 'sierra2_4a' ELSE 'bayer' END AS dither,
 k % 2 = 0 AND k % 4 = 0 AND k % 3 = 0 AND k % 5 > 0 AS per_frame, NOT (k % 2 = 0 AND k % 4 = 0 AND k % 3 = 0 AND k % 5 > 0) AND k % 7 > 0 AS rectangle FROM c""")
def palette_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How palettes are made."""
    k = F.col("p_partkey")
    content = F.when(k % 4 == 0, "frequent_scene_changes").when(k % 4 == 1, "static_or_small_changes").otherwise("unknown")
    plan = D.palette_plan(F.when(k % 2 == 0, "best").otherwise("fast"), content, k % 3 == 0, k % 5 > 0, k % 7 > 0)
    return table(spark, sf_dir, "part").select(k.alias("k"), plan.alias("p")).select("k", "p.stats", "p.dither", "p.per_frame", "p.rectangle")


@query("""
WITH c AS (SELECT p_partkey AS k, p_size * 8 AS w, p_size * 6 AS h, CASE p_partkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'motion' WHEN 2 THEN 'smallest' ELSE 'balanced' END AS pri, CASE p_partkey % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'flat_art' ELSE 'motion' END AS foc, p_partkey % 7 = 0 AS al, p_partkey % 2 = 0 AS vid FROM part),
q AS (SELECT *, least(20, greatest(0.05, w * h * 15 * 4 * CASE WHEN al THEN 1.28 ELSE 1 END * CASE WHEN pri = 'motion' OR foc = 'motion' THEN 1.24 WHEN vid THEN 1.12 ELSE 0.92 END * (0.65 + 128 / 256.0 * 0.55) * 0.055 / 200000)) AS score,
 CASE WHEN al THEN 'transparent_asset' WHEN pri = 'text' THEN 'screen_ui' WHEN foc = 'flat_art' THEN 'flat_art' WHEN foc = 'motion' OR pri = 'motion' THEN 'high_motion' WHEN vid THEN 'photographic' ELSE 'flat_art' END AS kind FROM c),
r AS (SELECT *, CASE WHEN score < 0.7 THEN 'low' WHEN score < 1.6 THEN 'medium' WHEN score < 3.2 THEN 'high' ELSE 'extreme' END AS pressure FROM q)
SELECT k, kind, pressure, round(score, 6) AS score, CASE WHEN pressure = 'low' THEN 'full_cfr' WHEN kind NOT IN ('high_motion', 'transparent_asset') AND pri <> 'motion' AND (pressure = 'extreme' OR kind = 'screen_ui') THEN 'static_hold' ELSE 'motion_protected_drop_hold' END AS policy FROM r""")
def volume_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content class, size pressure and timeline policy."""
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(
        k.alias("k"), (F.col("p_size") * 8).alias("w"), (F.col("p_size") * 6).alias("h"), F.when(k % 5 == 0, "text").when(k % 5 == 1, "motion").when(k % 5 == 2, "smallest").otherwise("balanced").alias("pri"),
        F.when(k % 3 == 0, "auto").when(k % 3 == 1, "flat_art").otherwise("motion").alias("foc"), (k % 7 == 0).alias("al"), (k % 2 == 0).alias("vid"),
    )
    moving = (F.col("pri") == "motion") | (F.col("foc") == "motion")
    score = D.size_pressure(F.col("w"), F.col("h"), F.lit(15), F.lit(4.0), F.lit(128), F.col("al"), F.col("vid"), moving, F.lit(200000))
    kind = D.content_class(F.col("al"), F.col("foc"), F.col("pri"), F.lit(15), F.col("vid"), F.lit(128))
    seen = c.select("k", "pri", kind.alias("kind"), score.alias("score")).withColumn("pressure", D.pressure_name(F.col("score")))
    return seen.select("k", "kind", "pressure", F.round("score", 6).alias("score"), D.timeline_policy(F.col("pressure"), F.col("kind"), F.col("pri")).alias("policy"))


@query("""
WITH c AS (SELECT o_orderkey AS k, o_orderkey % 11 = 0 AS missed, o_orderkey % 7 = 0 AS fell, o_orderkey % 5 = 0 AS warned, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 END AS q, CASE o_orderkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'expired' END AS p FROM orders)
SELECT k, CASE WHEN missed OR coalesce(q, 2) = 0 THEN 'adjust' WHEN fell OR warned OR q IS NULL OR q = 1 OR coalesce(p <> 'verified', false) THEN 'check' ELSE 'ready' END AS level, CASE WHEN missed THEN 'smaller' WHEN coalesce(q, 2) <= 1 THEN 'clearer' ELSE 'regenerate' END AS action,
 missed::INT + fell::INT + warned::INT + (q IS NULL)::INT + coalesce(q = 0, false)::INT + coalesce(p = 'expired', false)::INT AS risks FROM c""")
def output_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an output can be delivered, with its risks."""
    k = F.col("o_orderkey")
    quality, platform = F.when(k % 4 < 3, (k % 4).cast("int")), F.when(k % 3 == 0, "verified").when(k % 3 == 1, "expired")
    c = D.output_confidence(k % 11 == 0, k % 7 == 0, F.when(k % 5 == 0, F.array(F.lit("late"))), quality, platform)
    return table(spark, sf_dir, "orders").select(k.alias("k"), c.alias("c")).select("k", "c.level", "c.action", F.size("c.risks").alias("risks"))


@query("""
WITH c AS (SELECT o_orderkey AS k, o_orderkey % 400 AS dim FROM orders)
SELECT k, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'format' END, CASE WHEN dim = 0 THEN 'dimensions' END, CASE WHEN dim > 300 THEN 'width over limit' END, CASE WHEN dim > 0 AND abs(dim / 200.0 - 1.0) > 0.01 THEN 'aspect off' END) AS violations,
 CASE WHEN k % 4 = 0 THEN 'inferred' WHEN k % 3 = 0 OR k % 4 = 1 THEN 'invalid' WHEN k % 4 = 2 THEN 'expired' ELSE 'verified' END AS state,
 CASE WHEN k % 2 = 0 THEN 'alpha_mask' WHEN k % 5 < 2 THEN 'insufficient' WHEN dim >= 288 THEN 'unsuitable' WHEN dim <= 152 THEN 'motion_baseline' ELSE 'content_saliency' END AS roi FROM c""")
def delivery_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform limits, evidence and regions of interest."""
    k, dim = F.col("o_orderkey"), F.col("o_orderkey") % 400
    limit = {"formats": F.array(F.lit("gif")), "width": F.lit(300), "fps": F.lit(None).cast("int"), "duration_s": F.lit(60), "bytes": F.lit(None).cast("long"), "aspect": F.lit(1.0)}
    out = {"format": F.when(k % 3 == 0, "webp").otherwise("gif"), "width": dim, "height": F.lit(200), "fps": F.lit(10), "duration_s": F.lit(5.0), "bytes": F.lit(5000)}
    now = F.lit("2026-01-01").cast("timestamp")
    tested = F.when(k % 4 == 0, F.lit(None).cast("timestamp")).when(k % 4 == 1, F.lit("2026-02-01").cast("timestamp")).when(k % 4 == 2, F.lit("2025-01-01").cast("timestamp")).otherwise(F.lit("2025-12-01").cast("timestamp"))
    state = M.evidence_state(F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), tested, now)
    roi = M.roi_readiness(k % 2 == 0, k % 5, F.lit(0), dim / 400.0)
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.array_join(M.envelope_violations(out, limit), ",").alias("violations"), state.alias("state"), roi.alias("roi"))


@query("""
WITH c AS (SELECT p_partkey AS k, CAST(least(1920, greatest(96, p_size * 20)) AS INT) // 2 * 2 AS w, CAST(p_size % 50 + 1 AS INT) AS f, CAST(least(256, greatest(3, p_size * 5)) AS INT) AS c, greatest(65536, p_partkey * 1000)::BIGINT AS t, 30 AS s FROM part)
SELECT k, 'clearest' AS role, w AS width, CAST(greatest(4, floor(f * 0.72 + 0.5)) AS INT) AS fps, c AS colours, t AS bytes FROM c
UNION ALL SELECT k, 'smoothest', CAST(floor(w * 0.78 / 2) * 2 AS INT), CAST(greatest(f, least(s, least(60, greatest(1, ceil(f * 1.35))))) AS INT), CAST(least(256, greatest(3, floor(c * 0.78 + 0.5))) AS INT), t FROM c
UNION ALL SELECT k, 'smallest', CAST(floor(w * 0.65 / 2) * 2 AS INT), CAST(greatest(3, floor(f * 0.6 + 0.5)) AS INT), CAST(least(256, greatest(3, floor(c * 0.55 + 0.5))) AS INT), CAST(greatest(65536, floor(t * 0.72 + 0.5)) AS BIGINT) FROM c""")
def target_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three profiles for each target."""
    k = F.col("p_partkey")
    rows = D.target_portfolio(F.col("p_size") * 20, F.col("p_size") % 50 + 1, F.col("p_size") * 5, k * 1000, F.lit(30))
    return table(spark, sf_dir, "part").select(k.alias("k"), F.inline(rows)).select("k", "role", "width", "fps", "colours", "bytes")


@query("""
WITH c AS (SELECT p_partkey AS k, (p_partkey % 60)::DOUBLE AS l, (p_partkey % 30)::DOUBLE AS t, (p_partkey % 90)::DOUBLE AS r, (p_partkey % 110)::DOUBLE AS b FROM part), q AS (SELECT *, 100 - l - least(r, 100 - l) AS w, 100 - t - least(b, 100 - t) AS h FROM c)
SELECT k, l AS x, t AS y, w AS width, h AS height, 100 - l - w AS right, 100 - t - h AS bottom, k % 2 = 0 AS even, greatest(2, CAST(floor((k * 8 + 2) * least(1.0, 320.0 / greatest(k * 8 + 2, k % 50 * 10 + 2)) / 2 + 0.5) * 2 AS INT)) AS fit FROM q""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insets, rectangles and back; dimensions that fit an edge."""
    k = F.col("p_partkey")
    d = lambda v: v.cast("double")
    rect = D.insets_to_rect(d(k % 60), d(k % 30), d(k % 90), d(k % 110))
    fit = S.even_fit(k * 8 + 2, k % 50 * 10 + 2, 320)
    s = table(spark, sf_dir, "part").select(k.alias("k"), rect.alias("r"), fit.alias("fit"))
    back = D.rect_to_insets(F.col("r.x"), F.col("r.y"), F.col("r.width"), F.col("r.height"))
    return s.select("k", "r.*", back.alias("i"), (F.col("k") % 2 == 0).alias("even"), "fit").select("k", "x", "y", "width", "height", "i.right", "i.bottom", "even", F.col("fit.width").cast("int").alias("fit"))


@query("""
WITH p AS (SELECT c_custkey AS pid, c_custkey // 3 AS parent, CASE WHEN c_custkey % 29 = 0 THEN 0 ELSE 100 + c_custkey - c_custkey % 13 * (CASE WHEN c_custkey % 17 = 0 THEN 50 ELSE 0 END) END AS started, CAST(floor(c_acctbal) AS BIGINT) AS rss FROM customer),
t AS (WITH RECURSIVE r(root, pid, depth) AS (SELECT pid, pid, 0 FROM p WHERE pid % 50 < 3 UNION ALL SELECT r.root, c.pid, depth + 1 FROM r JOIN p c ON c.parent = r.pid JOIN p q ON q.pid = c.parent WHERE c.started > 0 AND q.started > 0 AND c.started >= q.started AND c.pid <> c.parent) SELECT DISTINCT root, pid FROM r)
SELECT root, count(*) AS processes, CAST(sum(rss) AS BIGINT) AS rss, arg_max(pid, struct_pack(r := rss, p := -pid)) AS largest FROM t JOIN p USING (pid) GROUP BY 1""")
def process_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory of process trees, guarded against reused ids."""
    k = F.col("c_custkey")
    started = F.when(k % 29 == 0, 0).otherwise(100 + k - k % 13 * F.when(k % 17 == 0, 50).otherwise(0))
    p = table(spark, sf_dir, "customer").select(k.alias("pid"), F.expr("c_custkey div 3").alias("parent"), started.alias("started"), F.floor("c_acctbal").cast("long").alias("rss"))
    return R.process_trees(p, p.where("pid % 50 < 3").select("pid"))


@query("""
WITH s AS (SELECT user_id AS export, event_type AS stage, event_id, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) - epoch_us(ts) AS us FROM events) SELECT export, stage, count(*) AS calls, CAST(sum(us) AS BIGINT) AS elapsed_us FROM s WHERE us IS NOT NULL GROUP BY ALL""")
def stage_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive time of stages."""
    from fernweave.plans.registry import micros

    return R.stage_profile(table(spark, sf_dir, "events").select(F.col("user_id").alias("export"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), micros("ts").alias("at_us")))


def search_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of a search for each customer: its orders, whose prices are the sizes."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("search"),
        k.alias("seq"),
        F.lit(150000).alias("target"),
        F.lit(640).alias("base_width"),
        (100 + k % 27 * 20).cast("int").alias("width"),
        F.when(F.col("o_custkey") % 2 == 0, 15).otherwise(12).alias("fps"),
        F.lit(128).alias("colours"),
        F.lit(2).alias("bayer"),
        F.floor("o_totalprice").cast("long").alias("size"),
    )


#: Of next_candidates: most attempts of a search, and the tolerance in percent.
ATTEMPTS, TOLERANCE = 12, 2.0


@query()
def next_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next candidate of each size search, or why there is none, under a hard cap
    and for a symmetric match. A test holds it against a plain loop."""
    seen = search_observations(spark, sf_dir)
    modes = [R.next_candidates(seen, max_attempts=ATTEMPTS, tolerance_percent=TOLERANCE, symmetric=s).withColumn("symmetric", F.lit(s)) for s in (False, True)]
    return modes[0].union(modes[1])


_SEEN = """o AS (SELECT o_custkey AS search, o_orderkey AS seq, 100 + o_orderkey % 27 * 20 AS width, CASE WHEN o_custkey % 2 = 0 THEN 15 ELSE 12 END AS fps, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders),
a AS (SELECT search, width, fps, min(seq) AS seq, arg_max(size, seq) AS size FROM o GROUP BY ALL)"""


@query(f"""
WITH {_SEEN}, t AS (SELECT *, CASE WHEN size BETWEEN 147030 AND 150000 THEN 2 WHEN size <= 150000 THEN 1 ELSE 0 END AS tier FROM a),
b AS (SELECT search, arg_max(size, (tier, CASE WHEN tier = 0 THEN -abs(size - 150000) ELSE 0 END, width, fps, -size, seq)) AS size, count(*) AS attempts FROM t GROUP BY 1)
SELECT search, size, attempts, CASE WHEN size BETWEEN 147030 AND 150000 THEN 'exact' WHEN size <= 150000 THEN 'under' WHEN attempts < 12 THEN 'over' ELSE 'unreachable' END AS fit FROM b""")
def search_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each search's best attempt fits its hard cap; over while it has a next candidate."""
    seen = R.recorded(search_observations(spark, sf_dir))
    window = R.size_window(F.col("target"), TOLERANCE, symmetric=False)
    order = [F.col("width"), F.col("fps"), F.col("colours"), -F.col("size")]
    best = O.best_observation(seen, ["search"], "size", "target", window, order, "seq", ["size", "target"])
    n = seen.groupBy("search").agg(F.count("*").alias("attempts"))
    ahead = R.next_candidates(seen, max_attempts=ATTEMPTS, tolerance_percent=TOLERANCE).select("search", F.col("step").isNotNull().alias("searching"))
    fit = O.fit_label(F.col("size"), F.col("target"), window, F.col("searching"))
    return best.join(n, "search").join(ahead, "search").select("search", "size", "attempts", fit.alias("fit"))


_BYTES = "CAST(floor(p_retailprice * (4 + quality * 0.3) + p_partkey * quality % 97 * 5) AS BIGINT) + CASE WHEN mode = 'extra' THEN p_partkey % 13 * quality - 300 ELSE 0 END"
_GAP = "abs(bytes - target) * 200.0 / (bytes + target)"


@query(f"""
WITH RECURSIVE s AS (SELECT p_partkey AS search, 8000 + p_size * 600 AS target FROM part),
m AS (SELECT p_partkey AS search, quality, mode, {_BYTES} AS bytes FROM part, (SELECT unnest(range(1, 101)) AS quality), (SELECT unnest(['default', 'extra']) AS mode)),
h(search, target, low, high, turn, asked) AS (SELECT search, target, 1, 100, 0, []::INT[] FROM s UNION ALL
 SELECT h.search, target, CASE WHEN bytes < target THEN quality + 1 ELSE low END, CASE WHEN bytes < target THEN high ELSE quality - 1 END, turn + 1, list_append(asked, quality::INT)
 FROM h JOIN m ON m.search = h.search AND mode = 'default' AND quality = (low + high) // 2 WHERE low <= high),
e AS (SELECT * FROM h WHERE low > high),
d AS (SELECT DISTINCT search, target, quality, asked FROM (SELECT search, target, asked, unnest(list_concat(asked, [1, 100, 90], range(greatest(1, low - 4), least(100, low + 4) + 1))) AS quality FROM e)),
x AS (SELECT d.search, target, quality, bytes, coalesce(list_position(asked, quality::INT), 99) AS turn FROM d JOIN m USING (search, quality) WHERE mode = 'default'),
c AS (SELECT search, target, arg_min(quality, ({_GAP}, abs(bytes - target), turn, quality)) AS q FROM x GROUP BY ALL),
y AS (SELECT DISTINCT search, target, unnest(list_concat([100], range(greatest(1, q - 4), least(100, q + 4) + 1))) AS quality FROM c),
r AS (SELECT search, target, quality, 'default' AS mode, bytes FROM x UNION ALL SELECT y.search, target, quality, mode, bytes FROM y JOIN m USING (search, quality) WHERE mode = 'extra')
SELECT search, CAST(arg_min(quality, o) AS INT) AS quality, arg_min(mode, o) AS mode, arg_min(bytes, o) AS bytes, round(arg_min({_GAP}, o), 9) AS delta, count(*) AS attempts
FROM (SELECT *, ({_GAP}, abs(bytes - target), -quality, mode <> 'extra') AS o FROM r) GROUP BY search""")
def quality_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality and mode closest to each part's target, halved by all parts at once."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")

    def measure(asked: DataFrame) -> DataFrame:
        return asked.join(parts.hint("merge"), F.col("search") == F.col("p_partkey")).selectExpr("search", "quality", "mode", f"{_BYTES} AS bytes")

    found = R.quality_search(parts.select(F.col("p_partkey").alias("search"), (8000 + F.col("p_size") * 600).alias("target")), measure)
    return found.withColumn("delta", F.round("delta", 9))


@query("""
WITH g AS (SELECT w || '-' || f AS x, w, f FROM (SELECT unnest([96, 120]) AS w), (SELECT unnest(['bayer', 'sierra']) AS f)) SELECT x AS candidate, w AS width, f AS dither, s_suppkey, s_acctbal > w * 50 AS fits FROM g CROSS JOIN supplier""")
def tuning_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of parameters, each against every source."""
    grid = R.grid(spark, width=[96, 120], dither=["bayer", "sierra"])
    return table(spark, sf_dir, "supplier").crossJoin(F.broadcast(grid)).select("candidate", F.col("width").cast("int").alias("width"), "dither", "s_suppkey", (F.col("s_acctbal") > F.col("width") * 50).alias("fits"))


@query("""
WITH v AS (SELECT o_orderkey AS k, ['A', 'B', 'same', 'C'][o_orderkey % 4 + 1] AS ch, o_orderkey % 6 = 0 AS revealed FROM orders)
SELECT k, ch <> 'C' AND k % 5 > 0 AND k % 6 > 0 AS sound FROM v""")
def sound_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes whose fields are what they must be."""
    k = F.col("o_orderkey")
    choice = F.element_at(F.array(*map(F.lit, ["A", "B", "same", "C"])), (k % 4 + 1).cast("int"))
    expected = {"category": F.lit("x"), "formal": F.lit(True), "side_a": F.lit("p1"), "side_b": F.lit("p2")}
    vote = {
        "choice": choice, "revealed": k % 6 == 0, "first_at": F.lit(1), "last_at": F.lit(2), "category": F.when(k % 5 > 0, "x"), "formal": F.lit(True), "blind": F.lit(True), "side_a": F.lit("p1"), "side_b": F.lit("p2"),
        "chosen": F.when(choice == "A", "p1").when(choice == "B", "p2"), "revisions": F.lit(1),
    }
    return table(spark, sf_dir, "orders").select(k.alias("k"), D.vote_is_sound(vote, expected).alias("sound"))


@query("""
WITH e AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT user_id, event_id, k, k * 2 AS twice FROM e WHERE k IS NOT NULL""")
def exploded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed JSON, its arrays as rows."""
    text = F.concat(F.lit('{"rows": ['), "props", F.lit("]}"))
    parsed = table(spark, sf_dir, "events").select("user_id", "event_id", F.from_json(text, "rows array<struct<k:bigint>>").alias("d"))
    return SD.rows_of(parsed.select("user_id", "event_id", "d.rows"), "rows", ["user_id", "event_id"]).where("k is not null").withColumn("twice", F.col("k") * 2)


@query("""
WITH f AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN 'Bad Id' ELSE 'p-' || (p_partkey - p_partkey % 70 // 69) END AS id, p_brand AS category FROM part)
SELECT 'repeated id' AS name, id AS detail FROM f GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'bad id', id FROM f WHERE id = 'Bad Id' UNION ALL SELECT 'too few', 'none'""")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest breaks."""
    k = F.col("p_partkey")
    fixtures = table(spark, sf_dir, "part").select(F.when(k % 50 == 0, "Bad Id").otherwise(F.concat(F.lit("p-"), (k - F.expr("p_partkey % 70 div 69")).cast("string"))).alias("id"), F.col("p_brand").alias("category"))
    return SD.manifest_violations(fixtures, {"none": 4})


@query("""
SELECT l_returnflag AS category FROM (SELECT DISTINCT l_returnflag FROM lineitem) WHERE l_returnflag NOT IN (SELECT l_returnflag FROM lineitem WHERE l_quantity > 49.5 AND l_returnflag <> 'N')""")
def categories_without_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that have no decisive vote."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), "l_quantity")
    return J.unknown_keys(lines, lines.where("l_quantity > 49.5 and category <> 'N'"), ["category"])


@query()
def shared_anchor_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours that all segments' palettes share, greedily apart."""
    k = F.col("p_partkey")
    colours = table(spark, sf_dir, "part").select((k % 5).alias("key"), (k % 3).cast("int").alias("segment"), (k * 37 % 4 * 60).cast("int").alias("r"), (k * 91 % 7 * 40).cast("int").alias("g"), (k * 53 % 5 * 50).cast("int").alias("b"))
    return R.separated_colours(R.shared_colours(colours.select("key", "r", "g", "b").distinct(), colours.where("segment < 2")))


@query("""
SELECT p_partkey AS k, CASE WHEN p_partkey % 4 > 0 THEN 'packaged' ELSE 'development' END AS context, CASE WHEN p_partkey % 4 = 0 THEN 'unverified' WHEN p_partkey % 3 = 0 THEN 'mismatch' WHEN p_partkey % 5 = 0 THEN 'trusted' ELSE 'unverified' END AS status FROM part""")
def release_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a packaged build is worth."""
    k = F.col("p_partkey")
    t = D.trust_state(k % 4 > 0, k % 3 > 0, F.lit(True), F.lit(True), k % 5 == 0, F.lit(True))
    return table(spark, sf_dir, "part").select(k.alias("k"), t.alias("t")).select("k", "t.context", "t.status")


@query("""
WITH s AS (SELECT p_brand AS k, avg(p_size) AS a, min(p_size) AS b FROM part GROUP BY 1) SELECT k, metric, value FROM (SELECT k, 'a' AS metric, a AS value FROM s UNION ALL SELECT k, 'b', b::DOUBLE FROM s)""")
def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric by its name."""
    s = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("k")).agg(F.avg("p_size").alias("a"), F.min("p_size").alias("b"))
    return G.unpivoted(s, ["k"], ["a", "b"])


@query("""
WITH c AS (SELECT p_partkey AS k, CAST(p_partkey * 37 % 256 AS INT) AS r, CAST(p_partkey * 91 % 256 AS INT) AS g, CAST(p_partkey * 53 % 256 AS INT) AS b FROM part) SELECT k, r, g, b FROM c""")
def oklab_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours to the perceptual space and back."""
    k = F.col("p_partkey")
    c = lambda n: (k * n % 256).cast("int")
    lab = table(spark, sf_dir, "part").select(k.alias("k"), S.oklab(c(37), c(91), c(53)).alias("lab"))
    return lab.select("k", D.oklab_to_rgb(F.col("lab")).alias("c")).select("k", "c.*")


@query("""
SELECT o_orderkey AS k, CASE WHEN 200000 <= s OR abs(200000 - s) * 200.0 / (200000 + s) <= 5 THEN 64 ELSE (SELECT min(x) FROM (SELECT unnest([3, 4, 8, 16, 24, 32, 48, 64, 80, 96, 112, 128, 160, 192, 224, 256]) AS x UNION ALL SELECT 256) WHERE x >= least(256, greatest(64, CAST(ceil(64 * (200000.0 / greatest(s, 1)) * (200000.0 / greatest(s, 1))) AS INT)))) END AS ceiling
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)""")
def colour_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette sizes that spare bytes allow."""
    size = F.floor("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), M.colour_ceiling(F.lit(64), F.lit(200000), size).alias("ceiling"))
