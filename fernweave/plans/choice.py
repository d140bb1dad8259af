"""Choosing rows: preferences, skylines, adoption, nearest centres and clustering."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweave.functions import scalar as S
from fernweave.operators import relational as J, select as O
from fernweave.operators.search import size_window
from fernweave.plans.registry import query, table

_CANDIDATES = """c AS (SELECT p_partkey AS seq, p_brand AS k, p_size AS width, CAST(p_partkey % 5 AS INT) * 6 AS fps, CAST(p_partkey % 3 AS INT) * 64 AS colours, CAST(floor(p_retailprice * 10) AS BIGINT) AS bytes FROM part)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("seq"), F.col("p_brand").alias("k"), F.col("p_size").alias("width"), ((F.col("p_partkey") % 5).cast("int") * 6).alias("fps"),
        ((F.col("p_partkey") % 3).cast("int") * 64).alias("colours"), F.floor(F.col("p_retailprice") * 10).cast("long").alias("bytes"),
    )


@query(f"""WITH {_CANDIDATES} SELECT k, arg_max(seq, (width, fps, colours, -bytes, seq)) AS balanced, arg_max(seq, (width, colours, fps, -bytes, seq)) AS clarity,
arg_max(seq, (fps, width, colours, -bytes, seq)) AS smoothness, arg_max(seq, (-bytes, seq)) AS smallest FROM c GROUP BY k""")
def preference_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred candidate of each brand, by four preferences."""
    c = _candidates(spark, sf_dir)
    out = None
    for name in ("balanced", "clarity", "smoothness", "smallest"):
        one = O.preferred(c, ["k"], O.by_preference(name), "seq", ["seq"]).withColumnRenamed("seq", name)
        out = one if out is None else out.join(one, "k")
    return out


#: A target of 15000 bytes is hit from 14703 to 15303: 2 percent of the mean, either way.
_TARGET, _LEAST, _CEILING = 15000, 14703, 15303


@query(f"""WITH {_CANDIDATES}, s AS (SELECT *, CASE WHEN bytes BETWEEN {_LEAST} AND {_CEILING} THEN 2 WHEN bytes <= {_CEILING} THEN 1 ELSE 0 END AS tier FROM c)
SELECT k, arg_max(seq, (tier, CASE WHEN tier = 0 THEN -abs(bytes - {_TARGET}) ELSE 0 END, width, fps, colours, -bytes, seq)) AS seq,
arg_max(bytes, (tier, CASE WHEN tier = 0 THEN -abs(bytes - {_TARGET}) ELSE 0 END, width, fps, colours, -bytes, seq)) AS bytes FROM s GROUP BY k""")
def best_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact window first, then what is under the selection ceiling, then the closest."""
    c = _candidates(spark, sf_dir).withColumn("target", F.lit(_TARGET))
    return O.best_observation(c, ["k"], "bytes", "target", size_window(F.col("target"), 2.0), O.by_preference("balanced"), "seq", ["seq", "bytes"])


@query(f"""WITH {_CANDIDATES} SELECT seq, CASE WHEN bytes BETWEEN {_LEAST} AND {_CEILING} THEN 'exact' WHEN bytes <= 15000 THEN 'under' WHEN width > 5 THEN 'over' ELSE 'unreachable' END AS fit,
round(abs(bytes - 15000) * 200.0 / (bytes + 15000), 9) AS deviation, abs(bytes - 15000) * 200.0 / (bytes + 15000) <= 3 AND bytes <= 15000 AS under_cap FROM c""")
def fit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How candidates fit a target."""
    target = F.lit(15000)
    return _candidates(spark, sf_dir).select(
        "seq", O.fit_label(F.col("bytes"), target, size_window(target, 2.0), F.col("width") > 5).alias("fit"), F.round(S.symmetric_delta_percent(F.col("bytes"), target), 9).alias("deviation"),
        S.within_tolerance(F.col("bytes"), target, 3.0, hard_cap=True).alias("under_cap"),
    )


_ROUTES = ["baseline", "sierra_quality", "alternate_stats", "perceptual_timeline", "perceptual_reinvest", "perceptual_reinvest_corrected"]
_ROUTE = f"""r AS (SELECT o_custkey AS k, o_orderkey AS seq, {_ROUTES}[o_orderkey % 6 + 1] AS route,
 CASE WHEN o_orderkey % 4 = 1 THEN 'sierra2_4a' ELSE 'bayer' END AS dither, CASE WHEN o_orderkey % 3 = 0 THEN 'full' ELSE 'diff' END AS stats_mode,
 CASE WHEN o_orderkey % 11 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS size, o_orderkey % 6 < 3 AS cfr, 150000 AS target FROM orders),
e AS (SELECT *, size <= target AS fits, abs(size - target) * 200.0 / (size + target) AS apart FROM r WHERE size IS NOT NULL)"""
_RANK = "CASE route WHEN 'perceptual_reinvest_corrected' THEN 2 WHEN 'perceptual_reinvest' THEN 1 ELSE 0 END"
_BY = {
    "symmetric": "(apart <= 5, -apart, route = 'baseline', -seq)",
    "clarity": f"(fits, {_RANK}, dither = 'sierra2_4a', stats_mode = 'diff', route <> 'perceptual_timeline', route = 'baseline', -size, seq)",
    "smallest": "(fits, -size, -seq)",
    "balanced": "(fits, route = 'baseline', stats_mode = 'diff', dither = 'bayer', -size, seq)",
}


@query(f"WITH {_ROUTE} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, k, arg_max(seq, {o}) AS seq, arg_max(route, {o}) AS route, arg_max(size, {o}) AS size FROM e {'WHERE cfr' if n == 'symmetric' else ''} GROUP BY k" for n, o in _BY.items()))
def selected_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route that each customer's target chooses, by three preferences under a hard cap
    and by a symmetric match."""
    k = F.col("o_orderkey")
    routes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), k.alias("seq"), F.element_at(F.array(*map(F.lit, _ROUTES)), (k % 6 + 1).cast("int")).alias("route"),
        F.when(k % 4 == 1, "sierra2_4a").otherwise("bayer").alias("dither"), F.when(k % 3 == 0, "full").otherwise("diff").alias("stats_mode"),
        F.when(k % 11 > 0, F.floor("o_totalprice").cast("long")).alias("size"), (k % 6 < 3).alias("cfr"),
    )
    chosen = lambda n, symmetric: O.select_route(routes, ["k"], "seq", n, F.lit("diff"), F.lit(150000), 5.0, symmetric).select(F.lit("symmetric" if symmetric else n).alias("rule"), "k", "seq", "route", "size")
    out = chosen("balanced", True)
    for name in ("clarity", "smallest", "balanced"):
        out = out.union(chosen(name, False))
    return out


@query(f"""WITH {_CANDIDATES}, f AS (SELECT * FROM c WHERE bytes <= {_CEILING})
SELECT k, seq, bytes, width, fps, colours FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.k = a.k AND b.bytes <= a.bytes AND b.width >= a.width AND b.fps >= a.fps AND b.colours >= a.colours
AND (b.bytes < a.bytes OR b.width > a.width OR b.fps > a.fps OR b.colours > a.colours))""")
def pareto_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates under the selection ceiling that none of their brand dominates."""
    _, ceiling = size_window(F.lit(_TARGET), 2.0)
    found = O.skyline(_candidates(spark, sf_dir), ["k"], ["bytes"], ["width", "fps", "colours"], F.col("bytes") <= ceiling)
    return found.select("k", "seq", "bytes", "width", "fps", "colours")


@query(f"""WITH {_CANDIDATES} SELECT k, arg_max(seq, (-abs(bytes - 14000) * 200.0 / (bytes + 14000), -abs(bytes - 14000), width, -seq)) AS seq FROM c GROUP BY k""")
def size_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate closest in size."""
    return O.size_matched(_candidates(spark, sf_dir).withColumn("target", F.lit(14000)), ["k"], "bytes", "target", "width", "seq", ["seq"])


@query(f"""WITH {_CANDIDATES} SELECT k, arg_max(seq, (-bytes, -seq)) AS seq, min(bytes) AS bytes FROM c WHERE width > 10 AND 20000 - bytes >= greatest(64.0, 200.0) GROUP BY k""")
def smallest_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest accepted candidate that saves enough."""
    c = _candidates(spark, sf_dir).withColumn("accepted", F.col("width") > 10).withColumn("base", F.lit(20000))
    return O.smallest_accepted(c, ["k"], "accepted", "bytes", "base", "seq", ["seq", "bytes"])


@query(f"""WITH {_CANDIDATES}, a AS (SELECT *, CASE WHEN width = 7 THEN NULL ELSE bytes END AS cand, 14000 + seq % 100 AS orig, 13500 AS control FROM c),
s AS (SELECT *, CASE WHEN cand IS NULL THEN 'no_candidate' WHEN fps = 0 THEN 'rejected' WHEN cand > 18000 THEN 'over_cap' WHEN cand >= orig OR cand >= control THEN 'no_gain' ELSE 'adopted' END AS status FROM a)
SELECT seq, status, CASE WHEN status = 'adopted' THEN cand ELSE orig END AS bytes FROM s""")
def adopt_or_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate is adopted only where it gains on original and control."""
    made = O.adopt(F.when(F.col("width") != 7, F.col("bytes")), 14000 + F.col("seq") % 100, F.lit(13500), F.lit(18000), F.col("fps") != 0)
    return _candidates(spark, sf_dir).select("seq", made.alias("m")).select("seq", "m.*")


@query(f"""WITH {_CANDIDATES} SELECT k, arg_max(seq, colours * 100000 + width * 1000 + seq % 1000) AS seq, max(colours * 100000 + width * 1000 + seq % 1000) AS rung FROM c WHERE bytes <= 14500 GROUP BY k""")
def first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest rung of a ladder under a cap."""
    c = _candidates(spark, sf_dir).withColumn("cap", F.lit(14500)).withColumn("rung", F.col("colours") * 100000 + F.col("width") * 1000 + F.col("seq") % 1000)
    return O.first_fit(c, ["k"], "bytes", "cap", "rung", "seq", ["seq", "rung"])


@query(f"""WITH {_CANDIDATES} SELECT seq, CASE WHEN bytes < 15000 THEN greatest(width, least(CAST(floor(width * sqrt(15000.0 / bytes) * 0.96) AS INT), 60)) ELSE width END AS grown,
CASE WHEN bytes < 15000 THEN CAST(floor(sqrt(width * width + ((width + 20) * (width + 20) - width * width) * ((15000 * 0.98 - bytes) / (30000.0 - bytes)))) AS INT) END AS corrected FROM c""")
def reinvested_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths that spend spare bytes, and their correction."""
    return _candidates(spark, sf_dir).select(
        "seq", O.reinvested_width(F.col("width"), F.col("bytes"), F.lit(15000), F.lit(60)).alias("grown"),
        O.area_interpolated_width(F.col("width"), F.col("width") + 20, F.col("bytes"), F.lit(30000), F.lit(15000)).alias("corrected"),
    )


@query(f"""WITH {_CANDIDATES} SELECT k, min(width) AS x0, min(fps) AS y0, max(width + 3) AS x1, max(fps + colours) AS y1 FROM c GROUP BY k""")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around all boxes of a key."""
    boxes = _candidates(spark, sf_dir).select("k", F.col("width").alias("x0"), F.col("fps").alias("y0"), (F.col("width") + 3).alias("x1"), (F.col("fps") + F.col("colours")).alias("y1"))
    return O.bounding_box(boxes, ["k"], "x0", "y0", "x1", "y1")


@query(f"""WITH {_CANDIDATES} SELECT seq, k, CAST(row_number() OVER (PARTITION BY k ORDER BY round(width * colours / (fps + 1.0), 3) DESC, seq) AS INT) AS rank FROM c""")
def priority_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows ranked by a rounded score, ties by name."""
    score = F.round(F.col("width") * F.col("colours") / (F.col("fps") + 1.0), 3)
    return O.ranked(_candidates(spark, sf_dir), ["k"], [score.desc(), F.col("seq")]).select("seq", "k", "rank")


_CENTRES = [[round(((i * 7 + j * 3) % 11 - 5) / 20, 2) for j in range(64)] for i in range(5)]
_DISTANCES = ", ".join(f"struct_pack(d := {' + '.join(f'(CAST(embedding[{j + 1}] AS DOUBLE) - {c}) * (CAST(embedding[{j + 1}] AS DOUBLE) - {c})' for j, c in enumerate(centre))}, centre := {i})" for i, centre in enumerate(_CENTRES))


@query(f"""SELECT vec_id, b.centre AS centre, round(b.d, 6) AS distance_squared FROM (SELECT vec_id, list_min([{_DISTANCES}]) AS b FROM embeddings)""")
def nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of five centres."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return J.nearest_centres(points, "vec_id", "v", _CENTRES).withColumn("distance_squared", F.round("distance_squared", 6))


@query()
def kmeans_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted k-means with farthest-first seeds. Iterative; a test holds it against a plain loop."""
    from fernweave.operators.clusters import weighted_kmeans

    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.lit(1.0).alias("w"))
    centres = weighted_kmeans(points, 6)
    return spark.createDataFrame([(i, [round(x, 6) for x in c]) for i, c in enumerate(centres)], "centre int, v array<double>")
