"""Colours, histograms, rules and texts, over parts, documents and pages."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweave.functions import media as M, scalar as S
from fernweave.operators import aggregate as A
from fernweave.plans.registry import query, table

_RGB = "rgb AS (SELECT p_partkey, CAST(p_partkey * 37 % 256 AS INT) AS r, CAST(p_partkey * 91 % 256 AS INT) AS g, CAST(p_partkey * 53 % 256 AS INT) AS b, p_size FROM part)"


def _rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda k, n: (F.col("p_partkey") * k % 256).cast("int").alias(n)
    return table(spark, sf_dir, "part").select("p_partkey", c(37, "r"), c(91, "g"), c(53, "b"), "p_size")


_LIN = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
_LAB = (
    "lin AS (SELECT p_partkey, " + ", ".join(f"CAST({_LIN.format(c)} AS DOUBLE) AS {c}" for c in "rgb") + " FROM rgb), "
    "lms AS (SELECT p_partkey, " + ", ".join(f"cbrt({m[0]} * r + {m[1]} * g + {m[2]} * b) AS {n}" for m, n in zip(S.TO_LMS, ("x", "y", "z"), strict=True)) + " FROM lin), "
    "lab AS (SELECT p_partkey, " + ", ".join(f"{m[0]} * x + {m[1]} * y + {m[2]} * z AS {n}" for m, n in zip(S.TO_LAB, ("l", "a", "b"), strict=True)) + " FROM lms)"
)


@query(f"""WITH {_RGB}, {_LAB} SELECT p_partkey, round(l, 6) AS l, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(sqrt(pow(l - 0.5, 2) + pow(a, 2) + pow(b, 2)), 6) AS from_grey FROM lab""")
def oklab_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours in a perceptual space and their distance from a grey."""
    lab = _rgb(spark, sf_dir).select("p_partkey", S.oklab(F.col("r"), F.col("g"), F.col("b")).alias("lab"))
    grey = F.struct(F.lit(0.5).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    return lab.select("p_partkey", *[(F.round(F.col("lab")[n], 6) + 0.0).alias(n) for n in ("l", "a", "b")], F.round(S.oklab_distance(F.col("lab"), grey), 6).alias("from_grey"))


@query(f"""WITH {_RGB} SELECT p_partkey, (54 * r + 183 * g + 19 * b) >> 8 AS luma, CAST(round(r * 0.2126 + g * 0.7152 + b * 0.0722, 6) AS DOUBLE) AS luma709, ((r >> 3) << 10) | ((g >> 3) << 5) | (b >> 3) AS bin,
(r > 95 AND g > 40 AND b > 20 AND greatest(r, g, b) - least(r, g, b) > 15 AND abs(r - g) > 15 AND r > g AND r > b) OR (r > 200 AND g > 170 AND b > 120 AND r >= g AND g > b AND abs(r - g) <= 45) AS skin,
CAST(round((r * p_size + 128 * (255 - p_size)) / 255.0) AS INT) AS over_grey FROM rgb""")
def pixel_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma, skin, histogram bins and compositing."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return _rgb(spark, sf_dir).select(
        "p_partkey", S.luma8(r, g, b).alias("luma"), F.round(S.luma709(r, g, b), 6).alias("luma709"), S.histogram_bin(r, g, b, 5).alias("bin"), M.is_skin(r, g, b).alias("skin"),
        S.over_background(r, F.col("p_size"), 128).alias("over_grey"),
    )


@query(f"""WITH {_RGB} SELECT p_size % 5 AS frame, ((r >> 5) << 6) | ((g >> 5) << 3) | (b >> 5) AS bin, CAST(sum(p_size) AS BIGINT) AS weight, CAST(sum(r * p_size) AS BIGINT) AS r_sum, CAST(sum(g * p_size) AS BIGINT) AS g_sum, CAST(sum(b * p_size) AS BIGINT) AS b_sum FROM rgb GROUP BY ALL""")
def colour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted colour bins of each frame."""
    pixels = _rgb(spark, sf_dir).withColumn("frame", F.col("p_size") % 5)
    return A.colour_histogram(pixels, ["frame"], S.histogram_bin(F.col("r"), F.col("g"), F.col("b"), 3), F.col("p_size"), ["r", "g", "b"])


@query("""
WITH a AS (SELECT p_type, p_size AS bin, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL), b AS (SELECT p_type, p_size AS bin, count(*) AS n FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL),
j AS (SELECT p_type, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (p_type, bin)), s AS (SELECT p_type, sum(x) AS sx, sum(y) AS sy FROM j GROUP BY 1)
SELECT p_type, round(sum(abs(coalesce(x / nullif(sx, 0), 0) - coalesce(y / nullif(sy, 0), 0))) / 2, 9) AS distance FROM j JOIN s USING (p_type) GROUP BY 1""")
def histogram_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two histograms of a type are apart."""
    half = lambda i: table(spark, sf_dir, "part").where(f"p_partkey % 2 = {i}").groupBy("p_type", F.col("p_size").alias("bin")).agg(F.count("*").alias("n"))
    return A.histogram_distance(half(0), half(1), ["p_type"], "bin", "n").withColumn("distance", F.round("distance", 9))


@query("""
SELECT doc_id, CAST(conv_bit AS INT) AS swapped FROM (SELECT doc_id, strpos('13579bdf', right(sha256('run-7:' || doc_id), 1)) > 0 AS conv_bit FROM documents)""")
def parity_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fair and repeatable coin for each document."""
    return table(spark, sf_dir, "documents").select("doc_id", S.parity(F.concat(F.lit("run-7:"), F.col("doc_id").cast("string"))).alias("swapped"))


@query("""
SELECT doc_id, sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS fingerprint FROM documents""")
def canonical_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of rows as JSON with sorted keys."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct("source", "n_chars", "lang").alias("row"))
    return docs.select("doc_id", F.sha2(S.canonical_json(F.col("row"), ["source", "n_chars", "lang"]), 256).alias("fingerprint"))


@query(r"""
SELECT page_id, regexp_replace(url, '[a-zA-Z]:[/\\][^\s<>:"|?*]*', '[path]', 'g') || ' [task] in [path], then [task] at [path], [task] from [path] input=[path]; last [path]' AS redacted FROM pages""")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and local paths replaced by marks; the end of a scheme looks like a drive."""
    i = F.col("page_id").cast("string")
    said = [
        "url", F.lit(" task-"), i, F.lit("x in /home/u"), i, F.lit("/a.gif, then task_id="), i, F.lit(' at "C:\\tmp\\'), i, F.lit('.png", APP_TASK_CANCELLED:'), i,
        F.lit("-z from D:\\My Files\\"), i, F.lit(" b.gif input=e:/x/"), i, F.lit("; last f:\\a b\\c d.gif"),
    ]
    return table(spark, sf_dir, "pages").select("page_id", M.redact(F.concat(*said)).alias("redacted"))


@query("""
SELECT page_id, CASE page_id % 13 % 7 WHEN 0 THEN 'disk-space' WHEN 1 THEN 'permission' WHEN 2 THEN 'dependency' WHEN 3 THEN 'output-path' WHEN 4 THEN 'input-media' WHEN 5 THEN 'cancelled' ELSE 'unknown' END AS category FROM pages""")
def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure texts by the first pattern that they have, in two languages."""
    said = ["No space left on device", "Access is denied", "ffmpeg: not found", "Output path does not exist", "Invalid data found when processing", "Operation was aborted", "strange"]
    said += ["磁盘空间不足", "没有权限", "转换组件", "输出路径 C 不存在", "素材已损坏", "任务已停止"]
    text = F.element_at(F.array(*map(F.lit, said)), (F.col("page_id") % 13 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", M.failure_category(text).alias("category"))


@query("""
WITH c AS (SELECT p_partkey AS id, p_size * 10 AS w, p_size * 6 AS h, CAST(p_partkey % 20 + 5 AS INT) AS fps, (p_partkey % 300) / 10.0 AS dur, CASE p_partkey % 4 WHEN 0 THEN 'gif' WHEN 1 THEN 'webp' WHEN 2 THEN 'mp4' ELSE 'apng' END AS f FROM part),
e AS (SELECT *, CASE f WHEN 'gif' THEN 0.32 + 64 / 1000.0 - 46 / 1500.0 ELSE 0.32 + 64 / 1000.0 - 46 / 1500.0 END AS per, CASE f WHEN 'gif' THEN 1.0 WHEN 'webp' THEN 0.4 WHEN 'mp4' THEN 0.1 ELSE 2.8 END AS factor FROM c),
l AS (SELECT *, greatest(16384, CAST(floor(w * h * fps * dur * CAST(per AS DOUBLE) * CAST(factor AS DOUBLE) + 0.5) AS BIGINT)) AS likely FROM e)
SELECT id, likely, CAST(floor(likely * 0.78 + 0.5) AS BIGINT) AS lower, CAST(floor(likely * 1.3 + 0.5) AS BIGINT) AS upper, least(CASE WHEN dur >= 12 THEN 8 WHEN dur >= 6 THEN 10 WHEN dur >= 3 THEN 12 ELSE 15 END, greatest(6, least(30, fps))) AS start_fps,
 CASE WHEN dur >= 10 OR fps >= 30 THEN CASE WHEN id % 3 = 0 THEN 'webm' ELSE 'mp4' END WHEN f = 'gif' AND id % 3 <> 0 THEN 'gif' WHEN id % 3 = 0 AND id % 2 = 0 THEN 'apng' ELSE 'webp' END AS recommended FROM l""")
def delivery_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated sizes, starting frame rates and recommended formats."""
    p = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ["gif", "webp", "mp4", "apng"])), (p % 4 + 1).cast("int"))
    c = table(spark, sf_dir, "part").select(p.alias("id"), (F.col("p_size") * 10).alias("w"), (F.col("p_size") * 6).alias("h"), (p % 20 + 5).cast("int").alias("fps"), ((p % 300) / 10.0).alias("dur"), kind.alias("f"))
    size = M.estimated_bytes(F.col("w"), F.col("h"), F.col("fps"), F.col("dur"), F.col("f"))
    focus = F.when(F.col("id") % 2 == 0, "text_ui").otherwise("subject")
    best = M.recommended_format(F.lit("smart"), F.col("dur"), F.col("fps"), F.col("id") % 3 == 0, focus, F.col("f"))
    return c.select("id", size.alias("s"), M.starting_fps(F.col("dur"), F.col("fps")).alias("start_fps"), best.alias("recommended")).select("id", "s.*", "start_fps", "recommended")


@query("""
WITH c AS (SELECT o_orderkey AS id, o_totalprice AS v, o_orderkey % 400 AS d FROM orders)
SELECT id, greatest((d >= 12)::INT + (d >= 45)::INT + (d >= 120)::INT + (d >= 300)::INT, (v * 4000 >= 40000000)::INT + (v * 4000 >= 150000000)::INT + (v * 4000 >= 500000000)::INT + (v * 4000 >= 1500000000)::INT) AS level,
 ['short', 'short', 'standard', 'long', 'extreme'][greatest((d >= 12)::INT + (d >= 45)::INT + (d >= 120)::INT + (d >= 300)::INT, (v * 4000 >= 40000000)::INT + (v * 4000 >= 150000000)::INT + (v * 4000 >= 500000000)::INT + (v * 4000 >= 1500000000)::INT) + 1] AS tier,
 CASE WHEN d < 4 THEN least(19, 8 + floor(d * 3)) WHEN d < 15 THEN least(42, 20 + floor((d - 4) * 2)) ELSE least(94, 43 + floor(48 * (1 - exp(-(d - 15) / 38.0)))) END::INT AS progress FROM c""")
def load_and_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load tiers and estimated progress."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 400).alias("d"), (F.col("o_totalprice") * 4000).alias("b"))
    level = M.load_level({"duration_s": F.col("d"), "bytes": F.col("b")})
    return orders.select("id", level.alias("level"), M.load_tier(level).alias("tier"), S.heartbeat(F.col("d"), searching=True).alias("progress"))


@query("""
WITH s AS (SELECT p_partkey AS id, (p_partkey % 11) / 10.0 AS a, (p_partkey % 7) / 6.0 AS b, (p_partkey % 5) / 50.0 AS c FROM part)
SELECT id, round(greatest(0, least(1, CASE WHEN id % 2 = 0 THEN a * 0.39 + b * 0.22 + c * 0.2 + a * 0.06 + b * 0.08 - c * 0.06
  ELSE a * 0.28 + c * 0.21 + b * 0.15 + a * 0.12 + b * 0.09 + (1 - c) * 0.08 - c * 0.07 END)), 9) AS importance,
 CASE WHEN b >= 0.18 AND (a >= 0.025 OR c >= 0.02) AND a <= 0.32 THEN 'skin_subject' WHEN c >= 0.08 AND a <= 0.38 AND b <= 0.20 THEN 'text_edge' WHEN c >= 0.012 THEN 'texture' WHEN a <= 0.08 AND c <= 0.05 THEN 'flat' ELSE 'texture' END AS region FROM s""")
def frame_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of frames, of an unknown focus too, and classes of regions."""
    p = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(p.alias("id"), ((p % 11) / 10.0).alias("a"), ((p % 7) / 6.0).alias("b"), ((p % 5) / 50.0).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    signals = {"motion": a, "changed_area": b, "scene_change": c, "edge_text": a, "subject_saliency": b, "compression_cost": c, "noise": c, "skin_ratio": a}
    return s.select("id", F.round(M.frame_importance(signals, F.when(F.col("id") % 2 == 0, "motion").otherwise("auto")), 9).alias("importance"), M.region_class(a, c, b, b, c).alias("region"))


@query("""
SELECT page_id, regexp_matches(url, '^[a-z0-9]+(-[a-z0-9]+)*$') AS plain, 'site/' || page_id || '.gif' IS NOT NULL AND page_id % 2 = 0 AS safe, CASE page_id % 3 WHEN 0 THEN 'animation' WHEN 1 THEN 'video' END AS kind,
 CASE WHEN page_id > 0 THEN round(10 * log10(65025.0 / page_id), 6) END AS psnr FROM pages""")
def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, paths, kinds and signal-to-noise ratios."""
    i = F.col("page_id")
    path = F.concat(F.when(i % 2 == 0, "site/").otherwise("site/../"), i.cast("string"), F.lit(".gif"))
    name = F.concat(F.lit("x."), F.element_at(F.array(*map(F.lit, ["GIF", "mp4", "txt"])), (i % 3 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", S.is_plain_id(F.col("url")).alias("plain"), S.is_safe_relative_path(path).alias("safe"), M.asset_kind(name).alias("kind"), F.round(S.psnr(i.cast("double")), 6).alias("psnr"))
