"""Gates whose inputs break each of their rules somewhere."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweave.operators import gates as G
from fernweave.plans.registry import query, table


@query("""
WITH e AS (SELECT c_custkey AS pair, c_mktsegment AS category FROM customer WHERE c_nationkey % 3 > 0),
v AS (SELECT o_orderkey % 4 AS reviewer, o_custkey AS pair, min(CASE WHEN o_totalprice > 160000 THEN 'loss' WHEN o_orderkey % 5 = 0 THEN 'tie' ELSE 'win' END) AS outcome FROM orders GROUP BY ALL),
c AS (SELECT reviewer, pair, outcome, category FROM v JOIN e USING (pair)), due AS (SELECT count(*) AS due FROM e),
n AS (SELECT r.reviewer, count(c.pair) AS n FROM (SELECT DISTINCT reviewer FROM v) r LEFT JOIN c USING (reviewer) GROUP BY 1), w AS (SELECT count(*) AS reviewers, sum(n) / (count(*) * max(due)) AS coverage, count(*) FILTER (n = due) AS complete FROM n, due),
t AS (SELECT category, count(*) FILTER (outcome = 'win') / nullif(count(*) FILTER (outcome <> 'tie'), 0) AS rate FROM c GROUP BY GROUPING SETS ((), (category)))
SELECT 'reviewers' AS "check", NULL AS category, reviewers::DOUBLE AS value, reviewers >= 3 AS passed FROM w UNION ALL SELECT 'coverage', NULL, round(coverage, 9), coverage = 1 FROM w
UNION ALL SELECT 'complete reviewers', NULL, complete, complete = reviewers FROM w UNION ALL SELECT 'overall', NULL, round(rate, 9), rate >= 0.6 FROM t WHERE category IS NULL
UNION ALL SELECT 'category', category, round(rate, 9), coalesce(rate >= 0.45, false) FROM (SELECT DISTINCT category FROM e) LEFT JOIN t USING (category)""")
def reviewer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers, coverage and rates of a blind review against their floors."""
    k = F.col("o_orderkey")
    outcome = F.when(F.col("o_totalprice") > 160000, "loss").when(k % 5 == 0, "tie").otherwise("win")
    votes = table(spark, sf_dir, "orders").select((k % 4).alias("reviewer"), F.col("o_custkey").alias("pair"), outcome.alias("outcome"))
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pair"), F.col("c_mktsegment").alias("category"), (F.col("c_nationkey") % 3 > 0).alias("formal"))
    return G.reviewer_gate(votes, expected).withColumn("value", F.round("value", 9))


_SLICES = """
s AS (SELECT c_custkey AS fixture, n_name AS category FROM customer JOIN nation ON n_nationkey = c_nationkey),
c AS (SELECT o_custkey AS fixture, ['vmaf_neg_mean', 'vmaf_neg_p05', 'edge_error'][CAST(o_orderkey % 3 + 1 AS INT)] AS metric, CAST(floor(min(o_totalprice)) AS BIGINT) % 400 AS x FROM orders GROUP BY ALL),
o AS (SELECT fixture, category, metric, CASE WHEN x < 60 THEN 'loss' WHEN x < 90 THEN 'tie' ELSE 'win' END AS outcome, (x - 60) / 100.0 AS improvement, x = 0 AS severe FROM c JOIN s USING (fixture)),
t AS (SELECT category, metric, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'tie') AS ties, count(*) FILTER (severe) AS severe, count(*) AS applicable, avg(improvement) AS mean FROM o GROUP BY GROUPING SETS ((category, metric), (metric))),
z AS (SELECT category, count(*) AS expected, count(*) FILTER (fixture IN (SELECT fixture FROM c)) AS eligible FROM s GROUP BY GROUPING SETS ((category), ())),
a AS (SELECT z.category, m.metric, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(ties, 0) AS ties, coalesce(severe, 0) AS severe, coalesce(applicable, 0) AS applicable, expected, eligible, mean
  FROM z CROSS JOIN (SELECT unnest(['vmaf_neg_mean', 'vmaf_neg_p05', 'edge_error', 'alpha_coverage_error']) AS metric) m LEFT JOIN t ON t.category IS NOT DISTINCT FROM z.category AND t.metric = m.metric),
f AS (SELECT category, metric, wins, losses, ties, severe, applicable, expected, eligible, CASE WHEN applicable = 0 THEN category IS NOT NULL WHEN severe > 0 THEN false
  WHEN category IS NULL AND metric = 'vmaf_neg_mean' THEN wins / applicable >= 0.6 AND losses / applicable <= 0.1 AND mean >= 0.5 WHEN category IS NULL AND metric = 'vmaf_neg_p05' THEN losses / applicable <= 0.25 AND mean >= -0.5
  WHEN category IS NULL THEN losses / applicable <= 0.25 AND mean * 4 >= 0 WHEN metric = 'vmaf_neg_mean' THEN losses / applicable <= 0.25 AND mean >= -0.25 WHEN metric = 'vmaf_neg_p05' THEN losses / applicable <= 0.25
  ELSE losses / applicable <= 0.25 AND mean * 4 >= -0.5 END AS passed FROM a)"""


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("category"))
    sources = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("fixture"), "category")
    metric = F.element_at(F.array(*map(F.lit, ("vmaf_neg_mean", "vmaf_neg_p05", "edge_error"))), (k % 3 + 1).cast("int"))
    x = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("fixture"), metric.alias("metric")).agg((F.floor(F.min("o_totalprice")) % 400).alias("x"))
    better = ((F.col("x") - 60) / 100.0).alias("improvement")
    compared = x.select("fixture", "metric", F.when(F.col("x") < 60, "loss").when(F.col("x") < 90, "tie").otherwise("win").alias("outcome"), better, (better * 4).alias("tie_units"), (F.col("x") == 0).alias("severe"))
    return G.acceptance_slices(sources, compared, ["vmaf_neg_mean", "vmaf_neg_p05", "edge_error", "alpha_coverage_error"])


@query(f"WITH {_SLICES} SELECT * FROM f")
def acceptance_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of each metric overall and by category, with what is expected and passed."""
    return _slices(spark, sf_dir)


@query(f"""
WITH {_SLICES} SELECT 'overall' AS rule, NULL AS category, metric FROM f WHERE category IS NULL AND NOT passed UNION ALL SELECT 'category', category, NULL FROM f WHERE category IS NOT NULL GROUP BY category HAVING NOT bool_and(passed AND expected = eligible)
UNION ALL SELECT 'pairs', NULL, NULL FROM z WHERE category IS NULL AND expected < 28 UNION ALL SELECT 'coverage', NULL, NULL FROM z WHERE category IS NULL AND (expected = 0 OR eligible < expected)
UNION ALL SELECT 'categories', NULL, NULL FROM z WHERE category IS NOT NULL HAVING count(*) < 7""")
def acceptance_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps the comparison from acceptance."""
    return G.acceptance_violations(_slices(spark, sf_dir))


_RECORDS = """
SELECT o_custkey AS bundle, o_orderkey AS place, CASE WHEN o_orderkey % 19 = 0 THEN 'X!' ELSE concat('ev-', o_orderkey % 40) END AS evidence_id,
  CASE o_orderkey % 9 WHEN 0 THEN 'qq_chat' WHEN 1 THEN 'wechat_chat' WHEN 2 THEN 'wechat_sticker' WHEN 3 THEN 'feishu_chat' WHEN 4 THEN 'xiaohongshu_live' WHEN 5 THEN 'douyin_live' WHEN 6 THEN 'web_animation' WHEN 7 THEN 'web_transparent_ui' ELSE 'other' END AS policy_id,
  CASE WHEN o_custkey % 20 = 0 THEN '2' ELSE '1' END AS policy_revision,
  CASE WHEN o_orderkey % 11 = 0 THEN 'May 1' WHEN o_orderkey % 13 = 0 THEN '2026-02-30T00:00:00Z' WHEN o_orderkey % 7 = 0 THEN '2027-01-01T00:00:00.000Z' WHEN o_orderkey % 5 = 0 THEN '2025-12-15T10:00:00Z' ELSE '2026-05-15T10:00:00Z' END AS tested_at,
  CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE 'app' END AS name, '1.0' AS version, CASE WHEN o_orderkey % 29 > 0 THEN '11' END AS os_version,
  CASE WHEN o_orderkey % 31 = 0 THEN 'amiga' ELSE 'windows' END AS platform, CASE WHEN o_orderkey % 37 = 0 THEN 'ABC' ELSE repeat('0af9', 16) END AS artifact_sha256,
  CASE o_custkey % 7 WHEN 0 THEN 'gif' WHEN 1 THEN 'webp' WHEN 2 THEN 'apng' WHEN 3 THEN 'mp4' WHEN 4 THEN 'live_photo' WHEN 5 THEN 'bmp' ELSE 'gif' END AS format,
  o_orderkey % 12 * 100e0 AS width, CASE WHEN o_orderkey % 41 = 0 THEN 0.5e0 ELSE o_orderkey % 12 * 100e0 END AS height, o_custkey % 40 * 1e0 AS fps, o_custkey % 8 * 0.5e0 AS duration_s, floor(o_totalprice * 10) AS size_bytes,
  true AS send, true AS receiver_playback, o_orderkey % 43 > 0 AS forward, true AS download, CASE WHEN o_orderkey % 47 > 0 THEN true END AS reopen FROM orders"""


@query(f"""
WITH r AS ({_RECORDS}), p(policy_id, f, w, v, s, m, a) AS (VALUES ('qq_chat', ['gif'], 560, 18, NULL, 1.9, NULL), ('wechat_chat', ['gif'], 420, 15, NULL, 1.9, NULL), ('wechat_sticker', ['gif'], 240, 12, 3, 0.48, 1.0::DOUBLE), ('feishu_chat', ['gif'], 560, 18, NULL, NULL, NULL),
  ('xiaohongshu_live', ['live_photo'], 1080, 30, 3, NULL, 0.75), ('douyin_live', ['live_photo'], 1080, 30, 3, NULL, 0.5625), ('web_animation', ['webp', 'gif'], 960, 24, NULL, NULL, NULL), ('web_transparent_ui', ['apng', 'webp'], 960, 30, NULL, NULL, NULL)),
x AS (SELECT r.*, p.policy_id IS NOT NULL AS known, f, w, v, s, m, a, CASE WHEN tested_at LIKE '2%' THEN try_cast(rtrim(tested_at, 'Z') AS TIMESTAMP) END AS t, min(CASE WHEN evidence_id <> 'X!' THEN place END) OVER (PARTITION BY bundle, evidence_id) AS head FROM r LEFT JOIN p USING (policy_id)),
e AS (SELECT bundle, place, unnest([CASE WHEN evidence_id = 'X!' THEN ['invalid_evidence_id', 'evidence_id'] END, CASE WHEN place > head THEN ['duplicate_evidence_id', 'evidence_id'] END,
  CASE WHEN NOT known THEN ['unknown_policy_id', 'policy_id'] END, CASE WHEN NOT known OR policy_revision <> '1' THEN ['policy_revision_mismatch', 'policy_revision'] END, CASE WHEN t IS NULL THEN ['invalid_iso_date', 'tested_at'] END,
  CASE WHEN t > TIMESTAMP '2026-07-01' THEN ['future_date', 'tested_at'] END, CASE WHEN t < TIMESTAMP '2026-07-01' - INTERVAL 180 DAY THEN ['evidence_expired', 'tested_at'] END, CASE WHEN trim(name) = '' THEN ['invalid_string', 'name'] END,
  CASE WHEN os_version IS NULL THEN ['invalid_string', 'os_version'] END, CASE WHEN platform = 'amiga' THEN ['invalid_platform', 'platform'] END, CASE WHEN artifact_sha256 = 'ABC' THEN ['invalid_sha256', 'artifact_sha256'] END,
  CASE WHEN format = 'bmp' THEN ['invalid_format', 'format'] END, CASE WHEN width <= 0 THEN ['invalid_positive_integer', 'width'] END, CASE WHEN height <= 0 OR height <> floor(height) THEN ['invalid_positive_integer', 'height'] END,
  CASE WHEN size_bytes <= 0 THEN ['invalid_positive_integer', 'size_bytes'] END, CASE WHEN fps <= 0 THEN ['invalid_positive_number', 'fps'] END, CASE WHEN duration_s <= 0 THEN ['invalid_positive_number', 'duration_s'] END,
  CASE WHEN NOT list_contains(f, format) THEN ['format_outside_policy', 'format'] END, CASE WHEN width > w THEN ['width_exceeds_policy', 'width'] END, CASE WHEN fps > v THEN ['fps_exceeds_policy', 'fps'] END,
  CASE WHEN duration_s > s THEN ['duration_exceeds_policy', 'duration_s'] END, CASE WHEN size_bytes > m * 1048576 THEN ['size_exceeds_policy', 'size_bytes'] END,
  CASE WHEN width > 0 AND height > 0 AND abs(width / height - a) / a > 0.01 THEN ['aspect_outside_policy', 'width'] END, CASE WHEN NOT forward THEN ['lifecycle_incomplete', 'forward'] END, CASE WHEN reopen IS NULL THEN ['lifecycle_incomplete', 'reopen'] END]) AS e FROM x)
SELECT bundle, place, e[1] AS code, e[2] AS field FROM e WHERE e IS NOT NULL""")
def evidence_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of bundles of delivery evidence, by code and field."""
    records = spark.sql(_RECORDS.replace("FROM orders", "FROM {o}"), o=table(spark, sf_dir, "orders"))
    return G.evidence_errors(records, F.lit("2026-07-01T00:00:00Z").cast("timestamp"))
