"""Corpus manifests made of parts (fixtures) and customers (profiles), by the size of the part."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweave.operators import manifests as N
from fernweave.plans.registry import query, table

_MANIFESTS = """
SELECT p_size AS manifest, CASE WHEN p_size % 17 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN p_size % 3 = 0 THEN 'complete' WHEN p_size % 13 = 0 THEN 'open' ELSE 'incomplete' END AS status,
  CASE WHEN p_size % 2 = 0 THEN max(p_partkey) % 400 END AS min_total, p_size % 4 AS min_per_category, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'all' ELSE 'stable_profiles' END AS scope,
  p_size % 6 * 0.25e0 AS memory_coverage, p_size % 8 * 10 AS p95_ms, p_size % 9 * 10 AS max_ms, p_size % 10 * 10 AS p95_bytes, p_size % 11 * 10 AS max_bytes FROM part GROUP BY p_size"""
_FIXTURES = """
SELECT p_size AS manifest, CASE WHEN p_partkey % 19 = 0 THEN 'Odd Id' ELSE concat('f_', p_partkey) END AS id, CASE WHEN p_partkey % 23 = 0 THEN ' ' ELSE p_brand END AS category, p_type AS tag,
  CASE p_partkey % 29 WHEN 0 THEN '../a.mkv' WHEN 1 THEN 'a.gif' ELSE concat('x/', p_partkey, '.MKV') END AS file, CASE p_partkey % 31 WHEN 0 THEN 'ff' WHEN 1 THEN NULL ELSE repeat('0e', 32) END AS sha256,
  p_partkey % 37 * 1e0 AS duration_s, CASE p_partkey % 3 WHEN 0 THEN 'lavfi' WHEN 1 THEN 'external' ELSE 'camera' END AS generator, CASE p_partkey % 41 WHEN 0 THEN '' WHEN 1 THEN '/abs' ELSE 'in/a' END AS input,
  CASE WHEN p_partkey % 4 > 0 THEN repeat('12', 32) END AS source_sha256, CASE WHEN p_partkey % 5 > 0 THEN 'own work' END AS rights, CASE WHEN p_partkey % 43 > 0 THEN 'yuv420p' ELSE ' ' END AS pixel_format FROM part"""
_PROFILES = """
SELECT c_custkey % 50 + 1 AS manifest, c_custkey AS place, CASE WHEN c_custkey % 47 = 0 THEN 'p-0' WHEN c_custkey % 53 = 0 THEN '-p' ELSE concat('p-', c_custkey) END AS id,
  CASE c_nationkey % 5 WHEN 0 THEN 'fast_gif' WHEN 1 THEN 'best_gif' WHEN 2 THEN 'slow' ELSE 'target_size' END AS mode, 30 + c_custkey % 3900 AS width, c_custkey % 62 AS fps, 1 + c_custkey % 257 AS colours,
  CASE WHEN c_custkey % 59 > 0 THEN 'gif' ELSE '' END AS encoder, c_nationkey % 2 = 0 AS experimental, CASE WHEN c_nationkey % 5 = 3 OR c_custkey % 61 = 0 THEN concat('p-', c_custkey + (c_custkey % 7 - 4) * 50) END AS target_id,
  CASE WHEN c_nationkey % 5 < 3 THEN NULL ELSE CASE c_custkey % 4 WHEN 0 THEN 'hard_cap' WHEN 1 THEN 'symmetric_match' WHEN 2 THEN 'loose' END END AS target_constraint,
  CASE WHEN c_nationkey % 5 >= 3 AND c_custkey % 3 = 0 THEN c_custkey % 30 * 0.2e0 END AS target_scale FROM customer"""
_REQUIRED = [("category", "Brand#11"), ("category", "none"), ("tag", "none"), ("tag", "ECONOMY")]


@query(f"""
WITH m AS ({_MANIFESTS}), f AS ({_FIXTURES}), p AS ({_PROFILES}), q(kind, name) AS (VALUES {', '.join(str(r) for r in _REQUIRED)}),
w AS (SELECT m.*, coalesce(nf, 0) AS nf, coalesce(open, 0) AS open, coalesce(np, 0) AS np, coalesce(stable, 0) AS stable FROM m LEFT JOIN (SELECT manifest, count(*) AS nf, count(*) FILTER (sha256 IS NULL) AS open FROM f GROUP BY 1) USING (manifest)
  LEFT JOIN (SELECT manifest, count(*) AS np, count(*) FILTER (NOT experimental) AS stable FROM p GROUP BY 1) USING (manifest)),
t AS (SELECT p.*, h.id IS NOT NULL AS there, h.place AS spot, h.mode AS tmode, coalesce(target_constraint, CASE WHEN target_id IS NULL THEN 'hard_cap' ELSE 'symmetric_match' END) AS kind, coalesce(target_scale, 1) AS scale
  FROM p LEFT JOIN (SELECT manifest AS hm, id, min(place) AS place, arg_min(mode, place) AS mode FROM p GROUP BY ALL) h ON h.hm = p.manifest AND h.id = p.target_id),
x AS (SELECT manifest, CAST(manifest AS VARCHAR) AS detail, unnest([CASE WHEN version <> 1 THEN 'version' END, CASE WHEN status = 'open' THEN 'status' END, CASE WHEN nf = 0 THEN 'no fixtures' END, CASE WHEN np = 0 THEN 'no profiles' END,
    CASE WHEN status = 'complete' AND open > 0 THEN 'complete without hashes' END, CASE WHEN nf < min_total THEN 'coverage.total' END, CASE WHEN scope = 'all' THEN 'budget.scope' END, CASE WHEN scope IS NOT NULL AND stable = 0 THEN 'budget.profiles' END,
    CASE WHEN scope IS NOT NULL AND memory_coverage > 1 THEN 'budget.memory_coverage' END, CASE WHEN scope IS NOT NULL AND (p95_ms <= 0 OR max_ms < p95_ms) THEN 'budget.time' END,
    CASE WHEN scope IS NOT NULL AND (p95_bytes <= 0 OR max_bytes < p95_bytes) THEN 'budget.memory' END]) AS rule FROM w
  UNION ALL SELECT manifest, id, unnest([CASE WHEN id = 'Odd Id' THEN 'fixture.id' END, CASE WHEN trim(category) = '' THEN 'fixture.category' END, CASE WHEN file LIKE '.%' OR file LIKE '%gif' THEN 'fixture.file' END,
    CASE WHEN sha256 = 'ff' THEN 'fixture.sha256' END, CASE WHEN duration_s < 0.1 OR duration_s > 30 THEN 'fixture.duration' END, CASE WHEN generator = 'camera' THEN 'fixture.generator' END,
    CASE WHEN input = '' OR (generator = 'external' AND input LIKE '/%') THEN 'fixture.input' END, CASE WHEN generator = 'external' AND source_sha256 IS NULL THEN 'fixture.source_sha256' END,
    CASE WHEN generator = 'external' AND rights IS NULL THEN 'fixture.rights' END, CASE WHEN trim(pixel_format) = '' THEN 'fixture.pixel_format' END]) FROM f
  UNION ALL SELECT m.manifest, q.name, 'coverage.' || kind FROM m CROSS JOIN q WHERE CASE kind WHEN 'tag' THEN (SELECT count(*) FROM f WHERE f.manifest = m.manifest AND f.tag = q.name) < 1 ELSE (SELECT count(*) FROM f WHERE f.manifest = m.manifest AND f.category = q.name) < min_per_category END
  UNION ALL SELECT manifest, id, unnest([CASE WHEN id LIKE '-%' THEN 'profile.id' END, CASE WHEN mode = 'slow' THEN 'profile.mode' END, CASE WHEN width < 32 OR width > 3840 THEN 'profile.width' END, CASE WHEN fps < 1 OR fps > 60 THEN 'profile.fps' END,
    CASE WHEN colours < 2 OR colours > 256 THEN 'profile.colours' END, CASE WHEN encoder = '' THEN 'profile.encoder' END, CASE WHEN mode <> 'target_size' AND (target_id IS NOT NULL OR target_constraint IS NOT NULL OR target_scale IS NOT NULL) THEN 'target.unasked' END]) FROM p
  UNION ALL SELECT manifest, id, unnest([CASE WHEN kind = 'loose' THEN 'target.constraint' END, CASE WHEN scale < 0.25 OR scale > 4 THEN 'target.scale' END, CASE WHEN NOT there THEN 'target.missing' END, CASE WHEN spot >= place THEN 'target.later' END,
    CASE WHEN there AND NOT (kind = 'symmetric_match' AND tmode = 'best_gif' OR kind = 'hard_cap' AND tmode IN ('fast_gif', 'best_gif')) THEN 'target.mode' END, CASE WHEN kind = 'symmetric_match' AND scale <> 1 THEN 'target.symmetric_scale' END]) FROM t WHERE mode = 'target_size'
  UNION ALL SELECT manifest, id, 'fixture.repeated' FROM f GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT manifest, id, 'profile.repeated' FROM p GROUP BY ALL HAVING count(*) > 1)
SELECT manifest, rule, detail FROM x WHERE rule IS NOT NULL""")
def corpus_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that corpus manifests, their fixtures, coverage and profiles break."""
    parts, customers = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    manifests = spark.sql(_MANIFESTS.replace("FROM part", "FROM {p}"), p=parts)
    fixtures = spark.sql(_FIXTURES.replace("FROM part", "FROM {p}"), p=parts).withColumn("tags", F.array("tag"))
    profiles = spark.sql(_PROFILES.replace("FROM customer", "FROM {c}"), c=customers)
    asked = spark.createDataFrame(_REQUIRED, "kind string, name string")
    return N.manifest_violations(manifests, fixtures, manifests.select("manifest").crossJoin(F.broadcast(asked)), profiles)
