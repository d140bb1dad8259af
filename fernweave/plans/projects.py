"""Projects made of orders and their lines: invariants, used assets, layers and relinked files."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fernweave.operators import edits as E, projects as P
from fernweave.plans.registry import query, table
from fernweave.sources.shared import written

# A tenth of the orders is one large project. The columns hold some value that breaks each rule.
_LINES = """
l AS (SELECT CASE WHEN l_orderkey % 10 = 0 THEN 0 ELSE l_orderkey END AS project, l_orderkey * 8 + l_linenumber AS k, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_PROJECTS = """
SELECT CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_orderkey END AS project, min(o_orderkey % 50 - 1) AS revision, min(90 + o_custkey % 1900) AS width,
  min(14 + o_orderkey % 1930) AS height, min(o_orderkey % 62) AS fps, min(CASE WHEN o_custkey % 17 = 0 THEN '#12' ELSE '#A0b1C2' END) AS background,
  min(CASE WHEN o_custkey % 3 > 0 THEN o_custkey * 40 END) AS max_bytes
FROM orders GROUP BY 1"""
_ASSETS = """
SELECT project, concat('a', CASE WHEN p % 31 = 0 THEN k - k % 8 + 1 ELSE k END) AS id, CASE WHEN p % 29 = 0 THEN ' ' ELSE concat('C:/in/', p, '.gif') END AS path,
  concat(p, '.gif') AS name, CASE s % 9 WHEN 0 THEN 'audio' WHEN 1 THEN 'image' WHEN 2 THEN 'gif' ELSE 'video' END AS kind, p % 500 AS width, 10 AS height, (p % 40 - 1) * 100000 AS duration_us FROM l"""
_CLIPS = """
SELECT project, CASE WHEN p % 37 = 0 THEN concat('a', k) WHEN p % 41 = 0 THEN ' ' ELSE concat('c', k) END AS id, concat('a', CASE WHEN s % 10 = 0 THEN k + 1 ELSE k END) AS asset_id,
  p % 7 * 100000 AS in_us, p % 7 * 100000 + (s % 9 - 1) * 200000 AS out_us, p % 5 * 0.25e0 AS rate, CASE WHEN s % 3 = 0 THEN p % 6 * 40000000 ELSE 0 END AS hold_us,
  CASE WHEN s % 4 = 0 THEN p % 2 * 900 END AS duration_us, CASE WHEN p % 23 = 0 THEN 'stretch' WHEN p % 2 = 0 THEN 'contain' ELSE 'cover' END AS fit FROM l"""
_LAYERS = """
SELECT project, concat('l', k) AS id, CASE WHEN p % 19 = 0 THEN 'sticker' WHEN p % 2 = 0 THEN 'media' ELSE 'text' END AS kind, k % 8 * 1000 AS start_us, k % 8 * 1000 + s % 6 * 50000 AS end_us,
  CASE WHEN p % 2 = 0 THEN concat('a', CASE WHEN s % 10 = 0 THEN k + 1 ELSE k END) END AS asset_id, p % 11 * 0.25e0 AS width, p % 600 AS font_size, s % 40 AS stroke_width,
  CASE WHEN p % 13 = 0 THEN 'red' ELSE '#00ff00' END AS colour, s % 2 = 0 AS visible FROM l"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each order and line number."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    return lines.selectExpr("CASE WHEN l_orderkey % 10 = 0 THEN 0 ELSE l_orderkey END AS project", "l_orderkey * 8 + l_linenumber AS k", "p", "s")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders, lines = table(spark, sf_dir, "orders"), written(_lines(spark, sf_dir), "lines")
    made = {"projects": spark.sql(_PROJECTS.replace("FROM orders", "FROM {o}"), o=orders)}
    for name, text in {"assets": _ASSETS, "clips": _CLIPS, "layers": _LAYERS}.items():
        made[name] = spark.sql(text.replace("FROM l", "FROM {l}"), l=lines)
    # Every 67th part's layer has a keyframe too many.
    places = lines.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("p") % 67 == 0, 128).otherwise(2))).alias("place"))
    made["keyframes"] = places.select("project", F.concat(F.lit("l"), "k").alias("layer_id"), "place", (F.col("place") * (F.col("p") % 4) * 30000).alias("time_us"))
    return made


_MADE = f"""{_LINES}, projects AS ({_PROJECTS}), assets AS ({_ASSETS}), clips AS ({_CLIPS}), layers AS ({_LAYERS}),
keyframes AS (SELECT project, concat('l', k) AS layer_id, place, place * (p % 4) * 30000 AS time_us FROM (SELECT *, unnest(range(0, CASE WHEN p % 67 = 0 THEN 129 ELSE 3 END)) AS place FROM l))"""


@query(f"""
WITH {_MADE},
known AS (SELECT project, id AS asset_id, max((kind, duration_us)) AS a FROM assets GROUP BY ALL),
timed AS (SELECT c.*, a[1] AS kind, a[2] AS source_us, coalesce(nullif(hold_us, 0), nullif(duration_us, 0), CASE WHEN rate > 0 THEN floor((out_us - in_us) / rate + 0.5)::BIGINT END) AS us FROM clips c LEFT JOIN known USING (project, asset_id)),
seen AS (SELECT y.*, a IS NOT NULL AS found FROM layers y LEFT JOIN known USING (project, asset_id)),
steps AS (SELECT k.*, lag(time_us) OVER (PARTITION BY project, layer_id ORDER BY place) AS last, span FROM keyframes k LEFT JOIN (SELECT project, id AS layer_id, end_us - start_us AS span FROM layers) USING (project, layer_id)),
ids AS (SELECT project, id FROM assets UNION ALL SELECT project, id FROM clips UNION ALL SELECT project, id FROM layers),
found AS (
  SELECT project, project::VARCHAR AS detail, unnest([CASE WHEN revision < 0 THEN 'project.revision' END, CASE WHEN width < 96 OR width > 1920 THEN 'canvas.width' END,
    CASE WHEN height < 16 OR height > 1920 THEN 'canvas.height' END, CASE WHEN fps < 1 OR fps > 60 THEN 'canvas.fps' END, CASE WHEN NOT regexp_full_match(background, '#[0-9a-fA-F]{{6}}') THEN 'canvas.background' END,
    CASE WHEN max_bytes < 1024 OR max_bytes > 536870912 THEN 'output.max_bytes' END]) AS rule FROM projects
  UNION ALL SELECT project, id, unnest([CASE WHEN trim(path) = '' THEN 'asset.path' END, CASE WHEN kind = 'audio' THEN 'asset.kind' END,
    CASE WHEN width < 1 OR width > 100000 THEN 'asset.size' END, CASE WHEN duration_us < 0 THEN 'asset.duration' END]) FROM assets
  UNION ALL SELECT project, id, unnest([CASE WHEN kind IS NULL THEN 'clip.asset' END, CASE WHEN out_us < 0 THEN 'clip.times' END,
    CASE WHEN out_us < in_us OR (out_us = in_us AND hold_us = 0) THEN 'clip.range' END, CASE WHEN rate < 0.05 THEN 'clip.rate' END, CASE WHEN coalesce(us, 0) < 1 THEN 'clip.duration' END,
    CASE WHEN fit = 'stretch' THEN 'clip.fit' END, CASE WHEN kind <> 'image' AND (out_us > source_us OR in_us >= source_us) THEN 'clip.source' END]) FROM timed
  UNION ALL SELECT project, sum(us)::VARCHAR, 'project.duration' FROM timed GROUP BY project HAVING coalesce(sum(us), 300000001) > 300000000
  UNION ALL SELECT project, id, unnest([CASE WHEN kind = 'sticker' THEN 'layer.kind' END, CASE WHEN end_us <= start_us OR end_us < 1 THEN 'layer.times' END,
    CASE WHEN kind = 'media' AND NOT found THEN 'layer.asset' END, CASE WHEN kind = 'media' AND (width < 0.01 OR width > 2) THEN 'layer.width' END,
    CASE WHEN kind = 'text' AND (font_size < 1 OR font_size > 512 OR stroke_width > 32 OR colour = 'red') THEN 'layer.text' END]) FROM seen
  UNION ALL SELECT project, layer_id, unnest([CASE WHEN time_us > span THEN 'keyframe.time' END, CASE WHEN time_us <= last THEN 'keyframe.order' END]) FROM steps
  UNION ALL SELECT project, count(*)::VARCHAR, 'too many assets' FROM assets GROUP BY project HAVING count(*) > 128
  UNION ALL SELECT project, count(*)::VARCHAR, 'too many clips' FROM clips GROUP BY project HAVING count(*) > 2048
  UNION ALL SELECT project, count(*)::VARCHAR, 'too many layers' FROM layers GROUP BY project HAVING count(*) > 64
  UNION ALL SELECT project, count(*)::VARCHAR, 'too many keyframes' FROM keyframes GROUP BY project, layer_id HAVING count(*) > 128
  UNION ALL SELECT project, id, 'id.empty' FROM ids WHERE trim(id) = ''
  UNION ALL SELECT project, id, 'id.repeated' FROM ids GROUP BY project, id HAVING count(*) > 1)
SELECT project, rule, detail FROM found WHERE rule IS NOT NULL""")
def project_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that projects, their assets, clips, layers and keyframes break."""
    return P.project_violations(**_tables(spark, sf_dir))


@query(f"""
WITH {_MADE} SELECT project, asset_id FROM clips UNION SELECT project, asset_id FROM layers WHERE visible AND kind = 'media'""")
def used_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clips and visible media layers use."""
    made = _tables(spark, sf_dir)
    return P.used_assets(made["clips"], made["layers"])


_PATCHES = "SELECT project, concat('l', k) AS id, CASE WHEN p % 5 = 0 THEN 'text' END AS kind, k % 8 * 1000 + (s % 4 - 1) * 40000 AS end_us, CASE WHEN p % 7 = 0 THEN false END AS visible FROM l WHERE p % 3 > 0"
_PATCHED = f"""patches AS ({_PATCHES}), both_ AS (SELECT y.*, q.id IS NOT NULL AS hit, q.kind AS k2, q.end_us AS e2, q.visible AS v2 FROM layers y LEFT JOIN patches q USING (project, id)),
patched AS (SELECT *, CASE WHEN hit AND k2 <> kind THEN 'kind' WHEN hit AND e2 <= start_us THEN 'times' END AS refused FROM both_),
edited AS (SELECT project, id, kind, start_us, CASE WHEN refused IS NULL THEN coalesce(e2, end_us) ELSE end_us END AS end_us, CASE WHEN refused IS NULL THEN coalesce(v2, visible) ELSE visible END AS visible, refused FROM patched)"""


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made = _tables(spark, sf_dir)
    lines = _lines(spark, sf_dir)
    patches = spark.sql(_PATCHES.replace("FROM l", "FROM {l}"), l=lines)
    return P.updated_layers(made["layers"], patches), made["keyframes"]


@query(f"WITH {_MADE}, {_PATCHED} SELECT project, id, kind, start_us, end_us, visible, refused FROM edited")
def layer_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers with new lengths, kinds and visibility; edits that break a layer are refused."""
    return _edited(spark, sf_dir)[0].select("project", "id", "kind", "start_us", "end_us", "visible", "refused")


@query(f"WITH {_MADE}, {_PATCHED} SELECT k.project, layer_id, place, time_us FROM keyframes k JOIN edited e ON e.project = k.project AND e.id = layer_id WHERE time_us <= end_us - start_us")
def layer_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyframes that the edited layers still hold."""
    layers, keyframes = _edited(spark, sf_dir)
    return P.kept_keyframes(keyframes, layers)


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS project, concat('l', l_linenumber) AS id, l_linenumber AS n FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n) AS place FROM l),
r AS (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY n) - 1 AS r, count(*) OVER (PARTITION BY project) AS n FROM p WHERE place <> 2)
SELECT project, id, CAST(CASE WHEN r = n - 1 THEN 0 ELSE r + 1 END AS INT) AS pos FROM r""")
def layer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's second layer removed, then its top one put at the bottom."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS project", "concat('l', l_linenumber) AS id", "l_linenumber AS n").distinct()
    layers = lines.select("project", "id", (F.row_number().over(W.partitionBy("project").orderBy("n")) - 1).alias("pos"))
    left = E.remove_clips(layers, layers.where("pos = 1"))
    top = left.groupBy("project").agg(F.max_by("id", "pos").alias("id")).withColumn("to_pos", F.lit(0))
    return E.move_clips(left, top).select("project", "id", "pos")


_SELECTED = """SELECT project, CASE WHEN s % 17 = 0 THEN 'nowhere' ELSE concat('a', k) END AS id,
  CASE p % 5 WHEN 0 THEN '  ' WHEN 1 THEN concat('D:/new/', p, '.tiff') WHEN 2 THEN concat(' D:/new/', p % 50, '.MP4 ') ELSE concat('D:/new/', p, '.png') END AS path FROM l WHERE p % 3 = 0"""
_PLANS = f"""own AS (SELECT project, concat('a', k) AS id, concat('C:/in/', p % 90, '.gif') AS path, concat(p % 90, '.gif') AS name, 'gif' AS kind, 5 AS width, 6 AS height, 7 AS duration_us FROM l), selected AS ({_SELECTED}),
plans AS (SELECT q.project, q.id, o.path AS old_path, trim(q.path) AS new_path, regexp_extract(trim(q.path), '[^/]*$') AS name, CASE WHEN q.path LIKE '%.MP4 ' THEN 'video' WHEN q.path LIKE '%.png' THEN 'image' END AS kind,
  CASE WHEN o.id IS NULL THEN 'unknown asset' WHEN trim(q.path) = '' THEN 'empty path' WHEN q.path LIKE '%.tiff' THEN 'unsupported format' END AS reason FROM selected q LEFT JOIN own o USING (project, id))"""


def _replaced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = _lines(spark, sf_dir)
    assets = lines.selectExpr("project", "concat('a', k) AS id", "concat('C:/in/', p % 90, '.gif') AS path", "concat(p % 90, '.gif') AS name", "'gif' AS kind", "5 AS width", "6 AS height", "7 AS duration_us")
    return assets, P.replacement_plans(assets, spark.sql(_SELECTED.replace("FROM l", "FROM {l}"), l=lines))


@query(f"WITH {_LINES}, {_PLANS} SELECT project, id, old_path, new_path, name, kind, reason FROM plans")
def replacement_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each selected file would replace, or why it cannot."""
    return _replaced(spark, sf_dir)[1]


@query(f"""
WITH {_LINES}, {_PLANS} SELECT o.project, o.id, coalesce(q.new_path, o.path) AS path, coalesce(q.name, o.name) AS name, coalesce(q.kind, o.kind) AS kind,
  CASE WHEN q.id IS NULL THEN width END AS width, CASE WHEN q.id IS NULL THEN height END AS height, CASE WHEN q.id IS NULL THEN duration_us END AS duration_us
FROM own o LEFT JOIN (SELECT * FROM plans WHERE reason IS NULL) q ON q.project = o.project AND q.id = o.id""")
def relinked_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets at their new files, without what was measured of the old ones."""
    return P.relinked_assets(*_replaced(spark, sf_dir))


@query(f"""
WITH {_LINES}, {_PLANS}, old AS (SELECT project, lower(old_path) AS k, arg_min(new_path, id) AS new FROM plans WHERE reason IS NULL GROUP BY ALL),
paths AS (SELECT project, k AS place, CASE WHEN p % 2 = 0 THEN concat('c:\\IN\\', p % 90, '.gif') ELSE concat('C:/in/', p % 90, '.gif') END AS path FROM l),
put AS (SELECT t.project, place, coalesce(new, path) AS path FROM paths t LEFT JOIN old o ON o.project = t.project AND o.k = replace(lower(path), '\\', '/'))
SELECT project, min(place) AS place, arg_min(path, place) AS path FROM put GROUP BY project, replace(lower(path), '\\', '/')""")
def merged_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of files after replacements, each file once, as Windows tells files apart."""
    plans = _replaced(spark, sf_dir)[1]
    lines = _lines(spark, sf_dir).selectExpr("project", "k AS place", "p % 90 AS f", "p % 2 = 0 AS even")
    path = F.when(F.col("even"), F.concat(F.lit("c:\\IN\\"), "f", F.lit(".gif"))).otherwise(F.concat(F.lit("C:/in/"), "f", F.lit(".gif")))
    return P.replaced_paths(lines.select("project", "place", path.alias("path")), plans)
