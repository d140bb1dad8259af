"""Sinks read back, bundles checked, keyframes prepared."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweave.operators import schedule as C
from fernweave.plans.registry import query, table
from fernweave.sources import containers as SC, documents as SD, reports as SR, sink as SK


@query("""
SELECT o_orderkey AS run, o_custkey AS fixture_id, o_orderpriority AS profile_id, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS size, c_mktsegment AS fixture_segment, length(o_orderpriority)::INT AS profile_length
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide CSV report, read back: missing values are empty fields."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("fixture_id"), F.col("o_orderpriority").alias("profile_id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("size"))
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fixture_id"), F.col("c_mktsegment").alias("segment"))
    profiles = runs.select("profile_id").distinct().withColumn("length", F.length("profile_id"))
    SR.write_csv_report(runs, sources, profiles, path := SR.scratch(spark, "csv"))
    return spark.read.schema("profile_id string, fixture_id long, run long, size double, fixture_segment string, profile_length int").option("header", True).csv(path)


@query("""
SELECT n_name AS name, count(*) AS customers, max(c_acctbal) AS best FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as JSON, read back with its schema, a malformed line failing."""
    report = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("customers"), F.max("c_acctbal").alias("best"))
    SR.write_json_report(report, path := SR.scratch(spark, "json"))
    return SD.read_typed(spark, path, report.schema)


@query("""
SELECT o_custkey AS customer, count(*) AS n, max(o_orderpriority) AS priority FROM orders GROUP BY 1""")
def committed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side files first, then the report that names them, read back through the report."""
    report = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("priority"))
    SK.write_committed(report, path := SR.scratch(spark, "committed"))
    return SK.read_committed(spark, path, report.schema)


# The frames of an order's file: one for each line number, 10 ms for each unit of a day; every
# ninth order's file has a byte too many, every seventh's is cut short.
_FILES = """f AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL)"""


@query(f"""
WITH {_FILES}, g AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n) - 1 AS i FROM f WHERE o % 9 > 0 AND o % 7 > 0)
SELECT 'o' || o AS path, CASE WHEN o % 2 = 0 THEN 'gif' ELSE 'webp' END AS kind, CAST(i AS INT) AS frame, CASE WHEN o % 2 = 0 THEN p % 500 * 10 ELSE p % 70000 END AS delay_ms, CAST(p % 200 + 1 AS INT) AS width, CAST(n AS INT) AS height,
  CAST(o % 300 AS INT) AS loop, CAST(NULL AS VARCHAR) AS error FROM g
UNION ALL SELECT DISTINCT 'o' || o, CASE WHEN o % 2 = 0 THEN 'gif' ELSE 'webp' END, NULL, NULL, NULL, NULL, NULL, CASE WHEN o % 2 > 0 THEN 'size differs' WHEN o % 9 = 0 THEN 'incomplete, or data after the trailer' ELSE 'ends too early' END
FROM f WHERE o % 9 = 0 OR o % 7 = 0""")
def container_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a GIF or WebP file for each order, made of its lines by column
    functions, with those of malformed files as errors."""
    c, p, o = F.col, F.col("p"), F.col("o")
    raw = lambda text: F.unhex(F.lit(text))
    little = lambda value, n: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(n)]))
    # A control block with a delay, then an image of one data block.
    gif = F.concat(raw("21F90400"), little(p % 500, 2), raw("00002C00000000"), little(p % 200 + 1, 2), little(c("n"), 2), raw("000202440100"))
    # A frame chunk: place, size less 1, delay, flags and two bytes of data.
    webp = F.concat(raw("414E4D4612000000000000000000"), little(p % 200, 3), little(c("n") - 1, 3), little(p % 70000, 3), raw("004142"))
    lines = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("o"), c("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    files = lines.groupBy("o").agg(F.sort_array(F.collect_list(F.struct("n", F.when(o % 2 == 0, gif).otherwise(webp).alias("frame")))).alias("frames"))
    body = F.unhex(F.array_join(F.transform("frames", lambda f: F.hex(f["frame"])), ""))
    chunks = F.concat(raw("57454250414E494D0600000000000000"), little(o % 300, 2), body)
    head = F.concat(raw("474946383961020001000000"), raw("0021FF0B4E45545343415045322E300301"), little(o % 300, 2), raw("00"))
    whole = F.when(o % 2 == 0, F.concat(head, body, raw("3B"))).otherwise(F.concat(raw("52494646"), little(F.octet_length(chunks), 4), chunks))
    broken = F.when(o % 9 == 0, F.concat(whole, raw("00"))).when(o % 7 == 0, F.substring(whole, F.lit(1), F.octet_length(whole) - 1)).otherwise(whole)
    found = SC.frames_of(files.select(F.concat(F.lit("o"), o.cast("string")).alias("path"), broken.alias("content")))
    return found.select("path", "kind", "frame", "delay_ms", "width", "height", "loop", "error")


@query("""
SELECT r_name AS name, true AS same_bytes, r_regionkey AS value FROM region""")
def json_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the hash of the very bytes that were parsed."""
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("value"))
    regions.repartition(3, "name").write.json(path := SR.scratch(spark, "snapshot"))
    files = SD.read_snapshots(spark, path, "name string").select("path", "sha256")
    lines = spark.read.format("text").option("wholetext", True).load(path).select(F.sha2("value", 256).alias("own"), F.explode(F.split("value", "\n")).alias("line")).where("line <> ''")
    return lines.join(files, F.col("own") == F.col("sha256"), "left").select(F.from_json("line", "name string, value int").alias("d"), F.col("sha256").isNotNull().alias("same_bytes")).select("d.name", "same_bytes", "d.value")


@query("""
SELECT 'report.json' AS relative_path, 'missing' AS difference UNION ALL SELECT 'blind_html', 'missing role' UNION ALL SELECT 'build_provenance', 'missing role' UNION ALL SELECT 'report_csv', 'missing role'""")
def bundle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's files against the list of what should be there."""
    table(spark, sf_dir, "region").repartition(2, "r_name").write.json(path := SR.scratch(spark, "bundle"))
    found = SR.bundle_entries(spark, path)
    listed = found.union(spark.createDataFrame([("report_json", "report.json", 1, "00")], found.schema))
    return SR.bundle_violations(listed, found)


@query("""
WITH k AS (SELECT user_id, least(40.0, greatest(2.0, (event_id % 50)::DOUBLE)) AS t, event_id AS e FROM events WHERE event_id % 50 BETWEEN 1.999 AND 40.001), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, e) AS gap FROM k)
SELECT user_id, t, e FROM g WHERE gap IS NULL OR gap > 0.001""")
def normal_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes of a time range without near repeats."""
    keys = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).cast("double").alias("t"), F.col("event_id").alias("e"))
    return C.normal_keyframes(keys, "user_id", "t", 2.0, 40.0)


@query()
def simplified_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes that lines between the others miss, 28 a track at most; gaps of all tracks
    are cut in rounds. A test holds it against the recursion."""
    keys = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("double").alias("t"), (F.col("value") % 50).alias("x"), (F.col("event_id") % 10 / 10.0).cast("double").alias("confidence"))
    return C.simplified_keyframes(keys, "user_id", "t", ["x"], "confidence", tolerance=20.0)
