"""Benchmark reports over the order tables: slices, percentiles, comparisons, tallies, gates."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweave.functions import quantiles as Q, scalar as S
from fernweave.operators import aggregate as A, gates as G, relational as J
from fernweave.plans.registry import query, table


@query("""
SELECT CASE grouping(o_orderpriority, l_returnflag) WHEN 3 THEN 'overall' WHEN 1 THEN 'priority' ELSE 'flag' END AS grain,
  o_orderpriority, l_returnflag, count(*) AS "rows",
  count(price) AS price_count, quantile_disc(price, 0.5) AS price_p50, quantile_disc(price, 0.95) AS price_p95, max(price) AS price_max,
  count(quantity) AS quantity_count, quantile_disc(quantity, 0.5) AS quantity_p50, quantile_disc(quantity, 0.95) AS quantity_p95, max(quantity) AS quantity_max
FROM (SELECT o_orderpriority, l_returnflag, l_extendedprice AS price, CASE WHEN l_discount > 0.05 THEN l_quantity END AS quantity
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
GROUP BY GROUPING SETS ((), (o_orderpriority), (l_returnflag))""")
def perf_slice_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices overall, by priority and by return flag."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    runs = lines.join(orders.select("o_orderkey", "o_orderpriority"), lines.l_orderkey == orders.o_orderkey).select(
        "o_orderpriority", "l_returnflag", F.col("l_extendedprice").alias("price"), F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("quantity")
    )
    grains = {"overall": [], "priority": ["o_orderpriority"], "flag": ["l_returnflag"]}
    return A.slices(runs, grains, ["o_orderpriority", "l_returnflag"], ["price", "quantity"])


@query("""
SELECT event_type, coalesce(list_sort(list(value) FILTER (isfinite(value)))[CAST(floor((count(*) FILTER (isfinite(value)) - 1) * 0.9 + 0.5) AS INT) + 1], 0.0) AS p90,
  list_sort(list(value) FILTER (value IS NOT NULL))[count(value) // 2 + 1] AS upper_median, median(value) AS middle
FROM events GROUP BY event_type""")
def rounded_index_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three more percentiles, side by side. p90 is of the finite values, 0 without any."""
    events = table(spark, sf_dir, "events").select("event_type", "value")
    finite = events.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value")))
    ranks = Q.ranked_values(events, ["event_type"], "value", {"upper_median": Q.rank_upper_median, "_low": Q.rank_lower_median})
    p90 = Q.ranked_values(finite, ["event_type"], "value", {"p90": Q.rank_rounded_index(0.9)})
    every = events.select("event_type").distinct()
    joined = every.join(ranks, "event_type", "left").join(p90, "event_type", "left")
    return joined.select("event_type", F.coalesce("p90", F.lit(0.0)).alias("p90"), "upper_median", ((F.col("_low") + F.col("upper_median")) / 2).alias("middle"))


@query("""
WITH c AS (SELECT l_returnflag, l_extendedprice AS v, count(*) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY v) AS upto, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM c)
SELECT l_returnflag, min(v) FILTER (upto >= greatest(1, ceil(total * 0.05 - 1e-9))) AS p05, min(v) FILTER (upto >= greatest(1, ceil(total * 0.95 - 1e-9))) AS p95
FROM r GROUP BY l_returnflag""")
def counted_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A03 A04 A06 for groups of very many rows."""
    return Q.counted_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p05": 0.05, "p95": 0.95})


@query("""
WITH c AS (SELECT l_shipmode, v, sum(w) AS w FROM (SELECT l_linestatus AS l_shipmode, l_extendedprice AS v, l_quantity AS w FROM lineitem) GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_shipmode ORDER BY v) AS upto, sum(w) OVER (PARTITION BY l_shipmode) AS total FROM c)
SELECT l_shipmode AS l_linestatus, round(sum(v * w) / sum(w), 4) AS weighted_mean, min(v) FILTER (upto >= total * 0.95) AS weighted_percentile FROM r GROUP BY l_shipmode""")
def weighted_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price weighted by quantity."""
    found = Q.weighted_percentile(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_extendedprice", "l_quantity")
    return found.withColumn("weighted_mean", F.round("weighted_mean", 4))


@query("""
WITH l AS (SELECT l_orderkey, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS net FROM lineitem GROUP BY 1),
p AS (SELECT o_orderpriority, o_totalprice, CAST(net AS DOUBLE) AS net, (o_totalprice - CAST(net AS DOUBLE)) * 100.0 / nullif(o_totalprice, 0) AS saving FROM orders JOIN l ON o_orderkey = l_orderkey)
SELECT o_orderpriority, count(*) AS pairs, round(median(saving), 6) AS median_saving, round(max(saving), 6) AS max_saving, round(sum(net) / sum(o_totalprice), 6) AS ratio_of_sums FROM p GROUP BY 1""")
def paired_saving_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the pairs' savings, beside the ratio of sums."""
    net = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(net.alias("net"))
    pairs = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("saving", A.paired_saving(F.col("o_totalprice"), F.col("net")))
    whole = pairs.groupBy("o_orderpriority").agg(F.count("*").alias("pairs"), F.round(F.max("saving"), 6).alias("max_saving"), F.round(F.sum("net") / F.sum("o_totalprice"), 6).alias("ratio_of_sums"))
    joined = Q.joined(whole, Q.medians(pairs, ["o_orderpriority"], "saving", "median"), ["o_orderpriority"], "left")
    return joined.select("o_orderpriority", "pairs", F.round("median", 6).alias("median_saving"), "max_saving", "ratio_of_sums")


_COMPARED = """
r AS (SELECT s_nationkey, avg(CAST(s_acctbal AS DECIMAL(18,4))) AS reference FROM supplier GROUP BY 1),
c AS (SELECT c_custkey, c_mktsegment, c_acctbal - CAST(reference AS DOUBLE) AS improvement, CAST(reference AS DOUBLE) AS reference,
  100 + abs(CAST(reference AS DOUBLE)) * 0.05 AS tie, greatest(2000 + abs(CAST(reference AS DOUBLE)) * 0.1, 100 + abs(CAST(reference AS DOUBLE)) * 0.05) AS severe
  FROM customer JOIN r ON c_nationkey = s_nationkey),
o AS (SELECT *, CASE WHEN improvement > tie THEN 'win' WHEN improvement < -tie THEN 'loss' ELSE 'tie' END AS outcome, improvement <= -severe AS is_severe FROM c)"""


@query(f"""
WITH {_COMPARED}
SELECT c_mktsegment, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'tie') AS ties,
  round(count(*) FILTER (outcome = 'win') / nullif(count(*) FILTER (outcome <> 'tie'), 0), 9) AS decisive_rate,
  round(avg(improvement), 4) AS mean, round(min(improvement), 4) AS min, round(quantile_disc(improvement, 0.05), 4) AS p05, round(quantile_disc(improvement, 0.5), 4) AS p50,
  round(quantile_disc(improvement, 0.95), 4) AS p95, round(max(improvement), 4) AS max, round(avg(reference), 4) AS mean_reference, count(*) FILTER (is_severe) AS severe
FROM o GROUP BY 1""")
def win_tie_loss_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances against the mean of the nation's suppliers, with tie and severe bands."""
    mean = F.avg(F.col("s_acctbal").cast("decimal(18,4)")).cast("double")
    reference = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(mean.alias("reference"))
    pairs = table(spark, sf_dir, "customer").join(J.small(reference), F.col("c_nationkey") == F.col("s_nationkey"))
    made = S.compare_metric(F.col("c_acctbal"), F.col("reference"), F.lit(True), F.lit(100), F.lit(0.05), F.lit(2000), F.lit(0.1))
    seen = pairs.select("c_mktsegment", "reference", made.alias("m")).select("c_mktsegment", "reference", "m.*")
    out = A.metric_summary(seen, ["c_mktsegment"], "improvement", "reference", "outcome", "severe")
    return out.select("c_mktsegment", "wins", "losses", "ties", F.round("decisive_rate", 9).alias("decisive_rate"), *[F.round(c, 4).alias(c) for c in ("mean", "min", "p05", "p50", "p95", "max", "mean_reference")], "severe")


@query("""
WITH o AS (SELECT lang, CASE WHEN quality = 1 AND toxic = 0 THEN 'win' WHEN quality = 0 THEN 'loss' ELSE 'tie' END AS outcome FROM labels JOIN documents USING (doc_id)),
t AS (SELECT CASE grouping(lang) WHEN 1 THEN 'overall' ELSE 'lang' END AS grain, lang, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'tie') AS ties
  FROM o GROUP BY GROUPING SETS ((), (lang))),
z AS (SELECT *, CAST(wins + losses AS DOUBLE) AS n, wins / nullif(wins + losses, 0) AS p, 1.959963984540054 AS z FROM t)
SELECT grain, lang, wins, losses, ties, round(p, 9) AS decisive_rate, round((wins + ties / 2) / nullif(wins + losses + ties, 0), 9) AS tie_aware_score,
  CASE WHEN n > 0 THEN round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) END AS wilson_low,
  CASE WHEN n > 0 THEN round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) END AS wilson_high FROM z""")
def tally_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes overall and by language with their intervals."""
    won = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "win").when(F.col("quality") == 0, "loss").otherwise("tie")
    votes = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("lang", won.alias("outcome"))
    found = A.grouping_sets(votes, {"overall": [], "lang": ["lang"]}, A.tally("outcome"), ["lang"])
    rates = ("decisive_rate", "tie_aware_score", "wilson_low", "wilson_high")
    return found.select("grain", "lang", "wins", "losses", "ties", *[F.round(c, 9).alias(c) for c in rates])


@query("""
WITH due AS (SELECT DISTINCT lang FROM documents), v AS (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 1000)
SELECT source, count(*) AS n_votes, (SELECT count(*) FROM due) AS n_due, round(count(*) / (SELECT count(*) FROM due), 9) AS coverage FROM v GROUP BY source""")
def vote_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which share of the expected pairs each reviewer has."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    return A.vote_coverage(docs.where("n_chars > 1000"), docs, "source", "lang").withColumn("coverage", F.round("coverage", 9))


@query("""
WITH k AS (SELECT role, t.turn FROM (SELECT DISTINCT role FROM conversations) CROSS JOIN (SELECT DISTINCT turn FROM conversations) t),
s AS (SELECT role, turn, count(*) AS n FROM conversations WHERE length(text) > 150 GROUP BY ALL)
SELECT k.role, k.turn, coalesce(n, 0) AS n_seen, CASE WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS status FROM k LEFT JOIN s USING (role, turn) WHERE n IS NULL OR n > 1""")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of roles x turns that long messages do not fill once."""
    talks = table(spark, sf_dir, "conversations").select("text", "role", "turn")
    return J.matrix_gaps(talks.where("length(text) > 150").select("role", "turn"), talks.select("role"), talks.select("turn"))


@query("""
WITH e AS (SELECT o_orderkey AS k, count(*) AS n, min(o_orderstatus) AS c FROM orders GROUP BY 1), a AS (SELECT l_orderkey AS k, max(l_linestatus) AS c FROM lineitem GROUP BY 1)
SELECT * FROM (SELECT coalesce(e.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' WHEN e.n > 1 THEN 'duplicate' WHEN e.c IS DISTINCT FROM a.c THEN 'changed' END AS difference
FROM e FULL JOIN a ON e.k = a.k) WHERE difference IS NOT NULL""")
def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against what their lines say."""
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("c"))
    actual = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("c"))
    return J.inventory_diff(expected, actual, ["k"], ["c"])


@query("""
WITH n AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), a AS (SELECT s_suppkey, s_nationkey + (s_suppkey % 3) * 10 AS k FROM supplier)
SELECT s_suppkey, CAST(a.k AS INT) AS k, coalesce(n, 0) AS n_matches, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM a LEFT JOIN n ON a.k = n.k""")
def strict_lookup_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups that match never, once, or more often."""
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("cast(s_nationkey + (s_suppkey % 3) * 10 as int)").alias("k"))
    return J.strict_lookup(asked, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), ["k"])


@query("""
SELECT DISTINCT o_custkey AS c_custkey FROM (SELECT o_custkey + 100 AS o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked keys that are not there."""
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 100).alias("c_custkey"))
    return J.unknown_keys(asked, table(spark, sf_dir, "customer"), ["c_custkey"])


@query("""
WITH l AS (SELECT o_custkey, arg_max(struct_pack(k := o_orderkey, p := o_totalprice), struct_pack(d := o_orderdate, k := o_orderkey)) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, m.k AS o_orderkey, m.p AS o_totalprice FROM customer LEFT JOIN l ON c_custkey = o_custkey""")
def last_match_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest finished order of each customer."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return J.first_match(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"], last=True)


@query("""
WITH b AS (SELECT l_orderkey AS k, l_linenumber AS side, l_returnflag, l_tax, l_quantity FROM lineitem WHERE l_linenumber IN (1, 2)),
g AS (SELECT k, count(*) FILTER (side = 1) AS n0, count(*) FILTER (side = 2) AS n1,
  max(struct_pack(v := l_quantity, ok := l_tax < 0.07, same := l_returnflag)) FILTER (side = 1) AS f0, max(struct_pack(v := l_quantity, ok := l_tax < 0.07, same := l_returnflag)) FILTER (side = 2) AS f1 FROM b GROUP BY k)
SELECT k, f0.v AS candidate, f1.v AS reference, CASE WHEN n0 = 0 OR n1 = 0 THEN 'missing side' WHEN n0 > 1 OR n1 > 1 THEN 'ambiguous side' WHEN NOT (f0.ok AND f1.ok) THEN 'failed run' WHEN f0.same <> f1.same THEN 'different contract' END AS omitted FROM g""")
def paired_with_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an order's first two lines, or why there is none."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("string").alias("side"), "l_returnflag", "l_tax", "l_quantity")
    return J.paired(lines, "k", "side", "1", "2", F.col("l_tax") < 0.07, ["l_returnflag"], "l_quantity")


@query("SELECT a.n_nationkey AS reference, b.n_nationkey AS candidate FROM nation a JOIN nation b ON b.n_nationkey = a.n_regionkey * 5 WHERE a.n_nationkey <> b.n_nationkey")
def profile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles and the profile that each is matched to."""
    return J.profile_pairs(table(spark, sf_dir, "nation").withColumn("target", F.col("n_regionkey") * 5), "n_nationkey", "target")


@query("""
WITH p AS (SELECT p_brand, p_name || CASE WHEN p_partkey % 2 = 1 THEN '-v2' ELSE '' END AS name, min(p_retailprice) AS price FROM part GROUP BY ALL)
SELECT a.p_brand, b.name AS base, a.name AS derived, a.price AS derived_value, b.price AS base_value FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.name = b.name || '-v2'""")
def suffix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method and the one it is a variant of, by name."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 1, "-v2").otherwise(""))
    parts = table(spark, sf_dir, "part").groupBy("p_brand", name.alias("name")).agg(F.min("p_retailprice").alias("price"))
    return J.suffix_pairs(parts, ["p_brand"], "name", "-v2", "price")


@query("""
WITH s AS (SELECT o_orderpriority, o_totalprice AS size, CASE WHEN o_orderkey % 7 > 0 THEN 60000.0 * (1 + o_orderkey % 7) END AS cap, o_orderstatus <> 'P' AS correct FROM orders),
t AS (SELECT *, CASE WHEN cap IS NULL THEN 'unknown' WHEN size IS NULL THEN 'unmeasurable' WHEN size > cap THEN 'over' WHEN NOT correct THEN 'incorrect' ELSE 'hit' END AS state FROM s)
SELECT o_orderpriority, count(*) FILTER (state = 'unknown') AS n_unknown, count(*) FILTER (state = 'unmeasurable') AS n_unmeasurable, count(*) FILTER (state = 'over') AS n_over,
  count(*) FILTER (state = 'incorrect') AS n_incorrect, count(*) FILTER (state = 'hit') AS n_hit, round(count(*) FILTER (state = 'hit') / nullif(count(*) FILTER (state <> 'unknown'), 0), 9) AS hit_rate FROM t GROUP BY 1""")
def hard_cap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: orders under a cap of their own, first state wins."""
    cap = F.when(F.col("o_orderkey") % 7 > 0, 60000.0 * (1 + F.col("o_orderkey") % 7))
    counts = A.hard_cap_counts(F.col("o_totalprice"), cap, F.col("o_orderstatus") != "P")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*counts).withColumn("hit_rate", F.round("hit_rate", 9))


@query("""
SELECT l_returnflag, count(ratio) AS samples, round(avg(ratio), 9) AS mean_ratio, quantile_disc(ratio, 0.95) AS p95_ratio, round(count(*) FILTER (l_tax > 0.04 AND ratio IS NOT NULL) / nullif(count(ratio), 0), 9) AS correction_rate,
  CASE WHEN count(ratio) >= 3 THEN round(least(greatest(0.96 / sqrt(quantile_disc(ratio, 0.95)), 0.75), 0.99), 9) END AS recommended_factor
FROM (SELECT l_returnflag, l_tax, CASE WHEN l_discount > 0 THEN 1 + l_discount END AS ratio FROM lineitem) GROUP BY 1""")
def reinvestment_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor from the measured ratios of a group."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_tax", F.when(F.col("l_discount") > 0, 1 + F.col("l_discount")).alias("ratio"))
    found = A.calibration(lines, ["l_returnflag"], "ratio", F.col("l_tax") > 0.04)
    return found.select("l_returnflag", "samples", F.round("mean_ratio", 9).alias("mean_ratio"), "p95_ratio", F.round("correction_rate", 9).alias("correction_rate"), F.round("recommended_factor", 9).alias("recommended_factor"))


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n, concat_ws(',', CASE WHEN NOT bool_and(l_quantity <= 45) THEN 'quantity' END, CASE WHEN NOT bool_and(l_discount < 0.09) THEN 'discount' END, CASE WHEN NOT bool_and(l_tax > 0) THEN 'tax' END) AS violations
FROM lineitem GROUP BY ALL""")
def violations_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks that a line breaks, in order."""
    names = S.violations((F.every(F.col("l_quantity") <= 45), "quantity"), (F.every(F.col("l_discount") < 0.09), "discount"), (F.every(F.col("l_tax") > 0), "tax"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.array_join(names, ",").alias("violations"))


@query("""
WITH s AS (SELECT user_id, event_type, sum(CAST(value AS DECIMAL(18,4))) AS amount FROM events GROUP BY ALL)
SELECT user_id, event_type, amount, round(CAST(amount AS DOUBLE) / nullif(CAST(sum(amount) OVER (PARTITION BY user_id) AS DOUBLE), 0), 9) AS share FROM s""")
def stage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of a user's value each type has."""
    found = A.shares(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.col("value").cast("decimal(18,4)"))
    return found.select("user_id", "event_type", F.col("amount").cast("decimal(38,4)").alias("amount"), F.round("share", 9).alias("share"))


@query("""
WITH b AS (SELECT p_brand, avg(p_size) AS size, avg(CAST(p_retailprice AS DECIMAL(18,4))) AS price, max(p_size) AS largest FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
c AS (SELECT p_brand, avg(p_size) AS size, avg(CAST(p_retailprice AS DECIMAL(18,4))) AS price, CASE WHEN p_brand <> 'Brand#3' THEN max(p_size) END AS largest FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT p_brand, failures, failures = '' AS passed FROM (SELECT p_brand, concat_ws(',', CASE WHEN NOT (c.size <= b.size * 1.02) THEN 'size' END, CASE WHEN NOT (CAST(c.price AS DOUBLE) <= CAST(b.price AS DOUBLE) + abs(CAST(b.price AS DOUBLE)) * 0.0 + 5.0) THEN 'price' END,
  CASE WHEN NOT coalesce(c.largest <= b.largest, c.largest IS NULL AND b.largest IS NULL) THEN 'largest' END) AS failures FROM c JOIN b USING (p_brand))""")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate metrics against a baseline with relative and absolute slack."""
    parts = table(spark, sf_dir, "part")
    price = F.avg(F.col("p_retailprice").cast("decimal(18,4)")).alias("price")
    largest = F.max("p_size")
    base = parts.where("p_partkey % 2 = 0").groupBy("p_brand").agg(F.avg("p_size").alias("size"), price, largest.alias("largest"))
    cand = parts.where("p_partkey % 2 = 1").groupBy("p_brand").agg(F.avg("p_size").alias("size"), price, F.when(F.col("p_brand") != "Brand#3", largest).alias("largest"))
    found = G.regression_gate(cand, base, ["p_brand"], {"size": (0.02, 0.0), "price": (0.0, 5.0), "largest": (0.0, 0.0)})
    return found.select("p_brand", F.array_join("failures", ",").alias("failures"), "passed")


#: Names of the report gate's columns, and each side's value of the i-th, of a part.
_GATED = [*G.METRICS, *G.COUNTS, *G.WEIGHTED, *G.SEAM]
_BASE = [f"CAST(p_size + {i} AS DOUBLE) / CAST(1000 AS DOUBLE)" for i in range(len(_GATED))]
_RATIO = [f"CAST(80 + p_partkey * {i + 3} % 23 + p_partkey % 11 AS DOUBLE) / CAST(100 AS DOUBLE)" for i in range(len(_GATED))]
_REPORT = {f"b_{m}": e for m, e in zip(_GATED, _BASE, strict=True)} | {f"c_{m}": f"({e}) * ({r})" for m, e, r in zip(_GATED, _BASE, _RATIO, strict=True)}
_REPORT |= {f"{s}_{m}": f"CAST(p_size + CASE WHEN {n} THEN 0 ELSE {i} END AS DOUBLE)" for i, m in enumerate(G.COUNTS, 1) for s, n in (("b", "true"), ("c", f"p_partkey % {9 + i} > 0"))}
_REPORT |= {f"{s}_{m}": f"CASE WHEN p_partkey % {n + i} > 0 THEN {_REPORT[f'{s}_{m}']} END" for i, m in enumerate(G.SEAM) for s, n in (("b", 5), ("c", 7))}
_REPORT |= {
    "p_partkey": "p_partkey", "baseline_bytes": "CAST(floor(p_retailprice * 100) AS BIGINT)", "candidate_bytes": "CAST(floor(p_retailprice * (94 + p_partkey % 14)) AS BIGINT)",
    "eligible": "p_partkey % 19", "diffused": "p_partkey % 17",
}


def _report_sql() -> str:
    """Each rule of the gate as a CASE of DuckDB."""
    over = lambda m, limit: f"c_{m} > b_{m} * {limit[0]}::DOUBLE + {limit[1]:.10f}::DOUBLE"
    heavy = f"candidate_bytes > ceil(baseline_bytes * {G.BYTES} / 100.0)"
    gains = " OR ".join(f"c_{m} + {g[1]:.10f}::DOUBLE < b_{m} * {g[0]}::DOUBLE" for m, (_, _, g) in G.METRICS.items() if g)
    rules = [(over(m, r), f"regional:{m}") for m, (r, _, _) in G.METRICS.items()] + [(f"{heavy} AND NOT ({gains})", "regional:serialized_bytes")]
    rules += [("eligible = 0 OR diffused = 0", "diffusion:no_material_work"), *((over(m, d), f"diffusion:{m}") for m, (_, d, _) in G.METRICS.items()), (heavy, "diffusion:serialized_bytes")]
    rules += [(f"c_{m} <> b_{m}", f"timing:{m}") for m in G.COUNTS] + [(over(m, G.TIMING), f"timing:{m}") for m in G.WEIGHTED]
    rules += [x for m in G.SEAM for x in ((f"(c_{m} IS NULL) <> (b_{m} IS NULL)", f"timing:{m}:contract"), (over(m, G.TIMING), f"timing:{m}"))]
    name, least, factor = G.BANDING
    rules.append((f"NOT (b_{name} > {least}::DOUBLE AND c_{name} + {least}::DOUBLE < b_{name} * {factor}::DOUBLE)", "diffusion:material_banding_gain"))
    cases = ", ".join(f"CASE WHEN {cond} THEN '{text}' END" for cond, text in rules)
    return f"WITH r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _REPORT.items())} FROM part), f AS (SELECT p_partkey, concat_ws(',', {cases}) AS failures FROM r) SELECT *, failures = '' AS passed FROM f"


@query(_report_sql())
def report_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of candidates against their baselines: regional, diffusion and timing checks."""
    rows = table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in _REPORT.items()])
    side = lambda s, n: F.struct(*[F.col(f"{s}_{m}").alias(m) for m in _GATED]).alias(n)
    pairs = rows.select("p_partkey", side("c", "candidate"), side("b", "baseline"), "candidate_bytes", "baseline_bytes", "eligible", "diffused")
    return G.report_gate(pairs, ["p_partkey"]).withColumn("failures", F.array_join("failures", ","))


@query("""
WITH s AS (SELECT o_orderpriority, count(*) AS n, quantile_disc(o_totalprice, 0.95) AS p95, CASE WHEN o_orderpriority <> '5-LOW' THEN max(o_totalprice) END AS largest FROM orders GROUP BY 1)
SELECT o_orderpriority, (CASE WHEN n <= 100000 THEN 0 ELSE 1 END) + (CASE WHEN p95 <= 470000 THEN 0 ELSE 1 END) + (CASE WHEN largest <= 1000000 THEN 0 ELSE 1 END) AS n_violations,
  n <= 100000 AND p95 <= 470000 AND coalesce(largest <= 1000000, false) AS passed FROM s""")
def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice against its limits; what was not measured fails."""
    orders = table(spark, sf_dir, "orders")
    largest = F.when(F.col("o_orderpriority") != "5-LOW", F.max("o_totalprice"))
    slices = orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), largest.alias("largest"))
    slices = Q.joined(slices, Q.counted_percentiles(orders, ["o_orderpriority"], "o_totalprice", {"p95": 0.95}), ["o_orderpriority"], "left")
    found = G.budget_gate(slices, ["o_orderpriority"], {"n": 100000, "p95": 470000, "largest": 1000000})
    return found.select("o_orderpriority", F.size("violations").alias("n_violations"), "passed")


@query("""
SELECT bool_and(l_quantity > 0) AS positive, bool_and(l_discount <= 0.05) AS cheap, bool_and(l_shipdate IS NOT NULL) AS dated,
  concat_ws(',', CASE WHEN NOT bool_and(l_quantity > 0) THEN 'positive' END, CASE WHEN NOT bool_and(l_discount <= 0.05) THEN 'cheap' END, CASE WHEN NOT bool_and(l_shipdate IS NOT NULL) THEN 'dated' END) AS failures,
  bool_and(l_quantity > 0) AND bool_and(l_discount <= 0.05) AND bool_and(l_shipdate IS NOT NULL) AS passed FROM lineitem""")
def all_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks over a whole table and their conjunction."""
    checks = {"positive": F.col("l_quantity") > 0, "cheap": F.col("l_discount") <= 0.05, "dated": F.col("l_shipdate").isNotNull()}
    return G.all_hold(table(spark, sf_dir, "lineitem"), checks).withColumn("failures", F.array_join("failures", ","))


@query("""
WITH s AS (SELECT o_orderstatus, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS DOUBLE) AS m FROM orders GROUP BY 1)
SELECT o_orderstatus, 'n' AS metric, m AS stored, n AS recomputed FROM s WHERE m <> n""")
def recomputed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored report against its recomputation."""
    report = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    stored = report.withColumn("n", F.col("n") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0))
    return G.recomputed_matches(stored, report, ["o_orderstatus"], ["n"])


@query("""
WITH o AS (SELECT o_custkey AS k, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 3 > 0 THEN min(o_totalprice) END AS low, max(o_totalprice) AS high FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.low, o.low) AS low, coalesce(n.high, o.high) AS high FROM o FULL JOIN n ON o.k = n.k""")
def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table patched by newer rows."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    old = orders.where("o_orderkey % 2 = 0").groupBy("k").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    new = orders.where("o_orderkey % 2 = 1").groupBy("k").agg(F.when(F.col("k") % 3 > 0, F.min("o_totalprice")).alias("low"), F.max("o_totalprice").alias("high"))
    return J.merge_rows(old, new, ["k"], ["low", "high"])


@query("""
WITH n AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS n FROM nation)
SELECT k, CAST(r AS INT) AS reviewer, CAST((i - r + n) % n AS INT) AS place FROM n CROSS JOIN (SELECT unnest(range(4)) AS r)""")
def rotated_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced order of packets for four reviewers."""
    return J.rotated_order(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), "k", 4)


@query("SELECT event_type, user_id % 10 AS u, min(event_id) AS first_seen FROM events GROUP BY ALL")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys with the place of their first appearance."""
    return J.first_seen(table(spark, sf_dir, "events").withColumn("u", F.col("user_id") % 10), ["event_type", "u"], "event_id")


@query("""
SELECT n.n_nationkey, coalesce(c, 0) AS n_rich, big AS largest FROM nation n LEFT JOIN (SELECT c_nationkey, count(*) AS c, max(c_acctbal) AS big FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON n.n_nationkey = c_nationkey""")
def empty_groups_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with a row for each key of the dimension."""
    report = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_rich"), F.max("c_acctbal").alias("largest"))
    return A.with_empty_groups(report, table(spark, sf_dir, "nation"), "n_nationkey", ["n_rich"])


@query("""
SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'k' END) AS unknown, concat_ws(',', 'v') AS missing FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, '' AS unknown, 'v' AS missing FROM events WHERE event_type <> 'error'""")
def unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects against a closed list of fields."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    errors = G.unknown_fields(events.where("event_type = 'error'"), ["event_id"], "props", ["v"], ["v"])
    others = G.unknown_fields(events.where("event_type <> 'error'"), ["event_id"], "props", ["k", "v"], ["v"])
    return errors.union(others).select("event_id", F.array_join("unknown", ",").alias("unknown"), F.array_join("missing", ",").alias("missing"))


@query("""SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(quality, -1) AS quality FROM documents LEFT JOIN (SELECT doc_id AS d, quality FROM labels) ON doc_id = d""")
def dimension_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension's column with a default where it has no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("unknown")).alias("lang"))
    return J.with_dimension(docs, table(spark, sf_dir, "labels"), "doc_id", {"quality": -1})
