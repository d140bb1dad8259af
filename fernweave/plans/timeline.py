"""Ordered data: timelines, islands, as-of values and edits, over events and orders."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweave.functions import scalar as S
from fernweave.operators import relational as J, sequence as W
from fernweave.plans.registry import micros, query, table

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("t"))


@query("""
WITH e AS (SELECT *, epoch_us(ts) AS t, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS run FROM e)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(t) AS first, max(t) AS last, count(*) AS "rows", round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 4) AS total FROM r GROUP BY user_id, run, event_type""")
def islands_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of one type."""
    events = _events(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,4)"))
    return W.islands(events, ["user_id"], ["t", "event_id"], ["event_type"], "value", DAY_US).withColumn("total", F.round(F.col("total").cast("double"), 4))


@query("""
WITH e AS (SELECT *, min(value) OVER (PARTITION BY user_id) >= 0.2 AS ok FROM events),
n AS (SELECT *, CASE WHEN ok AND lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run FROM n)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS "rows", CAST(sum(event_id) AS BIGINT) AS total FROM r GROUP BY user_id, run, event_type""")
def guarded_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No run of a key is merged if any of its rows is too small."""
    events = table(spark, sf_dir, "events").withColumn("n", F.col("event_id"))
    return W.islands(events, ["user_id"], ["event_id"], ["event_type"], "n", 1 << 16, least=F.col("value") >= 0.2)


@query("""
WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS amount, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS seq FROM lineitem),
d AS (SELECT l_orderkey, seq, sum(amount) AS amount FROM a GROUP BY ALL), f AS (SELECT *, amount // 10000 AS fl, amount % 10000 AS rem FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rem DESC, seq) AS rn, (sum(amount) OVER (PARTITION BY l_orderkey) + 5000) // 10000 - sum(fl) OVER (PARTITION BY l_orderkey) AS due FROM f)
SELECT l_orderkey, seq, CAST(amount AS BIGINT) AS amount, CAST(fl + CASE WHEN rn <= due THEN 1 ELSE 0 END AS BIGINT) AS units FROM r""")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole units that keep an order's total."""
    seq = F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", seq.alias("seq")).agg(F.sum(F.floor("l_extendedprice").cast("long")).alias("amount"))
    return W.apportion(lines, ["l_orderkey"], "seq", "amount", 10000)


@query("""SELECT event_id, user_id, epoch_us(ts) AS t, CAST(round(value * 100) AS BIGINT) AS cents,
CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM events""")
def prefix_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of each row on its key's timeline."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "t", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return W.prefix_sums(events, ["user_id"], "t", ["event_id"], "cents", DAY_US, "start")


@query("""
WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, epoch_us(ts) AS vt, max(struct_pack(view_t := epoch_us(ts), value := value)) AS m FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT event_id, p.user_id, t, m.view_t AS view_t, m.value AS value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.vt""")
def prefix_timeline_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view at or before each purchase."""
    events = _events(spark, sf_dir)
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    views = events.where("event_type = 'view'").select("user_id", F.col("t").alias("view_t"), "value")
    return W.asof(bought, views, ["user_id"], "t", "view_t", ["view_t", "value"], DAY_US)


@query("""
WITH k AS (SELECT user_id, epoch_us(ts) AS k1, max(value) AS v FROM events GROUP BY ALL), s AS (SELECT *, lead(k1) OVER w AS k2, lead(v) OVER w AS v2 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY k1)),
f AS (SELECT user_id, arg_min(v, k1) AS first FROM k GROUP BY 1),
a AS (SELECT DISTINCT user_id, 1704067200000000 + d * 86400000000 AS t FROM events CROSS JOIN (SELECT unnest(range(0, 30, 3)) AS d))
SELECT a.user_id, t, round(CASE WHEN k1 IS NULL THEN first WHEN k2 IS NULL THEN v ELSE v + (v2 - v) * (t - k1) / (k2 - k1) END, 6) AS value
FROM a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.t >= s.k1 LEFT JOIN f ON a.user_id = f.user_id""")
def keyframe_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on straight lines between keyframes, at every third day."""
    events = _events(spark, sf_dir)
    asked = events.select("user_id").distinct().withColumn("t", F.explode(F.expr(f"transform(sequence(0, 27, 3), d -> 1704067200000000 + d * {DAY_US})")))
    return W.interpolate(asked, events, ["user_id"], "t", "t", "value", DAY_US).select("user_id", "t", F.round("value", 6).alias("value"))


_RANGES = """
d AS (SELECT o_custkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 90 AS e FROM orders),
n AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w + 10 THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM n),
m AS (SELECT o_custkey, min(s) AS start, max(e) AS "end", count(*) AS merged FROM r GROUP BY o_custkey, run)"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("cast(datediff(cast(o_orderdate as date), date'1990-01-01') as long)")
    return W.merge_ranges(table(spark, sf_dir, "orders").select("o_custkey", day.alias("s"), (day + 90).alias("e")), ["o_custkey"], "s", "e", 365, slack=10)


@query(f"""WITH {_RANGES} SELECT * FROM m""")
def gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of a customer that touch, merged."""
    return _ranges(spark, sf_dir)


_TIMES = "t AS (SELECT DISTINCT o_custkey, d * 200 AS t FROM orders CROSS JOIN (SELECT unnest(range(10, 20)) AS d))"


@query(f"""WITH {_RANGES}, {_TIMES}
SELECT t.o_custkey, t.t, CAST(coalesce(sum(least("end", t) - start), 0) AS BIGINT) AS removed FROM t LEFT JOIN m ON t.o_custkey = m.o_custkey AND start < t GROUP BY ALL""")
def removed_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much was cut before each time."""
    asked = table(spark, sf_dir, "orders").select("o_custkey").distinct().withColumn("t", F.explode(F.expr("transform(sequence(10, 19), d -> cast(d * 200 as long))")))
    return W.removed_before(asked, _ranges(spark, sf_dir), ["o_custkey"], "t", 365)


@query(f"""WITH {_RANGES}, {_TIMES} SELECT t.o_custkey, t.t, coalesce(max("end"), t.t) AS playable FROM t LEFT JOIN m ON t.o_custkey = m.o_custkey AND start <= t AND t < "end" GROUP BY t.o_custkey, t.t""")
def next_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next time that is in no range."""
    asked = table(spark, sf_dir, "orders").select("o_custkey").distinct().withColumn("t", F.explode(F.expr("transform(sequence(10, 19), d -> cast(d * 200 as long))")))
    return W.next_outside(asked, _ranges(spark, sf_dir), ["o_custkey"], "t", 365)


@query("""
WITH o AS (SELECT DISTINCT c_nationkey, c_custkey FROM customer), g AS (SELECT *, c_custkey - row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS g FROM o)
SELECT c_nationkey, min(c_custkey) AS first, max(c_custkey) AS last FROM g GROUP BY c_nationkey, g""")
def number_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of consecutive numbers."""
    return W.number_ranges(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders), w AS (SELECT DISTINCT o_custkey, d * 100 AS ws, d * 100 + 60 AS we FROM o CROSS JOIN (SELECT unnest(range(20, 40)) AS d))
SELECT o.o_custkey, o_orderkey, s, s + 45 AS e, ws, we, greatest(s, ws) AS overlap_start, least(s + 45, we) AS overlap_end FROM o JOIN w ON o.o_custkey = w.o_custkey AND s < we AND ws < s + 45""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of ranges inside windows, by an equi-join on cells."""
    day = F.expr("cast(datediff(cast(o_orderdate as date), date'1990-01-01') as long)")
    spans = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("s"), (day + 45).alias("e"))
    windows = spans.select("o_custkey").distinct().withColumn("ws", F.explode(F.expr("transform(sequence(20, 39), d -> cast(d * 100 as long))"))).withColumn("we", F.col("ws") + 60)
    return J.overlaps(spans, windows, ["o_custkey"], ("s", "e"), ("ws", "we"), 100).select("o_custkey", "o_orderkey", "s", "e", "ws", "we", "overlap_start", "overlap_end")


@query("""
WITH e AS (SELECT event_id, user_id, value, coalesce(abs(value - lag(value) OVER w), 0) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, list_sort(list_filter([lag(delta, 2) OVER w, lag(delta, 1) OVER w, lead(delta, 1) OVER w, lead(delta, 2) OVER w], lambda x: x IS NOT NULL)) AS near FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, user_id, value, round(delta, 6) AS delta, coalesce(delta > 2 * (near[(len(near) + 1) // 2] + near[len(near) // 2 + 1]) / 2, false) AS spike FROM n""")
def adjacent_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change to the row before, and local spikes."""
    return W.adjacent(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], ["event_id"], "value").withColumn("delta", F.round("delta", 6))


_KEPT = "k AS (SELECT *, value > 60 AS kept FROM events)"


@query(f"""
WITH {_KEPT}, o AS (SELECT *, coalesce(last_value(CASE WHEN kept THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
  first_value(CASE WHEN kept THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS owner FROM k)
SELECT user_id, owner AS event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS held, count(*) AS "rows" FROM o WHERE owner IS NOT NULL GROUP BY ALL""")
def drop_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped rows extend the kept one before them."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") > 60).alias("kept"), F.round(F.col("value") * 100).cast("long").alias("d"))
    return W.hold_dropped(events, ["user_id"], "event_id", "kept", "d", 1 << 16)


@query(f"""
WITH {_KEPT} SELECT event_id, user_id, kept, least(event_id - last_value(CASE WHEN kept THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
  first_value(CASE WHEN kept THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - event_id) AS gap FROM k""")
def nearest_kept_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest kept row."""
    return W.nearest_kept_gap(table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") > 60).alias("kept")), ["user_id"], "event_id", "kept")


@query("""SELECT event_id, user_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * least(count(*) OVER (PARTITION BY user_id), 12) / count(*) OVER (PARTITION BY user_id)) AS INT) AS bucket FROM events""")
def even_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's rows in at most 12 even buckets."""
    return W.spread_over(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id", 12)


@query("""SELECT event_id, user_id, (row_number() OVER w - 1) % 5 = 0 OR row_number() OVER w = count(*) OVER (PARTITION BY user_id) AS kept FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def keep_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row, and always the first and last."""
    return W.keep_every(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id", 5)


@query("""
WITH g AS (SELECT event_id, event_id * 7919 AS t, CAST(floor(event_id * 7919 * 24 / 1000000.0) AS BIGINT) AS i FROM events),
f AS (SELECT event_id, t, CASE WHEN floor((i + 1) * 1000000.0 / 24 + 0.5) <= t THEN i + 1 WHEN floor(i * 1000000.0 / 24 + 0.5) > t THEN i - 1 ELSE i END AS frame FROM g)
SELECT event_id, t, frame, CAST(floor(frame * 1000000.0 / 24 + 0.5) AS BIGINT) AS boundary FROM f""")
def frame_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times on the frame grid of 24 frames a second and back."""
    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7919).alias("t")).withColumn("frame", S.frame_at(F.col("t"), F.lit(24)))
    return events.withColumn("boundary", S.frame_boundary_us(F.col("frame"), F.lit(24)))


@query("""SELECT event_id, value, round(value * 0.125, 6) AS t1, round(value * 0.375, 6) AS t2, round(value * 0.625, 6) AS t3, round(value * 0.875, 6) AS t4 FROM events""")
def midpoint_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sample times in the middle of equal parts."""
    times = S.midpoints(F.col("value"), 4)
    return table(spark, sf_dir, "events").select("event_id", "value", *[F.round(times[i], 6).alias(f"t{i + 1}") for i in range(4)])


@query("""
SELECT event_id, CAST(500 + (event_id * 37 + 250) % 4000 AS BIGINT) AS looped,
 CAST(CASE WHEN user_id % 11 = 0 THEN 1000 WHEN user_id % 2 = 1 THEN greatest(9000 - 1 - floor(event_id * 1.5 + 0.5), 1000) ELSE least(1000 + floor(event_id * 1.5 + 0.5), 9000 - 1) END AS BIGINT) AS source_t FROM events""")
def source_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looped, held, forward and reversed source times."""
    e = table(spark, sf_dir, "events")
    looped = W.looped_clock(F.col("event_id") * 37, F.lit(250), F.lit(500), F.lit(4000))
    at = W.source_time(F.col("event_id"), F.lit(1000).cast("long"), F.lit(9000).cast("long"), F.lit(1.5), F.col("user_id") % 2 == 1, (F.col("user_id") % 11 == 0).cast("int"))
    return e.select("event_id", looped.cast("long").alias("looped"), at.alias("source_t"))


@query("""SELECT l_orderkey, l_linenumber, CAST(min(rk) AS INT) AS place FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber) AS rk FROM lineitem) GROUP BY ALL HAVING min(rk) BETWEEN 2 AND 3""")
def page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 2 to 3 of each key, a page of its order."""
    from fernweave.operators.select import ranked

    lines = ranked(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col(c) for c in ("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber")], "rk")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("rk").alias("place")).where("place between 2 and 3")
