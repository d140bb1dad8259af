"""Timeline edits over projects made from customers and their orders."""

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fernweave.operators import edits as E
from fernweave.operators.history import history_state
from fernweave.plans.registry import query, table
from fernweave.sources.shared import written

_CLIPS = """c0 AS (SELECT o_custkey AS project, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS pos, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 50 * 10000 AS in_us, o_orderkey % 50 * 10000 + 100000 + o_orderkey % 97 * 1000 AS out_us,
 CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 0.5 END::DOUBLE AS rate, o_orderkey % 4 = 0 AS reverse, CASE WHEN o_orderkey % 5 = 0 THEN 50000 ELSE 0 END::BIGINT AS hold_us, CASE WHEN o_orderkey % 11 = 0 THEN 70000 END::BIGINT AS duration_us FROM orders),
cl AS (SELECT *, CASE WHEN hold_us > 0 THEN hold_us ELSE coalesce(duration_us, CAST(floor((out_us - in_us) / rate + 0.5) AS BIGINT)) END AS n FROM c0),
tl AS (SELECT *, sum(n) OVER (PARTITION BY project ORDER BY pos)::BIGINT AS end_us, (sum(n) OVER (PARTITION BY project ORDER BY pos) - n)::BIGINT AS start_us FROM cl)"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pos = (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    start = k % 50 * 10000
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project"), pos.alias("pos"), k.cast("string").alias("id"), start.alias("in_us"), (start + 100000 + k % 97 * 1000).alias("out_us"),
        F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 2.0).otherwise(0.5).alias("rate"), (k % 4 == 0).alias("reverse"), F.when(k % 5 == 0, 50000).otherwise(0).cast("long").alias("hold_us"), F.when(k % 11 == 0, 70000).cast("long").alias("duration_us"),
    )


@query(f"WITH {_CLIPS} SELECT project, pos, id, start_us, end_us FROM tl")
def clip_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where clips play."""
    return E.timeline(_clips(spark, sf_dir)).select("project", "pos", "id", "start_us", "end_us")


_CUTS = "ct AS (SELECT project, max(end_us) // 2 AS at_us FROM tl GROUP BY 1)"


def _cuts(clips: DataFrame) -> DataFrame:
    return E.timeline(clips).groupBy("project").agg(F.floor(F.max("end_us") / 2).cast("long").alias("at_us"))


@query(f"""
WITH {_CLIPS}, {_CUTS}, h AS (SELECT tl.*, CASE WHEN at_us > start_us AND at_us < end_us THEN at_us - start_us END AS local FROM tl JOIN ct USING (project)),
b AS (SELECT *, CAST(floor(CASE WHEN reverse THEN out_us - CAST(local AS DOUBLE) / n * (out_us - in_us) ELSE in_us + CAST(local AS DOUBLE) / n * (out_us - in_us) END + 0.5) AS BIGINT) AS cut FROM h),
p AS (SELECT project, pos, 0 AS half, id, CASE WHEN local IS NULL OR hold_us > 0 THEN in_us WHEN reverse THEN cut ELSE in_us END AS in_us, CASE WHEN local IS NULL OR hold_us > 0 THEN out_us WHEN reverse THEN out_us ELSE cut END AS out_us, rate, reverse, CASE WHEN local IS NOT NULL AND hold_us > 0 THEN local ELSE hold_us END AS hold_us, CASE WHEN local IS NULL OR hold_us > 0 THEN duration_us ELSE local END AS duration_us FROM b
 UNION ALL SELECT project, pos, 1 AS half, id || ':b', CASE WHEN hold_us > 0 THEN in_us WHEN reverse THEN in_us ELSE cut END, CASE WHEN hold_us > 0 THEN out_us WHEN reverse THEN cut ELSE out_us END, rate, reverse, CASE WHEN hold_us > 0 THEN n - local ELSE 0 END, CASE WHEN hold_us > 0 THEN duration_us ELSE n - local END FROM b WHERE local IS NOT NULL)
SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY pos, half) - 1 AS INT) AS pos, id, in_us, out_us, rate, reverse, CAST(hold_us AS BIGINT) AS hold_us, CAST(duration_us AS BIGINT) AS duration_us FROM p""")
def split_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project cut in the middle."""
    clips = _clips(spark, sf_dir)
    return E.split_clips(clips, _cuts(clips))


@query(f"""
WITH {_CLIPS}, s AS (SELECT *, count(*) OVER (PARTITION BY project) AS k FROM c0), g AS (SELECT project, id, pos, row_number() OVER (PARTITION BY project ORDER BY pos) - 1 AS r FROM s WHERE pos <> 1),
m AS (SELECT project, id, CASE WHEN r = 0 THEN 1.5 ELSE r - 1 END AS place FROM g), o AS (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY place) - 1 AS pos FROM m),
d AS (SELECT project, id, pos, 1 AS new FROM o UNION ALL SELECT project, id || ':copy', pos + 1, 0 FROM o JOIN (SELECT project AS p2, max(id) AS i2 FROM o GROUP BY 1) ON project = p2 AND id = i2)
SELECT project, id, CAST(row_number() OVER (PARTITION BY project ORDER BY pos, new, id) - 1 AS INT) AS pos FROM d""")
def moved_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's second clip removed, its first moved to the third place, its last id copied."""
    clips = _clips(spark, sf_dir)
    left = E.remove_clips(clips, clips.where("pos = 1"))
    moved = E.move_clips(left, left.where("pos = 0").select("project", "id", F.lit(2).alias("to_pos")))
    return E.duplicate_clips(moved, moved.groupBy("project").agg(F.max("id").alias("id"))).select("project", "id", "pos")


@query(f"""
WITH {_CLIPS} SELECT project, id, in_us, CASE WHEN pos = 0 THEN out_us + 5000 ELSE out_us END AS out_us, CASE WHEN pos = 1 THEN 4.0 ELSE rate END AS rate, CASE WHEN pos = 0 THEN true ELSE reverse END AS reverse, hold_us, CASE WHEN pos = 0 THEN NULL WHEN pos = 1 AND rate <> 4 THEN NULL ELSE duration_us END AS duration_us FROM c0""")
def updated_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First clips trimmed and reversed, second ones at another rate."""
    clips = _clips(spark, sf_dir)
    none = lambda t: F.lit(None).cast(t)
    patches = clips.where("pos <= 1").select("project", "id", none("long").alias("in_us"), F.when(F.col("pos") == 0, F.col("out_us") + 5000).alias("out_us"), F.when(F.col("pos") == 1, 4.0).alias("rate"), F.when(F.col("pos") == 0, True).alias("reverse"), none("long").alias("hold_us"))
    return E.update_clips(clips, patches).drop("pos")


@query(f"""
WITH {_CLIPS}, t AS (SELECT project, max(end_us) AS total, max(end_us) // 2 AS mid FROM tl GROUP BY 1), f AS (SELECT *, CAST(floor(least(mid, total - 1) * 25.0 / 1000000) AS BIGINT) AS k FROM t)
SELECT project, k * 40000 AS start_us, least(total, (k + 1) * 40000) AS end_us, total - (least(total, (k + 1) * 40000) - k * 40000) AS left_us, total - (least(total, (k + 1) * 40000) - k * 40000) + 120000 AS frozen_us FROM f""")
def frame_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame in the middle of each project, and how long the project is once it is
    deleted or frozen for 120 ms."""
    # Written step by step, so that no task holds the sorts of several edits at once.
    clips = written(_clips(spark, sf_dir), "clips")
    spans = written(E.frame_span(_cuts(clips).withColumn("fps", F.lit(25.0)), clips, "at_us", "fps").drop("at_us", "fps"), "spans")
    total = lambda c, n: written(E.timeline(c).groupBy("project").agg(F.max("end_us").alias(n)), n)
    deleted, frozen = total(E.delete_frames(clips, spans), "left_us"), total(E.freeze_frames(clips, spans.withColumn("freeze_us", F.lit(120000).cast("long"))), "frozen_us")
    return spans.join(deleted, "project", "left").join(frozen, "project", "left").select("project", "start_us", "end_us", F.coalesce("left_us", F.lit(0).cast("long")).alias("left_us"), "frozen_us")


@query("""
WITH l AS (SELECT o_custkey AS project, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 40 * 1000 AS s, o_orderkey % 40 * 1000 + 5000 + o_orderkey % 7 * 3000 AS e, o_orderkey % 6 = 0 AS locked FROM orders),
j AS (SELECT *, 20000 AS cut, project % 3 * 2000 AS rem, project % 2 * 4000 AS ins, project % 4 = 1 AS hold, 20000 + project % 3 * 2000 AS fin FROM l),
q AS (SELECT *, locked OR (rem = 0 AND ins = 0) AS still, s < least(e, cut) AS bef, greatest(s, fin) < e AS aft, hold AND ins > 0 AND s <= cut - 1 AND e > cut - 1 AS held FROM j)
SELECT project, locked, 'whole' AS part, id, s AS start_us, e AS end_us FROM q WHERE still
UNION ALL SELECT project, locked, 'before', id, s, least(e, cut) FROM q WHERE NOT still AND bef
UNION ALL SELECT project, locked, 'held', CASE WHEN NOT bef AND NOT aft THEN id ELSE id || ':held' END, cut, cut + ins FROM q WHERE NOT still AND held
UNION ALL SELECT project, locked, 'after', CASE WHEN NOT bef THEN id ELSE id || ':after' END, greatest(s, fin) + ins - rem, e + ins - rem FROM q WHERE NOT still AND aft""")
def spliced_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers cut, held and moved by a splice of their project."""
    k, p = F.col("o_orderkey"), F.col("project")
    layers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), k.cast("string").alias("id"), (k % 40 * 1000).alias("start_us"), (k % 40 * 1000 + 5000 + k % 7 * 3000).alias("end_us"), (k % 6 == 0).alias("locked"))
    splices = layers.select("project").distinct().select("project", F.lit(20000).cast("long").alias("at_us"), (p % 3 * 2000).alias("removed_us"), (p % 2 * 4000).alias("inserted_us"), (p % 4 == 1).alias("held"))
    return E.splice_layers(layers, splices)


@query("""
WITH k AS (SELECT o_custkey AS p, o_orderkey AS t, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 2 ELSE o_orderkey * 2 + o_custkey % 2 END AS s FROM orders),
n AS (SELECT *, lag(t) OVER w AS t0, lag(s) OVER w AS s0, lead(t) OVER w AS t1, lead(s) OVER w AS s1 FROM k WINDOW w AS (PARTITION BY p ORDER BY t))
SELECT p, t, s FROM n WHERE NOT coalesce(CAST(s1 - s AS HUGEINT) * (t0 - t) = CAST(s0 - s AS HUGEINT) * (t1 - t), false)""")
def clock_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knots of piecewise-linear clocks without those on their neighbours' line."""
    k = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("p"), F.col("o_orderkey").alias("t"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 2 ELSE o_orderkey * 2 + o_custkey % 2 END").alias("s"))
    return E.without_collinear(k, ["p"], "t", "s")


@query("""
WITH o AS (SELECT l_orderkey AS layer, l_linenumber AS t, max(l_quantity) AS x FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), e AS (SELECT l_orderkey AS layer, l_linenumber AS t, max(CASE WHEN l_orderkey % 2 = 0 THEN l_tax END) AS x FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL)
SELECT layer, t, CASE WHEN e.layer IS NOT NULL THEN e.x ELSE o.x END AS x FROM o FULL JOIN e USING (layer, t) WHERE CASE WHEN e.layer IS NOT NULL THEN e.x ELSE o.x END IS NOT NULL""")
def upserted_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes replaced, added and removed."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("layer"), F.col("l_linenumber").alias("t"), "l_quantity", "l_tax")
    old = lines.where("t <= 3").groupBy("layer", "t").agg(F.max("l_quantity").alias("x"))
    new = lines.where("t >= 3").groupBy("layer", "t").agg(F.when(F.col("layer") % 2 == 0, F.max("l_tax")).alias("x"))
    return E.upsert_keyframes(old, new, ["layer", "t"], ["x"])


@query()
def edit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undo and redo over each user's log, by stretches; a test holds it against a fold."""
    kind = F.element_at(F.array(*map(F.lit, ["commit", "commit", "undo", "redo", "undo"])), (F.col("event_id") % 5 + 1).cast("int"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), kind.alias("action"), F.col("event_id").alias("revision"))
    return history_state(log)


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'unsupported' WHEN 3 THEN 'expired' ELSE 'ready' END AS state FROM events""")
def draft_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What saved sessions are worth."""
    i = F.col("event_id") % 5
    payload = F.when(i == 0, "  ").when(i == 1, "{oops").otherwise(F.col("props"))
    state = E.draft_state(payload, F.when(i == 2, 9).otherwise(1), F.when(i == 3, 0).otherwise(2_000_000), F.lit(2_500_000), 1, 1_000_000)
    return table(spark, sf_dir, "events").select("event_id", state.alias("state"))


@query("""
WITH i AS (SELECT o_custkey AS collection, o_orderkey AS id, 1 AS revision, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'done' ELSE 'draft' END AS status, o_orderpriority AS settings FROM orders),
e AS (SELECT *, id % 4 = 0 AND settings <> '5-LOW' AS ch, id % 4 = 0 AS ed FROM i)
SELECT collection, id, CASE WHEN ch THEN 2 ELSE 1 END AS revision, CASE WHEN ch THEN 'draft' ELSE status END AS status, CASE WHEN ed THEN '5-LOW' ELSE settings END AS settings FROM e WHERE CASE WHEN ch THEN 'draft' ELSE status END = 'failed'""")
def items_to_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited items are drafts again; failed ones are taken up."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "done").otherwise("draft")
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("collection"), F.col("o_orderkey").alias("id"), F.lit(1).alias("revision"), status.alias("status"), F.col("o_orderpriority").alias("settings"))
    return E.to_retry(E.edit_items(items, items.where("id % 4 = 0").select("collection", "id", F.lit("5-LOW").alias("settings"))))


_SHOWN = """f AS (SELECT o_orderkey // 64 AS clip, o_orderkey % 64 AS frame, o_orderstatus AS hash, CASE WHEN o_orderkey // 64 % 5 = 0 AND o_orderkey % 64 = 3 THEN 1 ELSE 2 + o_orderkey % 4 END AS delay FROM orders),
g AS (SELECT clip, frame * 2 + part AS frame, hash, CASE WHEN part = 1 THEN 2 WHEN delay >= 4 THEN delay - 2 ELSE delay END + CASE WHEN clip % 7 = 1 AND frame = 40 AND part = 0 THEN 1 ELSE 0 END AS delay
 FROM f, (SELECT unnest([0, 1]) AS part) WHERE part = 0 OR delay >= 4)"""


def _runs(name: str, source: str) -> str:
    return f"""{name}u AS (SELECT clip, frame + cycle * (max(frame) OVER (PARTITION BY clip) + 1) AS place, hash, delay FROM {source}, (SELECT unnest([0, 1]) AS cycle) WHERE cycle = 0 OR clip % 3 > 0),
{name}n AS (SELECT *, CASE WHEN min(delay) OVER (PARTITION BY clip) >= 2 AND lag(hash) OVER w = hash THEN 0 ELSE 1 END AS new FROM {name}u WINDOW w AS (PARTITION BY clip ORDER BY place)),
{name}r AS (SELECT clip, run, any_value(hash) AS hash, sum(delay)::BIGINT AS delay FROM (SELECT *, sum(new) OVER (PARTITION BY clip ORDER BY place) AS run FROM {name}n) GROUP BY clip, run),
{name} AS (SELECT clip, list(struct_pack(hash := hash, delay := delay) ORDER BY run) AS shown FROM {name}r GROUP BY clip)"""


@query(f"""
WITH {_SHOWN}, {_runs("a", "f")}, {_runs("b", "g")}
SELECT clip, clip % 11 <> 2 AND a.shown = b.shown AS equal, CASE WHEN clip % 11 = 2 THEN 'canvas' WHEN a.shown <> b.shown THEN 'display' END AS reason FROM a JOIN b USING (clip)""")
def presentation_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether clips show the same after their frames were split, over two cycles where they repeat."""
    from fernweave.operators.presentation import presentations_equal

    k = F.col("o_orderkey")
    clip, frame = F.expr("o_orderkey div 64"), (k % 64)
    delay = F.when((clip % 5 == 0) & (frame == 3), 1).otherwise(2 + k % 4)
    a = table(spark, sf_dir, "orders").select(clip.alias("clip"), frame.alias("frame"), F.col("o_orderstatus").alias("hash"), delay.alias("delay"))
    two = a.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)))).where("part = 0 or delay >= 4")
    late = F.when((F.col("clip") % 7 == 1) & (F.col("frame") == 40) & (F.col("part") == 0), 1).otherwise(0)
    cut = F.when(F.col("part") == 1, 2).when(F.col("delay") >= 4, F.col("delay") - 2).otherwise(F.col("delay"))
    b = two.select("clip", (F.col("frame") * 2 + F.col("part")).alias("frame"), "hash", (cut + late).alias("delay"))
    canvas = a.select("clip").distinct().select("clip", F.lit(320).alias("width"), F.lit(180).alias("height"), F.when(F.col("clip") % 3 > 0, 0).alias("repeat"))
    other = canvas.withColumn("height", F.when(F.col("clip") % 11 == 2, 181).otherwise(180))
    return presentations_equal(a, b, canvas, other).select("clip", "equal", "reason")
