"""Whether two animations show the same: their displays as step functions of time."""

from pyspark.sql import DataFrame, Window as W, functions as F

from fernweave.operators.sequence import islands, prefix_sums

#: Frames of a clip in a cell, time units in a cell, and the least delay that lets runs be merged.
FRAMES, UNITS, MERGED = 1 << 12, 1 << 20, 2


def steps(frames: DataFrame, canvas: DataFrame) -> DataFrame:
    """(clip, at, nth, hash, delay): where the display of a clip changes and what it shows then.

    frames: clip, frame, hash, delay; canvas: clip, repeat (null: shown once). A clip that
    repeats is unrolled over two cycles, so a run over its seam is one run. Equal frames in a
    row are one run, unless any delay of the clip is under MERGED: then every frame counts, and
    nth numbers those of no length at one time.
    """
    own = frames.select("clip", "frame", "hash", F.col("delay").cast("long").alias("delay"))
    length = own.groupBy("clip").agg((F.max("frame") + 1).alias("n"))
    cycles = canvas.select("clip", F.when(F.col("repeat").isNull(), 1).otherwise(2).alias("cycles"))
    unrolled = own.join(length, "clip").join(cycles, "clip").withColumn("cycle", F.explode(F.sequence(F.lit(0), F.col("cycles") - 1)))
    placed = unrolled.select("clip", (F.col("frame") + F.col("cycle") * F.col("n")).cast("long").alias("place"), "hash", "delay")
    runs = islands(placed, ["clip"], ["place"], ["hash"], "delay", FRAMES, least=F.col("delay") >= MERGED)
    timed = prefix_sums(runs.select("clip", "run", "hash", F.col("total").alias("delay")), ["clip"], "run", [], "delay", FRAMES, "at")
    return timed.withColumn("nth", F.row_number().over(W.partitionBy("clip", "at").orderBy("run"))).select("clip", "at", "nth", "hash", "delay")


def presentations_equal(a: DataFrame, b: DataFrame, canvas_a: DataFrame, canvas_b: DataFrame) -> DataFrame:
    """Per clip of either side: equal, reason (null, `canvas`, `frames` where a side has none, or
    `display`) and how many changes of the two displays are not matched.

    a, b: clip, frame, hash, delay, split into frames in any way; canvas: clip, width, height,
    repeat. Equal canvases and repeats come first; then both displays, cut where either
    changes, must show the same for the same time.
    """
    side = lambda c, p: c.select("clip", F.struct("width", "height", "repeat").alias(p))
    canvas = side(canvas_a, "ca").join(side(canvas_b, "cb"), "clip", "full")
    shown = lambda f, c, p: steps(f, c).select("clip", "at", "nth", F.col("hash").alias(f"h{p}"), F.col("delay").alias(f"d{p}"), F.lit(True).alias(f"in{p}"))
    both = shown(a, canvas_a, "a").join(shown(b, canvas_b, "b"), ["clip", "at", "nth"], "full")
    same = F.col("ina") & F.col("inb") & F.col("ha").eqNullSafe(F.col("hb")) & F.col("da").eqNullSafe(F.col("db"))
    found = both.groupBy("clip").agg(F.count_if(~F.coalesce(same, F.lit(False))).alias("unmatched"), F.count_if("ina").alias("na"), F.count_if("inb").alias("nb"))
    joined = canvas.join(found, "clip", "full")
    reason = (
        F.when(~F.col("ca").eqNullSafe(F.col("cb")), "canvas")
        .when((F.coalesce("na", F.lit(0)) == 0) | (F.coalesce("nb", F.lit(0)) == 0), "frames")
        .when(F.col("unmatched") > 0, "display")
    )
    return joined.select("clip", reason.isNull().alias("equal"), reason.alias("reason"), F.coalesce("unmatched", F.lit(0)).alias("unmatched"))
