"""Choice of frames to keep, palette segments, and simplified keyframes.

What depends on earlier choices of the same clip runs in one small function a clip, by
applyInPandas: a clip's frames are the group, some thousands of rows of a few numbers.
Everything else is windows over a clip's frames.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from fernweave.functions.quantiles import joined
from fernweave.sources.shared import written

# Fixed values of the presentation safety: longest hold after a material change in
# microseconds; least motion, changed area and scene change that are material; least and most
# changed area, factor over the neighbours' median and excess over it of a local spike.
HOLD_US, MATERIAL = 160_000, {"motion": 0.0005, "changed_area": 0.001, "scene_change": 0.001}
SPIKE_LOW, SPIKE_HIGH, SPIKE_FACTOR, SPIKE_EXCESS = 0.004, 0.08, 3.0, 0.003
# Fixed values of segments: least scene change of a hard cut and of a colour drift with its
# changed area; least shifts of motion and changed area, least score of a soft one; segments.
HARD, DRIFT, DRIFT_AREA, MOTION_SHIFT, AREA_SHIFT, SOFT, SEGMENTS = 0.42, 0.22, 0.08, 0.08, 0.15, 0.28, 4


def _clip() -> WindowSpec:
    """The frames of a clip in order."""
    return W.partitionBy("clip").orderBy("frame")


def local_spikes(frames: DataFrame) -> DataFrame:
    """frames (clip, frame, changed_area, excluded) with `spike`: whether a frame changes a
    small area, but far more than the median of the two frames before and after. Frame 0 of a
    clip and excluded ones are never spikes, nor do they count as neighbours."""
    near = F.array_compact(F.array(*[F.when(~f("excluded", i).over(_clip()) & (f("frame", i).over(_clip()) > F.min("frame").over(W.partitionBy("clip"))), f("changed_area", i).over(_clip())) for f, i in ((F.lag, 2), (F.lag, 1), (F.lead, 1), (F.lead, 2))]))
    seen = frames.select("*", F.array_sort(near).alias("_near"), (F.row_number().over(_clip()) == 1).alias("_first"))
    n = F.size("_near")
    middle = (F.get("_near", F.floor((n - 1) / 2).cast("int")) + F.get("_near", F.floor(n / 2).cast("int"))) / 2
    area = F.col("changed_area")
    spike = ~F.col("_first") & ~F.col("excluded") & area.between(SPIKE_LOW, SPIKE_HIGH) & (n > 0) & (area - middle >= SPIKE_EXCESS) & (area >= middle * SPIKE_FACTOR)
    return seen.select(*frames.columns, F.coalesce(spike, F.lit(False)).alias("spike"))


def material(frames: DataFrame) -> Column:
    """Whether a frame's change to the one before is worth a hold limit."""
    out = F.lit(False)
    for name, least in MATERIAL.items():
        out = out | (F.col(name) >= least)
    return out


def _spacing(kept: np.ndarray) -> np.ndarray:
    """Distance of each frame to the nearest kept one, as a share of all frames."""
    at = np.flatnonzero(kept)
    if not len(at):
        return np.ones(len(kept))
    here = np.arange(len(kept))
    right = np.clip(np.searchsorted(at, here), 0, len(at) - 1)
    left = np.clip(right - 1, 0, len(at) - 1)
    return np.minimum(np.abs(at[right] - here), np.abs(at[left] - here)) / max(len(kept), 1)


def keep_frames(frames: DataFrame, ratio: float = 0.7, scene: float = 0.42, spacing_weight: float = 0.35, duplicate: float = 0.004, low_value: float = 0.05, most: int | None = None) -> DataFrame:
    """frames (clip, frame, duration_us, excluded, motion, changed_area, scene_change,
    importance) with `kept`.

    First and last frame and scene changes stay. Then the earliest frame of each hold that a
    material change makes too long, and each local spike, as far as `most` allows. Then, up to
    the ratio of all frames that are not excluded, always the frame with the greatest importance
    plus its distance from kept ones, ties to the earlier. A clip with excluded frames only
    keeps none. One task handles a clip.
    """
    marked = local_spikes(frames).withColumn("material", material(frames))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields) + ", kept boolean"
    columns = list(frames.columns)

    def choose(clip: pd.DataFrame) -> pd.DataFrame:
        clip = clip.sort_values("frame", ignore_index=True)
        free = ~clip.excluded.to_numpy(bool)
        kept = np.zeros(len(clip), dtype=bool)
        at = np.flatnonzero(free)
        if len(at):
            kept[[at[0], at[-1]]] = True
            kept |= free & (clip.scene_change.to_numpy() >= scene)
            cap = min(max(most or len(at), int(kept.sum())), len(at))
            held, seen = 0, False
            for i, (us, spike, moved) in enumerate(zip(clip.duration_us, clip.spike, clip.material, strict=True)):
                if kept[i]:
                    held, seen = 0, False
                    continue
                held += us
                if not free[i]:
                    continue
                seen |= moved
                if (spike or (seen and held >= HOLD_US)) and kept.sum() < cap:
                    kept[i], held, seen = True, 0, False
            must = int(kept.sum())
            target = min(max(int(np.ceil(len(at) * ratio)), must), max(most or len(at), must), len(at))
            motion, area = clip.motion.to_numpy(), clip.changed_area.to_numpy()
            normal = (motion > duplicate) | (area > duplicate * 2)
            subtle = (motion > 0.001) | (area > 0.001) | (clip.scene_change.to_numpy() > 0.001)
            while kept.sum() < target:
                spacing = _spacing(kept)
                rescue = subtle & (spacing >= 0.08)
                score = clip.importance.to_numpy() + spacing * spacing_weight
                able = free & ~kept & (rescue | (normal & (score >= low_value)))
                if not able.any():
                    break
                kept[int(np.argmax(np.where(able, score, -np.inf)))] = True
        return clip[columns].assign(kept=kept)

    return marked.groupBy("clip").applyInPandas(choose, schema)


def palette_segments(frames: DataFrame) -> DataFrame:
    """Per clip the segments that share a palette, at most SEGMENTS: segment (from 0), first and
    last kept frame, frames, duration (sum of `held` of the kept ones), reason and score in
    thousandths of the boundary before it.

    frames: clip, frame, kept, held, motion, changed_area, scene_change. A boundary stands
    before the first kept frame at or after a hard cut, a colour drift or a shift of motion;
    hard ones go first, then those of greater score, then earlier ones.
    """
    kept = F.when(F.col("kept"), 1).otherwise(0)
    slot = F.coalesce(F.sum(kept).over(_clip().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = {c: F.abs(F.col(c) - F.lag(c).over(_clip())) for c in ("motion", "changed_area")}
    seen = frames.select("*", slot.alias("slot"), F.sum(kept).over(W.partitionBy("clip")).alias("slots"), *[v.alias(f"s_{c}") for c, v in shift.items()])
    hard = F.col("scene_change") >= HARD
    drift = (F.col("scene_change") >= DRIFT) & (F.col("changed_area") >= DRIFT_AREA)
    score = F.col("scene_change") * 0.68 + F.col("s_motion") * 0.18 + F.col("s_changed_area") * 0.14
    soft = ((F.col("s_motion") >= MOTION_SHIFT) | (F.col("s_changed_area") >= AREA_SHIFT)) & (score >= SOFT)
    reason = F.when(hard, "hard_cut").when(drift, "color_drift").when(soft, "motion_shift")
    milli = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(hard, F.greatest(score, F.lit(1.0))).otherwise(score))) * 1000).cast("int")
    found = seen.where((F.col("slot") > 0) & (F.col("slot") < F.col("slots")) & F.col("s_motion").isNotNull()).select("clip", "frame", "slot", "slots", hard.alias("hard"), reason.alias("reason"), milli.alias("score")).where("reason is not null")
    one = found.withColumn("_n", F.row_number().over(W.partitionBy("clip", "slot").orderBy(F.desc("hard"), F.desc("score"), "frame"))).where("_n = 1 and (hard or slots >= 3)")
    top = one.withColumn("_n", F.row_number().over(W.partitionBy("clip").orderBy(F.desc("hard"), F.desc("score"), "slot"))).where(f"_n < {SEGMENTS}").select("clip", F.col("slot"), "reason", "score")
    shown = seen.where("kept").select("clip", "frame", "slot", "held").join(top, ["clip", "slot"], "left")
    along = W.partitionBy("clip").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    cut = shown.withColumn("segment", F.sum(F.when(F.col("reason").isNotNull(), 1).otherwise(0)).over(along).cast("int"))
    return cut.groupBy("clip", "segment").agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("frames"), F.sum("held").alias("duration"),
        F.max("reason").alias("reason"), F.coalesce(F.max("score"), F.lit(0)).alias("score"),
    )


def normal_keyframes(keys: DataFrame, track: str, time: str, start: float, end: float, slack: float = 0.001) -> DataFrame:
    """Keyframes of a track inside start to end (by `slack`), with their times held to it, but
    those within `slack` of the one before. Ties in time go by the remaining columns."""
    rest = [c for c in keys.columns if c not in (track, time)]
    inside = keys.where(F.col(time).between(start - slack, end + slack)).withColumn(time, F.least(F.greatest(F.col(time), F.lit(start)), F.lit(end)))
    along = W.partitionBy(track).orderBy(time, *rest)
    gap = F.col(time) - F.lag(time).over(along)
    return inside.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > slack)).drop("_gap")


#: Confidence under which a keyframe is unsure, and what that adds to its distance.
UNSURE, PENALTY = 0.55, 4.0
#: Points of a gap that one task takes as they are; longer gaps are cut in rounds first.
GAP = 1 << 14


def _farthest_first(t: np.ndarray, v: np.ndarray, u: np.ndarray, tolerance: float) -> list[int]:
    """Places that lines between kept ones, the first and last among them, miss, again and again."""
    keep, todo = [], [(0, len(t) - 1)]
    while todo:
        a, b = todo.pop()
        inner = np.arange(a + 1, b)
        if len(inner):
            share = np.clip((t[inner] - t[a]) / max(1e-4, t[b] - t[a]), 0, 1)
            off = np.abs(v[inner] - (v[a] + (v[b] - v[a]) * share[:, None])).max(axis=1) + u[inner]
            i = int(inner[np.argmax(off)])
            if off.max() > tolerance:
                keep.append(i)
                todo += [(a, i), (i, b)]
    return keep


def simplified_keyframes(keys: DataFrame, track: str, time: str, values: list[str], confidence: str, tolerance: float = 0.7, most: int | None = 28, gap: int = GAP) -> DataFrame:
    """The keyframes of each track that a line between kept ones misses by more than the
    tolerance: first and last, then in every gap the farthest one (a low confidence adds to its
    distance; ties to the first), again and again; of those at most `most` a track.

    All open gaps of all tracks with more than `gap` points are looked at in one aggregation a
    round. One that is cut gives its points to its two parts, one that is not loses them; a
    task finishes one that is short. Of too many, the first and last stay, then the least sure ones, then others evenly chosen.
    """
    columns = keys.columns
    numbered = written(keys.withColumn("_id", F.monotonically_increasing_id()), "keys")
    place = F.struct(F.col(time).cast("double").alias("t"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)], F.col("_id").alias("id"))
    points = numbered.select(F.col(track).alias("_track"), place.alias("p"), (F.greatest(F.lit(UNSURE) - F.col(confidence), F.lit(0.0)) * PENALTY).alias("u"))
    ends = points.groupBy("_track").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    kept = [ends.select(F.explode(F.array("a", "b")).alias("p")).select(F.col("p.id").alias("_id"))]
    gaps = written(ends.withColumn("gap", F.lit("")).select("_track", "gap", "a", "b"), "gaps")
    inside = joined(points, gaps, ["_track"]).where((F.col("p") > F.col("a")) & (F.col("p") < F.col("b")))
    inside = written(inside.select("_track", "gap", "p", "u"), "inside")
    v = [f"v{i}" for i in range(len(values))]

    def finish(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["t", *v, "id"], ignore_index=True)
        ends = [pd.DataFrame([{c: own[f"{side}{c}"].iloc[0] for c in ("t", *v)}]) for side in "ab"]
        whole = pd.concat([ends[0], own[["t", *v]], ends[1]], ignore_index=True)
        found = _farthest_first(whole["t"].to_numpy(float), whole[v].to_numpy(float), np.pad(own["u"].to_numpy(float), 1), tolerance)
        return pd.DataFrame({"_id": own["id"].to_numpy()[np.array(found, dtype=np.int64) - 1]})

    while not inside.isEmpty():
        sizes = inside.groupBy("_track", "gap").agg(F.count("*").alias("n"))
        every = joined(joined(inside, gaps, ["_track", "gap"]), sizes, ["_track", "gap"])
        short = every.where(F.col("n") <= gap).select("_track", "gap", "p.*", "u", *[F.col(f"{side}.{c}").alias(f"{side}{c}") for side in "ab" for c in ("t", *v)])
        kept.append(written(short.groupBy("_track", "gap").applyInPandas(finish, "_id long"), "kept"))
        seen = every.where(F.col("n") > gap)
        share = F.least(F.greatest((F.col("p.t") - F.col("a.t")) / F.greatest(F.lit(1e-4), F.col("b.t") - F.col("a.t")), F.lit(0.0)), F.lit(1.0))
        miss = [F.abs(F.col(f"p.v{i}") - (F.col(f"a.v{i}") + (F.col(f"b.v{i}") - F.col(f"a.v{i}")) * share)) for i in range(len(values))]
        off = (F.greatest(*miss) if len(miss) > 1 else miss[0]) + F.col("u")
        far = seen.select("_track", "gap", "a", "b", "p", off.alias("off")).groupBy("_track", "gap", "a", "b").agg(F.min(F.struct((-F.col("off")).alias("o"), "p")).alias("far"))
        cut = written(far.where(-F.col("far.o") > tolerance).select("_track", "gap", "a", "b", F.col("far.p").alias("m")), "cuts")
        kept.append(cut.select(F.col("m.id").alias("_id")))
        part = lambda bit, a, b: F.struct(F.concat("gap", F.lit(bit)).alias("gap"), F.col(a).alias("a"), F.col(b).alias("b"))
        gaps = cut.select("_track", F.inline(F.array(part("0", "a", "m"), part("1", "m", "b"))))
        rest = joined(inside, cut.select("_track", "gap", "m"), ["_track", "gap"]).where(F.col("p") != F.col("m"))
        inside = written(rest.select("_track", F.concat("gap", F.when(F.col("p") < F.col("m"), "0").otherwise("1")).alias("gap"), "p", "u"), "inside")
    found = numbered.join(reduce(DataFrame.union, kept).distinct(), "_id")
    return (found if most is None else capped_keyframes(found, track, [time, *values, "_id"], confidence, most)).select(*columns)


def capped_keyframes(keys: DataFrame, track: str, order: list[str], confidence: str, most: int) -> DataFrame:
    """keys, at most `most` (2 at least) of a track: see simplified_keyframes."""
    most = max(2, most)
    own = W.partitionBy(track)
    n = F.count("*").over(own)
    placed = keys.withColumn("_k", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_n", n)
    end = (F.col("_k") == 0) | (F.col("_k") == F.col("_n") - 1)
    weak = ~end & (F.col(confidence) < UNSURE)
    turn = F.when(weak, F.row_number().over(W.partitionBy(track, weak).orderBy(confidence, "_k")))
    first = placed.withColumn("_first", end | F.coalesce(turn <= most - 2, F.lit(False)))
    slots = first.withColumn("_open", most - F.count_if("_first").over(own)).withColumn("_m", F.count_if(~F.col("_first")).over(own))
    rest = F.when(~F.col("_first"), F.row_number().over(W.partitionBy(track, "_first").orderBy("_k")) - 1)
    at = lambda s: F.least(F.col("_m") - 1, F.greatest(F.lit(0), F.floor((s + 1) * (F.col("_m") + 1) / (F.col("_open") + 1) + 0.5) - 1))
    chosen = F.when(F.col("_open") > 0, F.array_contains(F.transform(F.sequence(F.lit(0), F.greatest(F.col("_open").cast("int") - 1, F.lit(0))), lambda s: at(s).cast("int")), F.col("_rest"))).otherwise(False)
    marked = slots.withColumn("_rest", rest.cast("int"))
    return marked.where((F.col("_n") <= most) | F.col("_first") | chosen).select(*keys.columns)
