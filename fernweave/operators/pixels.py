"""Operators on tables of pixels: clip, frame, y, x and the channels r, g, b (0 to 255).

A frame's pixels are dealt out by (clip, frame) once; rows and columns of a frame are then
windows of that same partitioning, so spatial neighbours need no further shuffle. A pixel's
history is a window over (clip, y, x), the frames of one place in a clip. No window holds
more than a frame's line or a clip's frames.
"""

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from fernweave.functions.media import dither_strength, is_skin, region_class
from fernweave.functions.quantiles import counted_percentiles, joined
from fernweave.functions.scalar import clamp, luma709, luma8, oklab, oklab_distance, ratio_or_zero
from fernweave.operators.frames import FRAME, SPATIAL, over_frames, packed, spatial_sums

RGB = ["r", "g", "b"]
# Least change of a channel that counts as changed, least mean gradient of an
# edge, largest step of a smooth gradient, largest colour distance of a static pixel, and
# least Sobel magnitude of an edge.
CHANGED, EDGE, SMOOTH, STATIC, SOBEL_EDGE = 12, 24, 16, 0.012, 0.08


def _along() -> WindowSpec:
    """A line of a frame, left to right."""
    return W.partitionBy("clip", "frame", "y").orderBy("x")


def _down() -> WindowSpec:
    """A column of a frame, from the top."""
    return W.partitionBy("clip", "frame", "x").orderBy("y")


def _time() -> WindowSpec:
    """The frames of a place."""
    return W.partitionBy("clip", "y", "x").orderBy("frame")


def by_frame(pixels: DataFrame) -> DataFrame:
    """The pixels, those of a frame in one partition."""
    return pixels.repartition(*FRAME)


def max_delta(a: list[Column], b: list[Column]) -> Column:
    """The largest difference of a channel."""
    return F.greatest(*[F.abs(x - y) for x, y in zip(a, b, strict=True)])


def _lab(prefix: str = "") -> Column:
    return oklab(*[F.col(prefix + c) for c in RGB])


def _mean(total: Column, count: Column, scale: float) -> Column:
    """total / count / scale, 0 for none."""
    return ratio_or_zero(total, count) / scale


def spatial_signals(pixels: DataFrame) -> DataFrame:
    """Per clip and frame, in 0 to 1: edge_text, subject_saliency, skin_ratio, noise,
    smooth_gradient_ratio and color_complexity, besides the number of pixels and of distinct
    colours of 4 bits a channel. Frames without pixels do not appear."""
    sums = over_frames(packed(pixels, *map(F.col, RGB)), lambda rgb, there: spatial_sums(rgb, there, EDGE, SMOOTH), SPATIAL)
    density, mean_gradient = ratio_or_zero(F.col("n_edge"), F.col("n_g")), _mean(F.col("s_g"), F.col("n_g"), 255.0)
    noise = clamp(_mean(F.col("s_lap"), F.col("n_lap"), 1020.0) * 2.8 - density * 0.24, 0.0, 1.0)
    complexity = clamp(F.col("colours") / F.least(F.col("pixels"), F.lit(512)), 0.0, 1.0)
    saliency = (
        F.abs(_mean(F.col("l_c"), F.col("n_c"), 255.0) - _mean(F.col("l_o"), F.col("n_o"), 255.0)) * 1.9
        + F.greatest(_mean(F.col("g_c"), F.col("ng_c"), 255.0) - _mean(F.col("g_o"), F.col("ng_o"), 255.0), F.lit(0.0)) * 2.1
        + ratio_or_zero(F.col("skin_c"), F.col("n_c")) * 0.52
    )
    return sums.select(
        *FRAME, "pixels", "colours",
        clamp(density * 1.15 + mean_gradient * 1.35 + density * (1 - complexity) * 0.45 - noise * 0.20, 0.0, 1.0).alias("edge_text"),
        clamp(saliency, 0.0, 1.0).alias("subject_saliency"), ratio_or_zero(F.col("n_skin"), F.col("pixels")).alias("skin_ratio"), noise.alias("noise"),
        ratio_or_zero(F.col("n_smooth"), F.col("n_steps")).alias("smooth_gradient_ratio"), complexity.alias("color_complexity"),
    )


def transition_signals(pixels: DataFrame) -> DataFrame:
    """Per clip and frame: motion (mean luma change to the frame before) and changed_area (share
    of pixels of which a channel changed by CHANGED or more); 0 for a clip's first frame."""
    own = [F.col(c) for c in RGB]
    moved = pixels.select(*FRAME, "y", "x", *RGB, luma8(*own).alias("l")).select(
        *FRAME, F.abs(F.col("l") - F.lag("l").over(_time())).alias("dl"), max_delta(own, [F.lag(c).over(_time()) for c in RGB]).alias("d")
    )
    return moved.groupBy(*FRAME).agg(
        _mean(F.coalesce(F.sum("dl"), F.lit(0)), F.count("*"), 255.0).alias("motion"), ratio_or_zero(F.count_if(F.col("d") >= CHANGED), F.count("*")).alias("changed_area")
    )


def scene_changes(pixels: DataFrame) -> DataFrame:
    """Per clip and frame: histogram (distance of the 16-bin channel histograms to those of the
    frame before, 0 to 1) and scene_change, which also takes motion; 0 for a clip's first frame."""
    bins = [F.count_if(F.shiftright(c, 4) == i).cast("long") for c in RGB for i in range(16)]
    hists = pixels.groupBy(*FRAME).agg(F.array(*bins).alias("h"), F.count("*").alias("n"))
    along = W.partitionBy("clip").orderBy("frame")
    gap = F.aggregate(F.zip_with("h", F.lag("h").over(along), lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    apart = hists.select(*FRAME, clamp(F.coalesce(gap / (F.col("n") * 6.0), F.lit(0.0)), 0.0, 1.0).alias("histogram"))
    both = apart.join(transition_signals(pixels), FRAME)
    first = F.row_number().over(along) == 1
    return both.select(*FRAME, "histogram", "motion", "changed_area", F.when(first, 0.0).otherwise(clamp(F.col("histogram") * 0.72 + F.col("motion") * 0.42, 0.0, 1.0)).alias("scene_change"))


def _sobel(luma: str) -> Column:
    """Gradient magnitude / 4 from `luma` and its eight neighbours; null at borders."""
    at = {(dx, dy): F.col(f"{luma}_{dx + 1}{dy + 1}") for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
    gx = at[1, -1] - at[-1, -1] + 2.0 * (at[1, 0] - at[-1, 0]) + at[1, 1] - at[-1, 1]
    gy = at[-1, 1] - at[-1, -1] + 2.0 * (at[0, 1] - at[0, -1]) + at[1, 1] - at[1, -1]
    return F.hypot(gx, gy) / 4.0


def with_edges(pixels: DataFrame, lumas: list[str]) -> DataFrame:
    """pixels with `<luma>_edge` for each column of lumas: the Sobel magnitude of the pixel."""
    lines = by_frame(pixels).select("*", *[F.struct(F.lag(c).over(_along()).alias("col1"), F.col(c).alias("col2"), F.lead(c).over(_along()).alias("col3")).alias(f"_{c}") for c in lumas])
    stacked = lines.select(*pixels.columns, *[F.struct(F.lag(f"_{c}").over(_down()).alias("a"), F.col(f"_{c}").alias("b"), F.lead(f"_{c}").over(_down()).alias("c")).alias(f"_{c}") for c in lumas])
    names = [(c, f"_{c}.{row}.col{i + 1}", f"{c}_{i}{j}") for c in lumas for j, row in enumerate("abc") for i in range(3)]
    flat = stacked.select(*pixels.columns, *[F.col(path).alias(n) for _, path, n in names])
    return flat.select(*pixels.columns, *[_sobel(c).alias(f"{c}_edge") for c in lumas])


def pair_metrics(reference: DataFrame, distorted: DataFrame) -> DataFrame:
    """Per clip: how far distorted pixels are from the reference ones of the same place.

    mean_error (colour distance); over pixels that are static in the reference: static_error,
    static_residual (how much more or less they move) and static_ratio (of all with a frame
    before; 1 if there are none); over the reference's edges: edge_error, edge_preservation and
    edge_ratio; seams: distance of first and last frame on either side and the excess.
    """
    d = distorted.select(*FRAME, "y", "x", *[F.col(c).alias(f"d_{c}") for c in RGB])
    both = reference.select(*FRAME, "y", "x", *RGB).join(d, [*FRAME, "y", "x"])
    own = [F.col(c) for c in RGB]
    coded = both.select(*FRAME, "y", "x", _lab().alias("a"), _lab("d_").alias("b"), (luma709(*own) / 255.0).alias("la"), (luma709(*[F.col(f"d_{c}") for c in RGB]) / 255.0).alias("lb"))
    last = W.partitionBy("clip", "y", "x")
    timed = coded.select(
        "*",
        oklab_distance(F.col("a"), F.col("b")).alias("error"),
        oklab_distance(F.lag("a").over(_time()), F.col("a")).alias("moved"),
        oklab_distance(F.lag("b").over(_time()), F.col("b")).alias("d_moved"),
        *[F.when(F.row_number().over(_time()) == 1, oklab_distance(F.col(c), F.max_by(c, "frame").over(last))).alias(f"seam_{c}") for c in "ab"],
    )
    edged = with_edges(timed.select(*FRAME, "y", "x", "error", "moved", "d_moved", "seam_a", "seam_b", "la", "lb"), ["la", "lb"])
    still, edge = F.col("moved") <= STATIC, F.col("la_edge") >= SOBEL_EDGE
    lost = F.least(F.abs(F.col("lb_edge") - F.col("la_edge")) / F.greatest("la_edge", F.lit(SOBEL_EDGE)), F.lit(1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = edged.groupBy("clip").agg(
        F.avg("error").alias("mean_error"),
        zero(F.avg(F.when(still, F.col("error")))).alias("static_error"),
        zero(F.avg(F.when(still, F.abs(F.col("d_moved") - F.col("moved"))))).alias("static_residual"),
        F.coalesce(F.try_divide(F.count_if(still).cast("double"), F.count("moved").cast("double")), F.lit(1.0)).alias("static_ratio"),
        zero(F.avg(F.when(edge, lost))).alias("edge_error"),
        ratio_or_zero(F.count_if(edge), F.count("la_edge")).alias("edge_ratio"),
        zero(F.avg("seam_a")).alias("reference_seam"),
        zero(F.avg("seam_b")).alias("output_seam"),
    )
    return out.withColumn("edge_preservation", 1 - F.col("edge_error")).withColumn("seam_excess", F.greatest(F.col("output_seam") - F.col("reference_seam"), F.lit(0.0)))


def alpha_metrics(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Per clip, of two alpha channels: mean_absolute_error in 0 to 1 and coverage_error, the
    share of pixels that only one of them covers (128 or more)."""
    return pairs.groupBy("clip").agg((F.avg(F.abs(F.col(a) - F.col(b))) / 255.0).alias("mean_absolute_error"), F.avg(((F.col(a) >= 128) != (F.col(b) >= 128)).cast("int")).alias("coverage_error"))


def pixel_envelope(pairs: DataFrame, before: list[str], after: list[str], alphas: tuple[str, str]) -> DataFrame:
    """Per clip: max_channel_change and worst_frame_rmse over pixels visible before, alpha_exact,
    and strong_edges_exact: no changed visible pixel has a neighbour whose alpha differs or of
    which a channel is over 24 away. pairs: both sides' channels in one row a pixel."""
    a, b = [F.col(c) for c in before], [F.col(c) for c in after]
    shape = F.struct(*before, alphas[0])
    near = by_frame(pairs).select("*", *[f(shape).over(w).alias(n) for n, f, w in (("_l", F.lag, _along()), ("_r", F.lead, _along()), ("_u", F.lag, _down()), ("_d", F.lead, _down()))])
    strong = F.lit(False)
    for n in ("_l", "_r", "_u", "_d"):
        strong = strong | F.coalesce((F.col(f"{n}.{alphas[0]}") != F.col(alphas[0])) | (max_delta(a, [F.col(f"{n}.{c}") for c in before]) > 24), F.lit(False))
    seen, d = F.col(alphas[0]) > 0, max_delta(a, b)
    squares = sum((x - y) * (x - y) for x, y in zip(a, b, strict=True))
    frames = near.groupBy(*FRAME).agg(
        F.max(F.when(seen, d)).alias("m"), F.sqrt(F.coalesce(F.sum(F.when(seen, squares)), F.lit(0)) / (F.greatest(F.count_if(seen), F.lit(1)) * 3)).alias("rmse"),
        F.every(F.col(alphas[0]) == F.col(alphas[1])).alias("alpha"), F.every(~(seen & (d > 0) & strong)).alias("edges"),
    )
    return frames.groupBy("clip").agg(
        F.coalesce(F.max("m"), F.lit(0)).alias("max_channel_change"), F.max("rmse").alias("worst_frame_rmse"), F.every("alpha").alias("alpha_exact"), F.every("edges").alias("strong_edges_exact")
    )


def block_bias(pairs: DataFrame, before: list[str], after: list[str], delay: str, scale: int) -> DataFrame:
    """Per clip: the mean signed error of blocks of scale x scale pixels, as an absolute value
    averaged over channels; mean_bias weights blocks by pixels times delay (1 at least)."""
    block = [*FRAME, F.floor(F.col("y") / scale).alias("by"), F.floor(F.col("x") / scale).alias("bx")]
    n = F.count("*")
    bias = sum(F.abs(F.sum(F.col(b) - F.col(a))) for a, b in zip(before, after, strict=True)) / n / 3.0
    blocks = pairs.groupBy(*block).agg(bias.alias("bias"), (n * F.greatest(F.max(delay), F.lit(1))).alias("weight"))
    return blocks.groupBy("clip").agg((F.sum(F.col("bias") * F.col("weight")) / F.sum("weight")).alias("mean_bias"), F.max("bias").alias("max_bias"))


def temporal_residual(pairs: DataFrame, before: list[str], after: list[str], delay: str, still: int = 4) -> DataFrame:
    """Per clip: how much the output's steps differ from the source's over pixels that are
    nearly static in the source (a channel changes by `still` or less), averaged over channels
    and weighted by the frame's delay; 0 without such pixels. A40: flips, the count of such
    pixels of which the output changes at all."""
    a, b = [F.col(c) for c in before], [F.col(c) for c in after]
    stepped = pairs.select("clip", F.greatest(delay, F.lit(1)).alias("delay"), *[(F.col(c) - F.lag(c).over(_time())).alias(f"s_{c}") for c in [*before, *after]], max_delta(a, [F.lag(c).over(_time()) for c in before]).alias("d"), max_delta(b, [F.lag(c).over(_time()) for c in after]).alias("o"))
    residual = sum(F.abs(F.col(f"s_{y}") - F.col(f"s_{x}")) for x, y in zip(before, after, strict=True)) / 3.0
    held = F.col("d") <= still
    return stepped.groupBy("clip").agg(
        ratio_or_zero(F.sum(F.when(held, residual * F.col("delay"))), F.sum(F.when(held, F.col("delay")))).alias("residual"), F.count_if(held & (F.col("o") > 0)).alias("flips")
    )


def region_grid(pixels: DataFrame, grid: int, weight: str) -> DataFrame:
    """Per clip and cell of a grid x grid raster: spatial_std, edge, skin_ratio, temporal_delta
    and noise, means over the frames weighted by `weight` (a column, one value a frame), with
    the region's class and dither strength. Neighbours count inside a cell only."""
    sizes = W.partitionBy(*FRAME)
    cell = lambda v: F.floor(F.col(v) * grid / (F.max(v).over(sizes) + 1)).cast("int")
    own = [F.col(c) for c in RGB]
    placed = by_frame(pixels).select(*FRAME, "y", "x", *RGB, weight, cell("y").alias("cy"), cell("x").alias("cx"), luma8(*own).alias("l"))
    along, down = W.partitionBy(*FRAME, "cy", "cx", "y").orderBy("x"), W.partitionBy(*FRAME, "cy", "cx", "x").orderBy("y")
    shape = F.struct(*RGB)
    near = placed.select("*", F.lead("l").over(along).alias("lr"), F.lead("l").over(down).alias("ld"), *[f(shape).over(w).alias(n) for n, f, w in (("_l", F.lag, along), ("_r", F.lead, along), ("_u", F.lag, down), ("_d", F.lead, down))])
    bend = F.greatest(*[F.abs(4 * F.col(c) - F.col(f"_l.{c}") - F.col(f"_r.{c}") - F.col(f"_u.{c}") - F.col(f"_d.{c}")) for c in RGB])
    inner = F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("_u").isNotNull() & F.col("_d").isNotNull()
    bent = near.select(
        *FRAME, "y", "x", *RGB, weight, "cy", "cx", (F.col("l") / 255.0).alias("l"),
        (F.coalesce(F.abs(F.col("l") - F.col("lr")), F.lit(0)) + F.coalesce(F.abs(F.col("l") - F.col("ld")), F.lit(0))).alias("e"),
        (F.col("lr").isNotNull().cast("int") + F.col("ld").isNotNull().cast("int")).alias("ne"), F.when(inner, bend / 1020.0).alias("hf"),
    )
    moved = bent.withColumn("t", F.coalesce(max_delta(own, [F.lag(c).over(_time()) for c in RGB]), F.lit(0)) / 255.0)
    frames = moved.groupBy(*FRAME, "cy", "cx").agg(
        F.max(weight).alias("w"), F.sqrt(F.greatest(F.avg(F.col("l") * F.col("l")) - F.avg("l") * F.avg("l"), F.lit(0.0))).alias("spatial_std"),
        (F.sum("e") / 255.0 / F.greatest(F.sum("ne"), F.lit(1))).alias("edge"), F.avg(is_skin(*own).cast("int")).alias("skin_ratio"), F.avg("t").alias("temporal_delta"), F.coalesce(F.avg("hf"), F.lit(0.0)).alias("noise"),
    )
    names = ["spatial_std", "edge", "skin_ratio", "temporal_delta", "noise"]
    cells = frames.groupBy("clip", "cy", "cx").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in names])
    std, edge, skin, temporal, noise = map(F.col, names)
    kind = region_class(std, edge, skin, temporal, noise)
    return cells.withColumn("region", kind).withColumn("strength", dither_strength(F.col("region"), std, edge, temporal, noise))


def cell_steps(pixels: DataFrame, side: int) -> DataFrame:
    """Per clip, frame and cell of side x side pixels: the range of the channels, the mean of
    the largest channel step between neighbours inside the cell, how many steps exceed 24, and
    whether the cell is cut from the frame before: a mean step of 12 or more in time, or a
    quarter of its pixels over 24."""
    own = [F.col(c) for c in RGB]
    placed = by_frame(pixels).select(*FRAME, "y", "x", *RGB, F.floor(F.col("y") / side).alias("cy"), F.floor(F.col("x") / side).alias("cx"))
    along, down = W.partitionBy(*FRAME, "cy", "cx", "y").orderBy("x"), W.partitionBy(*FRAME, "cy", "cx", "x").orderBy("y")
    stepped = placed.select("*", *[max_delta(own, [F.lead(c).over(w) for c in RGB]).alias(n) for n, w in (("sx", along), ("sy", down))])
    timed = stepped.withColumn("st", max_delta(own, [F.lag(c).over(_time()) for c in RGB]))
    n, total = F.count("sx") + F.count("sy"), F.coalesce(F.sum("sx"), F.lit(0)) + F.coalesce(F.sum("sy"), F.lit(0))
    return timed.groupBy(*FRAME, "cy", "cx").agg(
        F.greatest(*[F.max(c) - F.min(c) for c in RGB]).alias("range"), ratio_or_zero(total, n).alias("mean_step"), (F.count_if(F.col("sx") > 24) + F.count_if(F.col("sy") > 24)).alias("edges"),
        F.coalesce((F.avg("st") >= 12) | (F.count_if(F.col("st") > 24) * 4 >= F.count("*")), F.lit(False)).alias("cut"),
    )


def displayed(draws: DataFrame, frames: DataFrame, value: str) -> DataFrame:
    """What each place of a clip shows in each frame, for frames that draw a rectangle.

    draws: clip, frame, y, x, value for the places inside a frame's rectangle (null: the place
    is transparent there). frames: clip, frame, disposal ("keep", "background" or "previous").
    A kept frame leaves what it drew, a background one clears its rectangle, a previous one
    leaves nothing. Returns a row for each frame and each place that is ever inside a rectangle;
    shown is null where nothing is on show.
    """
    places = draws.select("clip", "y", "x").distinct().join(frames, "clip")
    own = draws.select("clip", "frame", "y", "x", F.col(value).alias("_drawn"), F.lit(True).alias("_inside"))
    rows = places.join(own, ["clip", "frame", "y", "x"], "left")
    left = F.when((F.col("disposal") == "keep") & F.col("_drawn").isNotNull(), F.struct(F.col("_drawn").alias("v"))).when(
        (F.col("disposal") == "background") & F.col("_inside"), F.struct(F.lit(None).cast(draws.schema[value].dataType).alias("v"))
    )
    before = F.last(F.col("_left"), ignorenulls=True).over(_time().rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_left", left).select("clip", "frame", "y", "x", F.coalesce("_drawn", before["v"]).alias("shown"))


def frame_hashes(pixels: DataFrame, alpha: str) -> DataFrame:
    """Per clip and frame: the SHA-256 of the frame's bytes in raster order, colours of places
    with alpha 0 as zeros. A frame's bytes are gathered in one row."""
    seen = lambda c: F.when(F.col(alpha) > 0, F.col(c)).otherwise(0)
    code = F.concat(*[F.lpad(F.hex(v), 2, "0") for v in (*map(seen, RGB), F.col(alpha))])
    lined = pixels.select(*FRAME, F.struct("y", "x", code.alias("code")).alias("p")).groupBy(*FRAME).agg(F.sort_array(F.collect_list("p")).alias("p"))
    return lined.select(*FRAME, F.sha2(F.unhex(F.array_join(F.transform("p", lambda p: p["code"]), "")), 256).alias("hash"))


def change_boxes(pixels: DataFrame) -> DataFrame:
    """Per clip and frame: the rectangle that holds all places that differ from the frame
    before, and their number; the whole frame for the first; nulls and 0 where none differ."""
    differs = F.coalesce(max_delta([F.col(c) for c in RGB], [F.lag(c).over(_time()) for c in RGB]) > 0, F.lit(True))
    marked = pixels.select(*FRAME, "y", "x", differs.alias("d"))
    edge = lambda f, c: f(F.when(F.col("d"), F.col(c)))
    return marked.groupBy(*FRAME).agg(F.count_if("d").alias("changed"), edge(F.min, "x").alias("x0"), edge(F.min, "y").alias("y0"), edge(F.max, "x").alias("x1"), edge(F.max, "y").alias("y1"))


def compact_indices(used: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Per key: each used palette index, ascending, with its dense new index and the size of
    the smallest table of a power of two (2 at least) that holds them. 256 indices a key."""
    own = W.partitionBy(*keys)
    one = used.select(*keys, index).where(F.col(index).isNotNull()).distinct()
    n = F.count("*").over(own)
    return one.select(*keys, index, (F.row_number().over(own.orderBy(index)) - 1).alias("compact"), F.greatest(F.lit(2), F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int")).alias("table_size"))


def ordered_dither(pixels: DataFrame, palette: list[tuple[int, int, int]], strength: int, names: list[str] = RGB) -> DataFrame:
    """pixels with `index`: the palette entry nearest in OKLab, or the second nearest where the
    8 x 8 threshold of the place is below strength / 255 times the share of the way to it.
    Ties go to the lower index. The palette has 256 entries at most."""
    own = oklab(*[F.col(c) for c in names])
    # The thresholds are the usual recursive matrix: bits of x ^ y and y, interleaved and reversed.
    bit = lambda v, i: F.shiftright(v, i).bitwiseAND(1)
    xy = F.col("x").bitwiseXOR(F.col("y"))
    threshold = (sum((bit(xy, i) * (1 << (5 - 2 * i)) + bit(F.col("y"), i) * (1 << (4 - 2 * i))) for i in range(3)) + 0.5) / 64.0
    known = [oklab(*map(F.lit, c)) for c in palette]
    far = F.array(*[F.struct(oklab_distance(F.col("_own"), F.col(f"_k{i}")).alias("d"), F.lit(i).alias("i")) for i in range(len(palette))])
    two = pixels.select("*", own.alias("_own"), *[k.alias(f"_k{i}") for i, k in enumerate(known)]).select(*pixels.columns, F.slice(F.array_sort(far), 1, 2).alias("_two"))
    a, b = F.get("_two", F.lit(0)), F.get("_two", F.lit(1))
    share = F.coalesce(F.try_divide(a["d"], a["d"] + b["d"]), F.lit(0.0))
    return two.select(*pixels.columns, F.when((share * strength / 255.0) > threshold, b["i"]).otherwise(a["i"]).alias("index"))


def held_colours(pixels: DataFrame, own: str, source: str, delay: str, static: int, most_holds: int = 2, most_delay: int = 16) -> DataFrame:
    """pixels with `held`: the value shown when a place keeps its value of the frame before.

    A place is held while its source differs by `static` or less from the frame before and from
    the anchor (the source when it was last drawn anew), holding is no worse than its own value,
    and it was held at most most_holds times and most_delay in a row. A fold over a place's
    frames, which are gathered in one row a place (a clip's frames, one channel).
    """
    steps = F.sort_array(F.collect_list(F.struct("frame", F.col(own).alias("own"), F.col(source).alias("src"), F.col(delay).alias("delay"))))
    places = pixels.groupBy("clip", "y", "x").agg(steps.alias("s"))
    kind = "array<struct<frame:int,held:int,src:int,anchor:int,n:int,t:int>>"

    def step(done: Column, x: Column) -> Column:
        p = F.try_element_at(done, F.lit(-1))
        keeps = (
            (F.size(done) > 0)
            & (F.abs(x["src"] - p["src"]) <= static)
            & (F.abs(x["src"] - p["anchor"]) <= static)
            & (F.abs(p["held"] - x["src"]) <= F.abs(x["own"] - x["src"]))
            & (p["n"] < most_holds)
            & (p["t"] + x["delay"] <= most_delay)
        )
        keeps = F.coalesce(keeps, F.lit(False))
        pick = lambda a, b, name: F.when(keeps, a).otherwise(b).cast("int").alias(name)
        new = F.struct(
            x["frame"].cast("int").alias("frame"), pick(p["held"], x["own"], "held"), x["src"].cast("int").alias("src"), pick(p["anchor"], x["src"], "anchor"),
            pick(p["n"] + 1, F.lit(0), "n"), pick(p["t"] + x["delay"], F.lit(0), "t"),
        )
        return F.concat(done, F.array(new))

    folded = places.select("clip", "y", "x", F.explode(F.aggregate("s", F.array().cast(kind), step)).alias("f"))
    return folded.select("clip", F.col("f.frame").alias("frame"), "y", "x", F.col("f.held").alias("held"))


def content_probe(samples: DataFrame, side: int, fps: float) -> DataFrame:
    """Per clip of grey samples (clip, frame, y, x, l; side x side places): frames, mean and upper
    median change, shares of static and cut transitions, cut times in seconds, mean area of the
    rectangle of change, shares of smooth gradients and edges, and noise. A clip of one frame
    has no transitions; its measures of change are null."""
    near = by_frame(samples).select("*", *[f("l").over(w).alias(n) for n, f, w in (("_l", F.lag, _along()), ("_r", F.lead, _along()), ("_u", F.lag, _down()), ("_d", F.lead, _down()))])
    inner = F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("_u").isNotNull() & F.col("_d").isNotNull()
    gradient = F.floor((F.abs(F.col("_r") - F.col("_l")) + F.abs(F.col("_d") - F.col("_u"))) / 2)
    bend = F.abs(4 * F.col("l") - F.col("_l") - F.col("_r") - F.col("_u") - F.col("_d"))
    spatial = near.where(inner).groupBy("clip").agg(
        F.avg((gradient.between(4, 48) & (bend <= 16)).cast("int")).alias("smooth_ratio"), F.avg((gradient >= 64).cast("int")).alias("edge_ratio"), (F.avg(bend) / 255.0).alias("noise")
    )
    stepped = samples.withColumn("d", F.abs(F.col("l") - F.lag("l").over(_time())))
    moved = lambda c: F.when(F.col("d") >= CHANGED, F.col(c))
    size = float(side * side)
    box = (F.max(moved("x")) - F.min(moved("x")) + 1) * (F.max(moved("y")) - F.min(moved("y")) + 1) / size
    steps = stepped.groupBy(*FRAME).agg((F.sum("d") / (size * 255.0)).alias("delta"), (F.count_if(F.col("d") >= CHANGED) / size).alias("changed"), F.coalesce(box, F.lit(0.0)).alias("area"))
    still, cut, real = (F.col("delta") < 0.012) & (F.col("changed") < 0.08), (F.col("delta") > 0.18) & (F.col("changed") > 0.65), F.col("delta").isNotNull()
    deltas = F.sort_array(F.collect_list("delta"))  # a clip's transitions
    clips = steps.groupBy("clip").agg(
        F.count("*").alias("frames"), F.avg("delta").alias("mean_delta"), F.get(deltas, F.floor(F.size(deltas) / 2).cast("int")).alias("median_delta"), F.avg(F.when(real, still.cast("int"))).alias("static_ratio"),
        F.avg(F.when(real, cut.cast("int"))).alias("cut_ratio"), F.sort_array(F.collect_list(F.when(cut, F.col("frame") / fps))).alias("cut_times"), F.avg(F.when(real, F.col("area"))).alias("mean_area"),
    )
    return clips.join(spatial, "clip", "left")


def candidate_errors(pairs: DataFrame, before: list[str], after: list[str], scales: tuple[int, ...] = (2, 4)) -> DataFrame:
    """Per clip, over all pixels: mean and nearest-rank 95th percentile of the colour distance,
    its mean weighted by 1 plus the source's largest step to the right and below (in 0 to 1),
    and the mean distance of box averages at each scale. No sampling: sums are partial before
    the shuffle, so all pixels cost little more than some."""
    lab = lambda names: oklab(*[F.col(c) for c in names])
    near = by_frame(pairs).select("*", *[max_delta([F.col(c) for c in before], [F.lead(c).over(w) for c in before]).alias(n) for n, w in (("_sx", _along()), ("_sy", _down()))])
    weight = 1 + F.greatest(F.coalesce("_sx", F.lit(0)), F.coalesce("_sy", F.lit(0))) / 255.0
    seen = near.select("clip", oklab_distance(lab(before), lab(after)).alias("e"), weight.alias("w"))
    out = seen.groupBy("clip").agg(F.avg("e").alias("mean_error"), (F.sum(F.col("e") * F.col("w")) / F.sum("w")).alias("edge_weighted_error"))
    out = joined(out, counted_percentiles(seen, ["clip"], "e", {"p95_error": 0.95}), ["clip"], "left")
    for s in scales:
        boxes = pairs.groupBy(*FRAME, F.floor(F.col("y") / s).alias("_y"), F.floor(F.col("x") / s).alias("_x")).agg(*[F.round(F.avg(c)).alias(c) for c in [*before, *after]])
        out = out.join(boxes.groupBy("clip").agg(F.avg(oklab_distance(lab(before), lab(after))).alias(f"low_error_{s}")), "clip")
    return out


def write_totals(frames: DataFrame) -> DataFrame:
    """Per clip of frames (clip, frame, width, height, delay_cs, table_size, disposal): how many
    frames and indexed pixels, their delay, local palette entries, and frames by disposal."""
    return frames.groupBy("clip").agg(
        F.count("*").alias("frames"), F.sum(F.col("width") * F.col("height")).alias("pixels"), F.sum("delay_cs").alias("delay_cs"), F.coalesce(F.sum("table_size"), F.lit(0)).alias("entries"),
        F.count_if(F.col("disposal") == "keep").alias("kept"), F.count_if(F.col("disposal") == "background").alias("cleared"), F.count_if(F.col("disposal") == "previous").alias("restored"),
    )
