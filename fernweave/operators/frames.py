"""Frames as arrays: one row a frame with its packed pixels, numpy over the whole frame.

A stencil over a frame's neighbours needs no window and no row a pixel: frames are packed once
by their key, a bounded row each, and kernels run over batches of frames.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

FRAME = ["clip", "frame"]
# Frames of a clip that are looked at, the size that they are looked at in, weights
# of the five scales, the highest luma at which a step of 1 to 4 levels is visible, side of the
# flat neighbourhood and of the one whose levels are counted, and the share of pixels pooled.
SAMPLED, PRESENTED = 12, (320, 180)
SCALES = (16.0, 8.0, 4.0, 2.0, 1.0)
VISIBLE = (178, 305, 432, 559)
FLAT, NEAR, POOLED = 7, 5, (3, 5)


def packed(pixels: DataFrame, red: Column, green: Column, blue: Column) -> DataFrame:
    """pixels (clip, frame, y, x) as frames: clip, frame, width, height, at and rgb, places (y
    width + x) and colours (24 bits) of the pixels that are there. A frame is one row.

    A pixel crosses the shuffle as one number, whose bits are y, x (16 each: frames of formats
    are not larger) and its colour (32, so that channels beyond 255 stay what they are)."""
    colour = F.shiftleft(red.cast("int"), 16).bitwiseOR(F.shiftleft(green.cast("int"), 8)).bitwiseOR(blue.cast("int"))
    one = F.shiftleft(F.col("y").cast("long"), 48).bitwiseOR(F.shiftleft(F.col("x").cast("long"), 32)).bitwiseOR(colour.cast("long").bitwiseAND(0xFFFFFFFF))
    frames = pixels.select(*FRAME, "x", "y", one.alias("_p")).groupBy(*FRAME).agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), F.collect_list("_p").alias("p"))
    at = lambda p: (F.shiftrightunsigned(p, 48) * F.col("width") + F.shiftright(p, 32).bitwiseAND(0xFFFF)).cast("int")
    return frames.select(*FRAME, "width", "height", F.transform("p", at).alias("at"), F.transform("p", lambda p: F.shiftright(F.shiftleft(p, 32), 32).cast("int")).alias("rgb"))


def over_frames(frames: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], tuple], fields: str) -> DataFrame:
    """clip, frame and the fields that the kernel gives for each frame's colours (height, width,
    3; 0 where there is no pixel) and where its pixels are."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*FRAME).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                w, h = batch.column("width")[i].as_py(), batch.column("height")[i].as_py()
                at, c = (batch.column(x)[i].values.to_numpy() for x in ("at", "rgb"))
                flat, there = np.zeros((h * w, 3), dtype=np.int64), np.zeros(h * w, dtype=bool)
                flat[at] = np.stack([c >> 16, c >> 8 & 255, c & 255], axis=1)
                there[at] = True
                rows.append(kernel(flat.reshape(h, w, 3), there.reshape(h, w)))
            own = [batch.column(c) for c in FRAME]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c) for c in zip(*rows, strict=True)]], [*FRAME, *names])

    names = [f.split()[0] for f in fields.split(", ")]
    return frames.mapInArrow(run, f"{kinds}, {fields}")


def _shifted(v: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """What lies dy below and dx to the right of each place; fill beyond the edge."""
    h, w = v.shape[:2]
    out = np.full_like(v, fill)
    to = (slice(max(-dy, 0), min(h - dy, h)), slice(max(-dx, 0), min(w - dx, w)))
    if abs(dy) < h and abs(dx) < w:
        out[to] = v[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)]
    return out


def _clamped(v: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """As _shifted, with the edge's own value beyond it."""
    h, w = v.shape[:2]
    return v[np.clip(np.arange(h) + dy, 0, h - 1)][:, np.clip(np.arange(w) + dx, 0, w - 1)]


SPATIAL = "pixels long, colours long, n_skin long, n_c long, n_o long, skin_c long, l_c long, l_o long, n_g long, s_g long, n_edge long, g_c long, ng_c long, g_o long, ng_o long, n_smooth long, n_steps long, s_lap long, n_lap long"


def spatial_sums(rgb: np.ndarray, there: np.ndarray, edge: int, smooth: int) -> tuple:
    """The SPATIAL counts and sums of a frame: gradients to the right and below, steps of 1 to
    `smooth`, second differences, skin, and the middle half against the rest."""
    r, g, b = (rgb[..., i] for i in range(3))
    luma = (54 * r + 183 * g + 19 * b) >> 8
    h, w = there.shape
    has = {d: there & _shifted(there, *d, False) for d in ((0, 1), (1, 0), (0, -1), (-1, 0))}
    steps = has[0, 1].astype(np.int64) + has[1, 0]
    apart = sum(np.where(has[d], np.abs(luma - _shifted(luma, *d, 0)), 0) for d in ((0, 1), (1, 0)))
    edged = steps > 0
    gradient = apart // np.maximum(steps, 1)
    small = 0
    for d in ((0, 1), (1, 0)):
        delta = np.abs(rgb - _shifted(rgb, *d, 0)).max(axis=2)
        small += int((has[d] & (delta >= 1) & (delta <= smooth)).sum())
    inner = np.logical_and.reduce(list(has.values()))
    bend = np.abs(4 * luma - sum(_shifted(luma, *d, 0) for d in has))
    rows, columns = np.arange(h)[:, None], np.arange(w)[None, :]
    middle = (columns >= w // 4) & (columns < w - w // 4) & (rows >= h // 4) & (rows < h - h // 4)
    center, outer = there & middle, there & ~middle
    high, least = rgb.max(axis=2), rgb.min(axis=2)
    day = (r > 95) & (g > 40) & (b > 20) & (high - least > 15) & (np.abs(r - g) > 15) & (r > g) & (r > b)
    lit = (r > 200) & (g > 170) & (b > 120) & (r >= g) & (g > b) & (np.abs(r - g) <= 45)
    skin = there & (day | lit)
    colours = len(np.unique((rgb[there] >> 4) @ np.array([256, 16, 1])))
    n = lambda flags: int(flags.sum())
    return (
        n(there), colours, n(skin), n(center), n(outer), n(center & skin), n(luma[center]), n(luma[outer]), n(edged), n(gradient[edged]), n(edged & (gradient >= edge)),
        n(gradient[center & edged]), n(center & edged), n(gradient[outer & edged]), n(outer & edged), small, n(steps), n(bend[inner]), n(inner),
    )


def _presented(rgb: np.ndarray) -> np.ndarray:
    """Luma of limited range, scaled down to PRESENTED between neighbouring pixels."""
    luma = np.minimum((rgb @ np.array([66, 129, 25]) + 128 >> 8) + 16, 235)
    h, w = luma.shape
    scale = min(PRESENTED[0] / w, PRESENTED[1] / h, 1.0)
    if scale == 1.0:
        return luma
    to = [max(1, int(np.floor(n * scale + 0.5))) for n in (h, w)]
    at = [np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1) for m, n in zip(to, (h, w), strict=True)]
    low = [np.floor(a).astype(np.int64) for a in at]
    up = [np.minimum(a + 1, n - 1) for a, n in zip(low, (h, w), strict=True)]
    fy, fx = (at[0] - low[0])[:, None], (at[1] - low[1])[None, :]
    row = lambda y: luma[y][:, low[1]] * (1 - fx) + luma[y][:, up[1]] * fx
    return np.floor(row(low[0]) * (1 - fy) + row(up[0]) * fy + 0.5).astype(np.int64)


def _flat(image: np.ndarray) -> np.ndarray:
    """Which places have more neighbours without a step to the right and below than the
    frame's size asks for."""
    h, w = image.shape
    still = (image == _clamped(image, 0, 1)) & (image == _clamped(image, 1, 0))
    total = np.zeros((h + 1, w + 1), dtype=np.int64)
    total[1:, 1:] = still.cumsum(axis=0).cumsum(axis=1)
    r = FLAT // 2
    top, left = np.maximum(np.arange(h) - r, 0), np.maximum(np.arange(w) - r, 0)
    end, right = np.minimum(np.arange(h) + r + 1, h), np.minimum(np.arange(w) + r + 1, w)
    count = total[end][:, right] + total[top][:, left] - total[top][:, right] - total[end][:, left]
    area = max((w >> 6) * (h >> 6), 1)
    asked = FLAT * FLAT + 3 * ((area - 1).bit_length() - 11) - 1
    return count > max(int(asked / 2), 1)  # towards zero


def _most(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The value that two of the three share, else the least."""
    return np.where((a == b) | (a == c), a, np.where(b == c, b, np.minimum(np.minimum(a, b), c)))


def _steps(image: np.ndarray, flat: np.ndarray) -> float:
    """How much of a frame are visible steps between flat levels, over the pooled share of it."""
    r, (h, w), far = NEAR // 2, image.shape, np.int16(-(1 << 15))
    near = np.full((h + 2 * r, w + 2 * r), far)
    near[r : r + h, r : r + w] = np.where(flat, image, far)  # sums of four lumas fit
    levels = np.arange(1, len(VISIBLE) + 1)[:, None, None]
    sought = image.astype(np.int16) + np.arange(-len(VISIBLE), len(VISIBLE) + 1, dtype=np.int16)[:, None, None]
    counts = np.zeros(sought.shape, dtype=np.uint8)
    for dy in range(NEAR):
        for dx in range(NEAR):
            counts += near[dy : dy + h, dx : dx + w] == sought
    counts = counts.astype(np.int64)
    down, same, up = counts[: len(VISIBLE)][::-1], counts[len(VISIBLE)], counts[len(VISIBLE) + 1 :]
    n = np.maximum(down, up)
    seen = (n > 0) & (image[None] <= np.array(VISIBLE)[:, None, None]) & flat[None]
    value = np.where(seen, levels * same * n / np.maximum(same + n, 1), 0.0).max(axis=0).ravel()
    pooled = max(len(value) * POOLED[0] // POOLED[1], 1)
    return float(np.sort(value)[::-1][:pooled].sum() / pooled / NEAR**2)


def frame_banding(rgb: np.ndarray) -> float:
    """The banding score of one frame: sums of 2 x 2 luma, the flat places of it, and at each of
    five halved sizes the steps of the image that a mode filter leaves, which goes on."""
    luma = _presented(rgb)
    image = luma + _clamped(luma, 0, 1) + _clamped(luma, 1, 0) + _clamped(luma, 1, 1)
    flat, score = _flat(image), 0.0
    for weight in SCALES:
        along = _most(_clamped(image, 0, -1), image, _clamped(image, 0, 1))
        image = _most(_clamped(along, -1, 0), along, _clamped(along, 1, 0))
        score += weight * _steps(image, flat)
        image, flat = image[::2, ::2], flat[::2, ::2]
    return score / sum(SCALES)


def banding(pixels: DataFrame, red: Column, green: Column, blue: Column) -> DataFrame:
    """(clip, frames, banding): how many frames of a clip were looked at, SAMPLED evenly chosen
    ones at most, which is the measure, and the mean of their scores. A place without a pixel
    is black; a clip has at least one frame."""
    slim = pixels.select(*FRAME).distinct()
    n = slim.groupBy("clip").agg(F.count("*").alias("n"))
    place = slim.withColumn("k", F.row_number().over(W.partitionBy("clip").orderBy("frame")) - 1).join(n, "clip")
    chosen = F.exists(F.sequence(F.lit(0), F.least(F.lit(SAMPLED), F.col("n")).cast("int") - 1), lambda i: F.floor(i * F.col("n") / F.least(F.lit(SAMPLED), F.col("n"))) == F.col("k"))
    some = pixels.join(place.where(chosen).select(*FRAME), FRAME, "left_semi")
    scored = over_frames(packed(some, red, green, blue), lambda rgb, _: (frame_banding(rgb),), "score double")
    return scored.groupBy("clip").agg(F.count("*").alias("frames"), F.avg("score").alias("banding"))


# Fixed value: a pixel with a neighbour further off than this lies on an edge and stays.
EDGE = 24


def _reused(threshold: int) -> Callable[[np.ndarray, np.ndarray], tuple]:
    """A kernel that gives the number of changed pixels and all colours. A pixel waits for those
    left of it and above it, so each diagonal is worked on at once."""

    def kernel(rgb: np.ndarray, there: np.ndarray) -> tuple:
        h, w = there.shape
        calm = there.copy()
        for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0)):
            far = np.abs(rgb - _shifted(rgb, dy, dx, 0)).max(axis=2)
            calm &= _shifted(there, dy, dx, False) & (far <= EDGE)
        out = rgb.copy()
        for d in range(2, h + w - 3):
            y = np.arange(max(1, d - w + 2), min(h - 2, d - 1) + 1)
            y = y[calm[y, d - y]]
            x = d - y
            own, near = rgb[y, x], np.stack([out[y, x - 1], out[y - 1, x]])
            far = np.abs(near - own).max(axis=2)
            far = np.where((far > 0) & (far <= threshold), far, 256)
            best = far.argmin(axis=0)
            use = far[best, np.arange(len(y))] <= threshold
            out[y[use], x[use]] = near[best[use], np.flatnonzero(use)]
        changed = int((out != rgb).any(axis=2).sum())
        packed_out = out[..., 0] << 16 | out[..., 1] << 8 | out[..., 2]
        return changed, packed_out[there].astype(np.int32)

    return kernel


def reused_colours(frames: DataFrame, threshold: int) -> DataFrame:
    """clip, frame, changed (pixels) and rgb, the colours of the frame's pixels by place, after
    the reuse of neighbours' colours.

    A pixel whose four neighbours are there and differ by at most EDGE in each channel takes the
    closer of the colours that the pixels left and above have by then, the left one in a tie, if
    it differs from its own by at most the threshold (below 256) in each channel. So no
    error adds up along a run; borders of the frame, edges and pixels beside missing ones stay.
    """
    return over_frames(frames, _reused(threshold), "changed long, rgb array<int>")
