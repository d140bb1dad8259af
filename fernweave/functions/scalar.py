"""Column functions of the benchmark and media tables. All stay in generated code: no UDF."""

from pyspark.sql import Column, functions as F


def symmetric_delta_percent(a: Column, b: Column) -> Column:
    """abs(a - b) as a percentage of their mean; 0 where both are 0."""
    return F.when(a + b == 0, F.lit(0.0)).otherwise(F.abs(a - b) * 200.0 / (a + b))


def within_tolerance(size: Column, target: Column, tolerance_percent: Column | float, hard_cap: bool = False) -> Column:
    """Whether size is near target: tolerance is held to 1 to 25 percent of the symmetric
    delta, and under a hard cap a size above the target is never within it."""
    tolerance = F.greatest(F.lit(1.0), F.least(F.lit(25.0), F.lit(tolerance_percent) if not isinstance(tolerance_percent, Column) else tolerance_percent))
    near = symmetric_delta_percent(size, target) <= tolerance
    return near & (size <= target) if hard_cap else near


def guarded_rate(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is 0 or null."""
    return F.coalesce(guarded_rate(numerator, denominator), F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def half_up(value: Column) -> Column:
    """Rounding of halves towards plus infinity, as timeline editors do."""
    return F.floor(value + 0.5)


def psnr(mean_squared_error: Column, peak: float = 255.0) -> Column:
    """Peak signal-to-noise ratio in dB; null (not measurable) where the error is 0."""
    return F.when(mean_squared_error > 0, 10 * F.log10(F.lit(peak * peak) / mean_squared_error))


def outcome(delta: Column, band: float | Column) -> Column:
    """win, loss or tie of a signed improvement; the band itself is a tie."""
    band = band if isinstance(band, Column) else F.lit(band)
    return F.when(delta > band, "win").when(delta < -band, "loss").otherwise("tie")


def tolerance_bands(reference: Column, tie_abs: Column, tie_rel: Column, severe_abs: Column, severe_rel: Column) -> tuple[Column, Column]:
    """Half-widths of the tie band and, never inside it, of the severe band around a reference."""
    tie = tie_abs + F.abs(reference) * tie_rel
    return tie, F.greatest(severe_abs + F.abs(reference) * severe_rel, tie)


def compare_metric(candidate: Column, reference: Column, higher_is_better: Column, tie_abs: Column, tie_rel: Column, severe_abs: Column, severe_rel: Column) -> Column:
    """struct(improvement, tie_units, outcome, severe): severe where the loss reaches the severe band."""
    tie, severe = tolerance_bands(reference, tie_abs, tie_rel, severe_abs, severe_rel)
    gain = F.when(higher_is_better, candidate - reference).otherwise(reference - candidate)
    return F.struct(gain.alias("improvement"), guarded_rate(gain, tie).alias("tie_units"), outcome(gain, tie).alias("outcome"), (gain <= -severe).alias("severe"))


def violations(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that do not hold, in order; a check that is null fails."""
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for ok, name in checks]))


def first_matching(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(otherwise)
    for holds, label in reversed(rules):
        out = F.when(holds, label).otherwise(out)
    return out


def luma8(r: Column, g: Column, b: Column) -> Column:
    """Integer luma in 8 bits, weights 54, 183 and 19 of 256."""
    return F.shiftright((r * 54 + g * 183 + b * 19).cast("int"), 8)


def luma709(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def linear_light(channel: Column) -> Column:
    """An sRGB channel of 0 to 1 in linear light."""
    return F.when(channel <= 0.04045, channel / 12.92).otherwise(F.pow((channel + 0.055) / 1.055, F.lit(2.4)))


# The public OKLab matrices, linear sRGB to cone response and its cube root to Lab.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def oklab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) of an sRGB colour with channels of 0 to 255."""
    light = [linear_light(c / 255.0) for c in (r, g, b)]
    cone = [F.cbrt(sum(k * c for k, c in zip(row, light, strict=True))) for row in TO_LMS]
    return F.struct(*[sum(k * c for k, c in zip(row, cone, strict=True)).alias(n) for row, n in zip(TO_LAB, ("l", "a", "b"), strict=True)])


def oklab_distance(first: Column, second: Column) -> Column:
    return F.sqrt(sum(F.pow(first[n] - second[n], F.lit(2.0)) for n in ("l", "a", "b")))


def histogram_bin(r: Column, g: Column, b: Column, bits: int) -> Column:
    """One number from the top `bits` of each channel, red first."""
    top = [F.shiftright(c.cast("int"), 8 - bits) for c in (r, g, b)]
    return F.shiftleft(top[0], 2 * bits).bitwiseOR(F.shiftleft(top[1], bits)).bitwiseOR(top[2])


def over_background(channel: Column, alpha: Column, background: Column | int) -> Column:
    """A channel of 0 to 255 composited over an opaque background, rounded."""
    return F.round((channel * alpha + background * (255 - alpha)) / 255.0).cast("int")


def even_fit(width: Column, height: Column, edge: int) -> Column:
    """struct(width, height) scaled down to an edge limit, each side even and 2 at least."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(width, height))
    even = lambda v: F.greatest(F.lit(2), (F.floor(v * scale / 2 + 0.5) * 2).cast("int"))
    return F.struct(even(width).alias("width"), even(height).alias("height"))


def file_kind(path: Column, kinds: dict[str, str]) -> Column:
    """The kind of a path's extension, whatever its case; null for others."""
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def is_plain_id(text: Column) -> Column:
    """Lower-case letters and digits in parts joined by hyphens."""
    return F.coalesce(text.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))


def is_safe_relative_path(path: Column) -> Column:
    """Not absolute, without a drive, a back-slash, or a part that is empty, '.' or '..'."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce((path != "") & ~path.rlike(r"[\\:]") & ~bad, F.lit(False))


def parity(text: Column) -> Column:
    """The lowest bit of the text's SHA-256: a fair and repeatable coin."""
    return F.conv(F.substring(F.sha2(text, 256), 64, 1), 16, 10).cast("int") % 2


def wilson_interval(successes: Column, trials: Column) -> Column:
    """struct(low, high) of the 95 % Wilson score interval, null without trials."""
    z = 1.959963984540054
    n, p = trials.cast("double"), successes / trials
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(trials > 0, F.struct(F.greatest(F.lit(0.0), middle - half).alias("low"), F.least(F.lit(1.0), middle + half).alias("high")))


def frame_boundary_us(index: Column, fps: Column | float) -> Column:
    """Start of an output frame on the microsecond grid, halves up."""
    return half_up(index * F.lit(1_000_000.0) / fps).cast("long")


def frame_at(time_us: Column, fps: Column | float) -> Column:
    """The frame on screen at a time: the largest whose boundary is not after it."""
    guess = F.floor(time_us * fps / F.lit(1_000_000.0)).cast("long")
    return F.when(frame_boundary_us(guess + 1, fps) <= time_us, guess + 1).when(frame_boundary_us(guess, fps) > time_us, guess - 1).otherwise(guess)


def midpoints(duration: Column, n: int) -> Column:
    """n sample times in the middle of equal parts of a duration."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: duration * (i + 0.5) / n)


def heartbeat(elapsed_s: Column, searching: bool = False) -> Column:
    """Estimated whole percent of a running job: linear for 15 s, then ever slower up to a cap."""
    cap, growth = (94, 48) if searching else (92, 45)
    steps = lambda base, rate, since: base + F.floor((elapsed_s - since) * rate)
    later = F.least(F.lit(cap), 43 + F.floor(growth * (1 - F.exp(-(elapsed_s - 15) / 38.0))))
    return F.when(elapsed_s < 4, F.least(F.lit(19), steps(8, 3, 0))).when(elapsed_s < 15, F.least(F.lit(42), steps(20, 2, 4))).otherwise(later).cast("int")


def canonical_json(row: Column, keys: list[str]) -> Column:
    """JSON of a struct's fields in the order of their names: equal rows have equal text."""
    return F.to_json(F.struct(*[row[k].alias(k) for k in sorted(keys)]))
