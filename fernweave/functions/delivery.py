"""Rules that judge results and plan deliveries, as column functions."""

from pyspark.sql import Column, functions as F

from fernweave.functions.scalar import clamp, first_matching, half_up, symmetric_delta_percent

# The band in which two quality scores are alike, the least reliable score, and
# the largest size difference of a near-size pair in percent.
WINNER_BAND, RELIABLE, NEAR_SIZE = 0.5, 20.0, 5.0
# Route labels by encoder.
ROUTES = {"ffmpeg_best_guard_baseline": "guard_fallback_to_fast", "rust_transparent_disposal_postprocess": "rust_transparent_coalesced", "ffmpeg_best_smooth_gradient_frame_palette": "ffmpeg_best_smooth_gradient_frame_palette", "ffmpeg_best_smooth_gradient_opaque": "ffmpeg_best_smooth_gradient_opaque", "ffmpeg_best_smooth_gradient": "ffmpeg_best_smooth_gradient"}
# Upper ends of the pressures low, medium and high.
PRESSURES = ((0.7, "low"), (1.6, "medium"), (3.2, "high"))
# Fixed values of the three target profiles: role, preference, factors of width, frame rate,
# colours and bytes, least frame rate.
PORTFOLIO = (("clearest", "clarity", 1.0, 0.72, 1.0, 1.0, 4), ("smoothest", "smoothness", 0.78, 1.35, 0.78, 1.0, 1), ("smallest", "smallest", 0.65, 0.6, 0.55, 0.72, 3))


def quality_winner(delta: Column, challenger: str, incumbent: str) -> Column:
    """Who wins by a score difference (challenger minus incumbent); tie inside the band."""
    return F.when(delta > WINNER_BAND, challenger).when(delta < -WINNER_BAND, incumbent).otherwise("tie")


def route_label(encoder: Column, backend: Column, source_sha256: Column) -> Column:
    """The route that an encoder and its backend stand for; rules in order."""
    out = F.when(backend.startswith("rust."), "rust_perceptual").when((F.coalesce(source_sha256, F.lit("")) != "") & (encoder == "ffmpeg_fast"), "alpha_safe_ffmpeg").otherwise("ffmpeg")
    for name, label in reversed(ROUTES.items()):
        out = F.when(encoder == name, label).otherwise(out)
    return out


def comparison_class(size: Column, other_size: Column, score: Column, other_score: Column, winner: Column) -> Column:
    """near_size_ with the winner where sizes are within NEAR_SIZE percent (metric_floor if a
    score is too low to rely on); else whether the other is smaller at a like or lower score."""
    near, reliable = symmetric_delta_percent(size, other_size) <= NEAR_SIZE, F.least(score, other_score) >= RELIABLE
    return first_matching(
        (near & reliable, F.concat(F.lit("near_size_"), F.lower(winner))),
        (near, "near_size_metric_floor"),
        ((other_size < size) & (other_score - score >= -WINNER_BAND), "other_smaller_quality_tie"),
        (other_size < size, "other_smaller_quality_tradeoff"),
        otherwise="unmatched_other",
    )


def finite(value: Column) -> Column:
    """Not null, NaN or infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def pooled(value: Column, least: bool = False) -> Column:
    """An aggregate: the mean (or least) of the finite values; null without any."""
    own = F.when(finite(value), value)
    return F.min(own) if least else F.avg(own)


def cap_fill(size: Column, cap: Column) -> Column:
    """Size as a percentage of its cap, 2 places, halves to even; null without a cap."""
    return F.bround(F.try_divide(size * 100.0, cap.cast("double")), 2)


def oklab_to_rgb(lab: Column) -> Column:
    """struct(r, g, b), 0 to 255, of a struct(l, a, b): the inverse of oklab()."""
    cube = lambda a, b: F.pow(lab["l"] + lab["a"] * a + lab["b"] * b, 3)
    x, y, z = cube(0.3963377774, 0.2158037573), cube(-0.1055613458, -0.0638541728), cube(-0.0894841775, -1.2914855480)
    rows = {"r": (4.0767416621, -3.3077115913, 0.2309699292), "g": (-1.2684380046, 2.6097574011, -0.3413193965), "b": (-0.0041960863, -0.7034186147, 1.7076147010)}

    def channel(m: tuple[float, float, float]) -> Column:
        v = clamp(x * m[0] + y * m[1] + z * m[2], 0.0, 1.0)
        return F.round(F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, 1 / 2.4) - 0.055) * 255).cast("int")

    return F.struct(*[channel(m).alias(n) for n, m in rows.items()])


def palette_plan(mode: Column, content: Column, wants_frames: Column, can_frames: Column, can_rectangle: Column) -> Column:
    """struct(stats, dither, per_frame, rectangle, notes): how palettes are made and used. Per-frame
    palettes need best mode, frequent scene changes, and a backend that can; they rule rectangles out."""
    eligible = (mode == "best") & (content == "frequent_scene_changes")
    per_frame = wants_frames & eligible & can_frames
    notes = F.array_compact(
        F.array(F.when(wants_frames & ~eligible, "per-frame palette not eligible"), F.when(wants_frames & eligible & ~can_frames, "per-frame palette not supported"), F.when(~per_frame & ~can_rectangle, "rectangles not supported"))
    )
    return F.struct(
        F.when(per_frame, "single").when(content == "static_or_small_changes", "diff").otherwise("full").alias("stats"),
        F.when(mode == "best", "sierra2_4a").otherwise("bayer").alias("dither"), per_frame.alias("per_frame"), (~per_frame & can_rectangle).alias("rectangle"), notes.alias("notes"),
    )


def content_class(alpha: Column, focus: Column, priority: Column, fps: Column, is_video: Column, colours: Column) -> Column:
    return first_matching(
        (alpha, "transparent_asset"), ((focus == "text_ui") | (priority == "text"), "screen_ui"), (focus == "flat_art", "flat_art"),
        ((focus == "motion") | (priority == "motion") | (F.coalesce(fps, F.lit(0)) >= 48), "high_motion"), (is_video, "photographic"), (colours <= 128, "flat_art"),
        otherwise="photographic",
    )


def size_pressure(width: Column, height: Column, fps: Column, duration: Column, colours: Column, alpha: Column, is_video: Column, moving: Column, target_bytes: Column) -> Column:
    """How hard a target presses: expected bytes over the target, 0.05 to 20."""
    motion = F.when(moving, 1.24).when(is_video, 1.12).otherwise(0.92)
    raw = width * height * clamp(fps, 1, 60) * clamp(duration, 0.1, 3600.0) * F.when(alpha, 1.28).otherwise(1.0) * motion * (0.65 + clamp(colours, 3, 256) / 256 * 0.55) * 0.055
    return clamp(raw / target_bytes, 0.05, 20.0)


def pressure_name(score: Column) -> Column:
    return first_matching(*[(score < top, name) for top, name in PRESSURES], otherwise="extreme")


def timeline_policy(pressure: Column, kind: Column, priority: Column) -> Column:
    """full_cfr without pressure; else static frames are held only where neither content nor
    priority is motion, and then on screens or under extreme pressure."""
    can_hold = ~kind.isin("high_motion", "transparent_asset") & (priority != "motion")
    return F.when(pressure == "low", "full_cfr").when(can_hold & ((pressure == "extreme") | (kind == "screen_ui")), "static_hold").otherwise("motion_protected_drop_hold")


def output_confidence(missed: Column, fallback: Column, warnings: Column, quality: Column, platform: Column) -> Column:
    """struct(level, action, risks): adjust, check or ready. quality: 0 poor, 1 fair, 2 good, null
    not measured; platform: null or the state of its evidence."""
    some = F.size(F.coalesce(warnings, F.array().cast("array<string>"))) > 0
    risks = F.array_compact(
        F.array(
            F.when(missed, "target missed"), F.when(fallback, "encoder fell back"), F.when(some, F.try_element_at(warnings, F.lit(1))), F.when(quality.isNull(), "quality not measured"),
            F.when(quality == 0, "quality loss"), F.when(platform == "inferred", "platform inferred"), F.when(platform == "expired", "platform evidence expired"), F.when(platform == "invalid", "platform evidence invalid"),
        )
    )
    doubtful = fallback | some | quality.isNull() | (quality == 1) | (platform.isNotNull() & (platform != "verified"))
    level = F.when(missed | (F.coalesce(quality, F.lit(2)) == 0), "adjust").when(F.coalesce(doubtful, F.lit(False)), "check").otherwise("ready")
    action = F.when(missed, "smaller").when(F.coalesce(quality, F.lit(2)) <= 1, "clearer").otherwise("regenerate")
    return F.struct(level.alias("level"), action.alias("action"), risks.alias("risks"))


def target_portfolio(width: Column, fps: Column, colours: Column, target_bytes: Column, source_fps: Column) -> Column:
    """Three rows in one array: the clearest, smoothest and smallest profile for a target."""
    even = lambda v: (F.floor(v / 2) * 2).cast("int")
    w, f, c = even(clamp(half_up(width), 96, 1920)), clamp(half_up(fps), 1, 60), clamp(half_up(colours), 3, 256)
    source = F.when(source_fps > 0, clamp(F.floor(source_fps), 1, 60)).otherwise(60)
    least = lambda v: F.greatest(F.lit(65536), half_up(v)).cast("long")
    rows = []
    for role, preference, kw, kf, kc, kb, low in PORTFOLIO:
        smooth = F.greatest(f, F.least(source, clamp(F.ceil(f * kf), 1, 60)))
        rate = smooth if kf > 1 else F.greatest(F.lit(low), half_up(f * kf))
        rows.append(F.struct(F.lit(role).alias("role"), F.lit(preference).alias("preference"), even(w * kw).alias("width"), rate.cast("int").alias("fps"), clamp(half_up(c * kc), 3, 256).cast("int").alias("colours"), least(least(target_bytes) * kb).alias("bytes")))
    return F.array(*rows)


def insets_to_rect(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """struct(x, y, width, height) in percent of insets from the four sides."""
    x, y = clamp(left, 0.0, 100.0), clamp(top, 0.0, 100.0)
    r, b = F.least(F.greatest(right, F.lit(0.0)), 100 - x), F.least(F.greatest(bottom, F.lit(0.0)), 100 - y)
    return F.struct(F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), F.round(100 - x - r, 2).alias("width"), F.round(100 - y - b, 2).alias("height"))


def rect_to_insets(x: Column, y: Column, width: Column, height: Column) -> Column:
    """struct(left, top, right, bottom) in percent of a rectangle: the inverse of insets_to_rect()."""
    a, b = clamp(x, 0.0, 100.0), clamp(y, 0.0, 100.0)
    w, h = F.least(F.greatest(width, F.lit(0.0)), 100 - a), F.least(F.greatest(height, F.lit(0.0)), 100 - b)
    return F.struct(F.round(a, 2).alias("left"), F.round(b, 2).alias("top"), F.round(100 - a - w, 2).alias("right"), F.round(100 - b - h, 2).alias("bottom"))


def trust_state(manifest: Column, version_ok: Column, name_ok: Column, hash_ok: Column, signed: Column, clean: Column) -> Column:
    """struct(context, status, reasons) of a packaged build: unverified without a manifest,
    mismatch where it differs from what runs, else trusted if signed and from a clean tree."""
    reasons = F.array_compact(F.array(F.when(~version_ok, "version differs"), F.when(~name_ok, "name differs"), F.when(~hash_ok, "hash differs"), F.when(~signed, "not signed"), F.when(~clean, "source not clean")))
    status = F.when(~(version_ok & name_ok & hash_ok), "mismatch").when(signed & clean, "trusted").otherwise("unverified")
    none = F.array(F.lit("no manifest"))
    return F.struct(F.when(manifest, "packaged").otherwise("development").alias("context"), F.when(manifest, status).otherwise("unverified").alias("status"), F.when(manifest, reasons).otherwise(none).alias("reasons"))


def vote_is_sound(vote: dict[str, Column], expected: dict[str, Column]) -> Column:
    """Whether every stored field of a vote is what its pair and choice imply, nulls included."""
    chosen = F.when(vote["choice"] == "A", expected["side_a"]).when(vote["choice"] == "B", expected["side_b"])
    blind = expected["formal"] & ~vote["revealed"] & vote["first_at"].isNotNull() & vote["last_at"].isNotNull()
    fields = [("category", expected["category"]), ("formal", expected["formal"]), ("blind", blind), ("side_a", expected["side_a"]), ("side_b", expected["side_b"]), ("chosen", chosen)]
    ok = F.coalesce(vote["choice"].isin("A", "B", "same"), F.lit(False)) & F.coalesce(vote["revisions"] <= 1_000_000, F.lit(False))
    for name, want in fields:
        ok = ok & vote[name].eqNullSafe(want)
    return ok


def formal_pair(size_delta: Column, most: float, a_ok: Column, b_ok: Column, commit: Column, dirty: Column) -> Column:
    """Whether a pair counts: near in size, both sides correct, from a clean known commit."""
    return F.coalesce((size_delta <= most) & a_ok & b_ok & ~dirty & (commit != ""), F.lit(False))
