"""Rules over clips, frames and outputs, as column functions. Fixed values stand in tables."""

from pyspark.sql import Column, functions as F

from fernweave.functions.scalar import clamp, file_kind, first_matching, half_up, symmetric_delta_percent, violations

# The weight of each frame signal by focus; `calm` is 1 - noise.
IMPORTANCE = {
    "subject": {"subject_saliency": 0.31, "skin_ratio": 0.17, "motion": 0.16, "scene_change": 0.18, "edge_text": 0.07, "changed_area": 0.11, "compression_cost": -0.07},
    "motion": {"motion": 0.39, "changed_area": 0.22, "scene_change": 0.20, "edge_text": 0.06, "subject_saliency": 0.08, "compression_cost": -0.06},
    "text_ui": {"edge_text": 0.43, "scene_change": 0.18, "changed_area": 0.11, "motion": 0.08, "subject_saliency": 0.06, "noise": -0.09, "compression_cost": -0.05},
    "flat_art": {"edge_text": 0.28, "scene_change": 0.21, "changed_area": 0.15, "motion": 0.12, "subject_saliency": 0.09, "calm": 0.08, "compression_cost": -0.07},
}
# Size of a format relative to GIF, scale steps in percent, frame rates by
# least duration, byte targets.
FORMAT_FACTOR = {"gif": 1.0, "webp": 0.4, "avif": 0.1, "apng": 2.8, "mp4": 0.1, "webm": 0.1, "live_photo": 0.2}
FPS_BY_DURATION = ((12.0, 8), (6.0, 10), (3.0, 12))
SIZE_RANGE = (0.78, 1.3)
# Least amounts of load levels 1 to 4, and the tier names of levels 0 to 4.
LOAD_LEVELS = {"duration_s": (12, 45, 120, 300), "frames": (360, 1_200, 3_600, 9_000), "pixel_frames": (100_000_000, 500_000_000, 2_000_000_000, 8_000_000_000), "bytes": (40_000_000, 150_000_000, 500_000_000, 1_500_000_000)}
LOAD_TIERS = ("short", "short", "standard", "long", "extreme")
CONCURRENCY = {"short": 4, "standard": 3, "long": 2, "extreme": 1}
# Palette sizes that a colour ceiling can take.
COLOUR_LADDER = [3, 4, 8, 16, 24, 32, 48, 64, 80, 96, 112, 128, 160, 192, 224, 256]
# Patterns of failure texts, first match wins.
FAILURES = (
    ("cancelled", r"_task_cancelled|\bcancell?ed\b|operation was aborted|任务已(?:取消|停止)"),
    ("disk-space", r"no space left|disk (?:is )?full|enospc|磁盘空间不足|空间不够"),
    ("permission", r"permission denied|access (?:is )?denied|eacces|eperm|cannot write|could not create|read-only|拒绝访问|没有权限|不可写"),
    ("dependency", r"(?:ffmpeg|ffprobe).*(?:not found|missing|unavailable)|(?:not found|failed to (?:find|locate)).*(?:ffmpeg|ffprobe)|missing dependency|encoder .*not found|unknown (?:encoder|filter)|转换组件"),
    ("output-path", r"invalid (?:output|path|filename)|output (?:directory|path).*not (?:found|exist)|points to a file|not a folder|parent directory|路径.*(?:无效|不存在)|文件名.*无效"),
    ("input-media", r"invalid data found|could not find codec parameters|unsupported (?:video|format|codec)|moov atom not found|decode failed|decode(?:r|ing)? (?:error|failed)|素材.*(?:损坏|无法读取|不支持)"),
)
# Kinds of file extensions.
KINDS = {"gif": "animation", "webp": "animation", "apng": "animation", "png": "image", "jpg": "image", "jpeg": "image", "mp4": "video", "mov": "video", "webm": "video", "mkv": "video", "avi": "video"}
TASK, PLACE = "[task]", "[path]"
# Passes of the redaction, in their order.
REDACTED = (
    (r"(?i)\b(?:task[_ -]?id\s*[:=]\s*|[a-z]+_task_cancelled:)[\w{}.-]+", TASK),
    (r"(?i)\btask-[a-z0-9][\w.-]*", TASK),
    (r"(?i)\b[a-f0-9]{8}-[a-f0-9]{4}-[1-5][a-f0-9]{3}-[89ab][a-f0-9]{3}-[a-f0-9]{12}\b", TASK),
    (r"[\"'][a-zA-Z]:[\\/][^\"'\r\n]+[\"']", PLACE),
    (r"(?i)\b[a-z]:[\\/].*?(?=\s+(?:/(?:Users|home|tmp|var|private|mnt|media|opt)/|task(?:[_ -]?id|-)|(?:input|output)=)|[\r\n;,]|$)", PLACE),
    (r"[a-zA-Z]:[\\/][^\s<>:\"|?*]*", PLACE),
    (r"(^|[\s='\"(])/(?:Users|home|tmp|var|private|mnt|media|opt)(?:/[^\s'\"),;]+)+", "$1" + PLACE),
    (r"\[path\](?:[\\/][^\s'\"),;]+)+", PLACE),
)


def frame_importance(signals: dict[str, Column], focus: Column) -> Column:
    """Weighted sum of a frame's signals for a focus, held to 0 to 1; an unknown focus takes flat art."""
    have = signals | {"calm": 1 - signals["noise"]}
    score = {name: clamp(sum(have[s] * w for s, w in weights.items()), 0.0, 1.0) for name, weights in IMPORTANCE.items()}
    out = score["flat_art"]
    for name, s in score.items():
        out = F.when(focus == name, s).otherwise(out)
    return out


def resolve_focus(mean: dict[str, Column]) -> Column:
    """The focus of a clip from the means of its signals: temporal evidence before saliency."""
    smooth = (mean["changed_area"] >= 0.20) & (mean["smooth_gradient_ratio"] >= 0.18) & (mean["edge_text"] <= 0.08) & (mean["noise"] <= 0.05)
    return first_matching(
        (smooth, "flat_art"),
        ((mean["motion"] >= 0.025) | (mean["changed_area"] >= 0.04), "motion"),
        ((mean["edge_text"] >= 0.28) & (mean["noise"] <= 0.35), "text_ui"),
        (mean["subject_saliency"] * 0.7 + mean["skin_ratio"] * 0.9 >= 0.28, "subject"),
        otherwise="flat_art",
    )


def region_class(std: Column, edge: Column, skin: Column, temporal: Column, noise: Column) -> Column:
    """The class of an image region from its signals, by thresholds in order."""
    return first_matching(
        ((skin >= 0.18) & ((std >= 0.025) | (edge >= 0.02)) & (std <= 0.32), "skin_subject"),
        ((edge >= 0.08) & (std <= 0.38) & (temporal <= 0.20), "text_edge"),
        (noise >= 0.012, "texture"),
        ((std <= 0.08) & (edge <= 0.05), "flat"),
        otherwise="texture",
    )


def dither_strength(kind: Column, std: Column, edge: Column, temporal: Column, noise: Column) -> Column:
    """How strongly a region of a class is dithered, 0 to 255."""
    value = (
        F.when(kind == "flat", F.lit(18.0))
        .when(kind == "text_edge", 30 + edge * 45)
        .when(kind == "skin_subject", 50 + (edge + temporal * 0.15) * 45)
        .otherwise(142 + (std + edge + noise * 2 + temporal * 0.35) * 70)
    )
    return clamp(F.round(value), 0.0, 255.0).cast("int")


def is_skin(r: Column, g: Column, b: Column) -> Column:
    """Two rules for skin colours: a general and a bright one."""
    spread = F.greatest(r, g, b) - F.least(r, g, b)
    general = (r > 95) & (g > 40) & (b > 20) & (spread > 15) & (F.abs(r - g) > 15) & (r > g) & (r > b)
    bright = (r > 200) & (g > 170) & (b > 120) & (r >= g) & (g > b) & (F.abs(r - g) <= 45)
    return general | bright


def estimated_bytes(width: Column, height: Column, fps: Column, duration_s: Column, format_: Column, colours: Column | int = 64, lossy: Column | int = 46) -> Column:
    """struct(likely, lower, upper): output size from pixels times frames and a coefficient of
    palette size and lossy level; other formats relative to the GIF of default settings."""
    c = colours if isinstance(colours, Column) else F.lit(colours)
    x = lossy if isinstance(lossy, Column) else F.lit(lossy)
    own = clamp(0.32 + clamp(c, 3, 256) / 1000 - clamp(x, 0, 100) / 1500, 0.24, 0.62)
    factor = F.element_at(F.create_map(*[F.lit(v) for pair in FORMAT_FACTOR.items() for v in pair]), format_)
    per = F.when(format_ == "gif", own).otherwise(F.lit(0.32 + 64 / 1000 - 46 / 1500))
    likely = F.greatest(F.lit(16 * 1024), half_up(width * height * fps * duration_s * per * factor)).cast("long")
    return F.struct(likely.alias("likely"), half_up(likely * SIZE_RANGE[0]).cast("long").alias("lower"), half_up(likely * SIZE_RANGE[1]).cast("long").alias("upper"))


def starting_fps(duration_s: Column, source_fps: Column) -> Column:
    """A frame rate by duration, at most the source's, which counts as 6 to 30."""
    out = F.lit(15)
    for least, fps in reversed(FPS_BY_DURATION):
        out = F.when(duration_s >= least, fps).otherwise(out)
    return F.least(out, clamp(F.floor(source_fps), 6, 30).cast("int"))


def load_level(amounts: dict[str, Column]) -> Column:
    """0 to 4: the highest level that any amount reaches."""
    level = lambda name, v: sum((F.coalesce(v, F.lit(0)) >= least).cast("int") for least in LOAD_LEVELS[name])
    return F.greatest(*[level(n, v) for n, v in amounts.items()])


def load_tier(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LOAD_TIERS)), level + 1)


def failure_category(text: Column) -> Column:
    """The first category whose pattern a failure text has, in any case; else unknown."""
    return first_matching(*[(F.lower(text).rlike(p), name) for name, p in FAILURES], otherwise="unknown")


def redact(text: Column) -> Column:
    """Task ids, UUIDs, and Windows, home and temporary paths replaced by marks, one pass after
    another. A bare Windows path may hold spaces: it goes on to the next path, task, argument,
    comma, semicolon or end of the line."""
    for pattern, mark in REDACTED:
        text = F.regexp_replace(text, pattern, mark)
    return text


def asset_kind(path: Column) -> Column:
    return file_kind(path, KINDS)


def recommended_format(intent: Column, duration_s: Column, fps: Column, has_alpha: Column, focus: Column, source_kind: Column) -> Column:
    """The delivery format of a clip: by intent, then by length, source and content."""
    drawn = has_alpha & focus.isin("text_ui", "flat_art")
    video = F.when(has_alpha, "webm").otherwise("mp4")
    modern = F.when(drawn, "apng").otherwise("webp")
    smart = F.when((duration_s >= 10) | (fps >= 30), video).when((source_kind == "gif") & ~has_alpha, "gif").otherwise(modern)
    return F.when(intent == "compatibility", "gif").when(intent == "modern_animation", modern).when(intent == "video", video).otherwise(smart)


def roi_readiness(has_alpha: Column, frames: Column, scene_boundaries: Column, changed_area: Column) -> Column:
    """What a region of interest can be based on: alpha, motion, saliency, or nothing."""
    area = clamp(changed_area, 0.0, 1.0)
    cuts = clamp(F.try_divide(scene_boundaries.cast("double"), (frames - 1).cast("double")), 0.0, 1.0)
    return first_matching(
        (F.coalesce(has_alpha, F.lit(False)), "alpha_mask"),
        (F.coalesce(frames < 2, F.lit(True)), "insufficient"),
        ((cuts >= 0.28) | (area >= 0.72), "unsuitable"),
        (area <= 0.38, "motion_baseline"),
        otherwise="content_saliency",
    )


def envelope_violations(out: dict[str, Column], limit: dict[str, Column]) -> Column:
    """What an output breaks of a platform's limits; a null limit holds nothing back."""
    free = lambda ok, name: ok | limit[name].isNull()
    return violations(
        (F.array_contains(limit["formats"], out["format"]), "format"),
        ((out["width"] > 0) & (out["height"] > 0), "dimensions"),
        (out["fps"] > 0, "fps"),
        (out["duration_s"] > 0, "duration"),
        (out["bytes"] > 0, "size"),
        (free(out["width"] <= limit["width"], "width"), "width over limit"),
        (free(out["fps"] <= limit["fps"], "fps"), "fps over limit"),
        (free(out["duration_s"] <= limit["duration_s"], "duration_s"), "duration over limit"),
        (free(out["bytes"] <= limit["bytes"], "bytes"), "size over limit"),
        (free((out["width"] <= 0) | (out["height"] <= 0) | (F.abs(out["width"] / out["height"] - limit["aspect"]) / limit["aspect"] <= 0.01), "aspect"), "aspect off"),
    )


def evidence_state(reasons: Column, tested_at: Column, now: Column, max_age_days: float = 180) -> Column:
    """inferred without a test, invalid with reasons, expired beyond the age, else verified."""
    age = F.timestamp_diff("SECOND", tested_at, now) / 86400
    return first_matching((tested_at.isNull(), "inferred"), ((F.size(reasons) > 0) | (age < 0), "invalid"), (age > max_age_days, "expired"), otherwise="verified")


def colour_ceiling(base: Column, target: Column, size: Column) -> Column:
    """The palette ladder's rung for the base palette scaled by the square of the byte ratio;
    the base itself where the sizes are within 5 percent or there is nothing to spend."""
    ratio = target / F.greatest(size, F.lit(1))
    wanted = F.greatest(F.ceil(base * ratio * ratio).cast("int"), base)
    rungs = F.array(*map(F.lit, COLOUR_LADDER))
    rung = F.coalesce(F.array_min(F.filter(rungs, lambda x: x >= wanted)), F.lit(256))
    return F.when((target <= size) | (symmetric_delta_percent(target, size) <= 5), base).otherwise(rung)
