"""Acceptance gates: named checks over reports, whose failures are listed."""

from pyspark.sql import Column, DataFrame, functions as F


def unpivoted(df: DataFrame, keys: list[str], metrics: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """One row for each key and metric; nulls are kept."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias(name), F.col(m).cast("double").alias(value)) for m in metrics])).alias("_m")).select(*keys, "_m.*")


def regression_gate(candidate: DataFrame, baseline: DataFrame, keys: list[str], limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Keys with `failures` and `passed`. A metric fails where the candidate's value is over the
    baseline's by more than relative times it plus absolute, or is not a finite number; one
    that is null on both sides passes, on one side only fails. limits: metric to (relative, absolute).
    """
    side = lambda df, s: df.select(*keys, F.struct(*[F.col(m).cast("double").alias(m) for m in limits]).alias(s))
    both = side(candidate, "_c").join(side(baseline, "_b"), keys)
    failed = []
    for m, (relative, absolute) in limits.items():
        c, b = F.col(f"_c.{m}"), F.col(f"_b.{m}")
        ok = (c.isNull() & b.isNull()) | (F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)) & F.coalesce(c <= b + F.abs(b) * relative + absolute, F.lit(False)))
        failed.append(F.when(~ok, m))
    names = F.array_compact(F.array(*failed))
    return both.select(*keys, names.alias("failures"), (F.size(names) == 0).alias("passed"))


def budget_gate(slices: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    """Keys with the texts of all limits that are not met; a null does not meet its limit."""
    texts = [F.when(~F.coalesce(F.col(m) <= limit, F.lit(False)), F.concat(F.lit(f"{m} "), F.coalesce(F.col(m).cast("string"), F.lit("missing")), F.lit(f" over {limit:g}"))) for m, limit in limits.items()]
    found = F.array_compact(F.array(*texts))
    return slices.select(*keys, found.alias("violations"), (F.size(found) == 0).alias("passed"))


def all_hold(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: for each check whether it holds on all rows (true for none), their conjunction
    and the names of those that do not."""
    held = df.agg(*[F.coalesce(F.every(F.coalesce(c, F.lit(False))), F.lit(True)).alias(n) for n, c in checks.items()])
    failed = F.array_compact(F.array(*[F.when(~F.col(n), n) for n in checks]))
    return held.select("*", failed.alias("failures"), (F.size(failed) == 0).alias("passed"))


def recomputed_matches(stored: DataFrame, recomputed: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys and metrics in which a stored report differs from its recomputation by more than
    the tolerance, or that only one of them has."""
    both = unpivoted(stored, keys, metrics, value="stored").join(unpivoted(recomputed, keys, metrics, value="recomputed"), [*keys, "metric"], "full")
    same = F.col("stored").eqNullSafe(F.col("recomputed")) | F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) <= tolerance, F.lit(False))
    return both.where(~same)


def unknown_fields(df: DataFrame, keys: list[str], json_col: str, allowed: list[str], required: list[str]) -> DataFrame:
    """Keys of rows whose JSON object has other fields than the allowed ones or lacks required ones."""
    have = F.json_object_keys(json_col)
    extra, missing = F.array_except(have, F.array(*map(F.lit, allowed))), F.array_except(F.array(*map(F.lit, required)), F.coalesce(have, F.array().cast("array<string>")))
    found = df.select(*keys, F.array_sort(F.coalesce(extra, F.array().cast("array<string>"))).alias("unknown"), F.array_sort(missing).alias("missing"))
    return found.where((F.size("unknown") > 0) | (F.size("missing") > 0))


# Fixed values of the report gate: each metric's factor and allowance over the baseline, of the
# regional and of the diffusion checks, and the factor and allowance of a material gain in it.
METRICS = {
    "mean_oklab_error": ((1.06, 0.001), (1.01, 0.0001), (0.97, 0.0005)),
    "p95_oklab_error": ((1.08, 0.002), (1.01, 0.0002), None),
    "edge_weighted_mean_oklab_error": ((1.05, 0.001), (1.01, 0.0001), None),
    "multiscale_low_frequency_oklab_error": ((1.04, 0.00075), (1.01, 0.0001), (0.96, 0.0004)),
    "multiscale_banding_score": ((1.02, 0.0005), (1.01, 0.0001), (0.98, 0.0005)),
    "edge_gradient_error": ((1.05, 0.002), (1.01, 0.0002), None),
    "static_temporal_residual": ((1.02, 0.0005), (1.005, 0.000005), (0.95, 0.0002)),
    "multiscale_static_temporal_residual": ((1.02, 0.0004), (1.005, 0.000005), (0.95, 0.00015)),
}
# Counts that must be equal, and residuals by time, of which the seam's may both be missing.
COUNTS = ("sampled_static_transition_count", "sampled_multiscale_static_transition_count")
WEIGHTED = ("weighted_static_temporal_residual", "weighted_multiscale_static_temporal_residual")
SEAM = ("loop_seam_static_temporal_residual", "loop_seam_multiscale_static_temporal_residual")
TIMING, BYTES, BANDING = (1.005, 0.0000001), 105, ("multiscale_banding_score", 0.0001, 0.92)


def report_gate(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with `failures`, in the order of the checks, and `passed`, of a candidate report
    against its baseline.

    pairs: keys, structs candidate and baseline of METRICS, COUNTS, WEIGHTED and SEAM, and
    candidate_bytes, baseline_bytes, eligible and diffused pixels. Regional: no metric over its
    limit; more than 105 percent of the bytes (rounded up) only with a material gain in quality.
    Diffusion: some pixels were eligible and diffused, the same metrics within narrower limits,
    the bytes without an excuse. Timing: equal counts, residuals within their limit; a seam that
    only one side has is a failure of its own. At last the banding must have gained. A metric
    that is null fails its checks and gains nothing.
    """
    c, b = (lambda m, s=s: F.col(f"{s}.{m}").cast("double") for s in ("candidate", "baseline"))
    fails = lambda ok: ~F.coalesce(ok, F.lit(False))
    within = lambda m, limit: c(m) <= b(m) * limit[0] + limit[1]
    gains = [c(m) + gain[1] < b(m) * gain[0] for m, (_, _, gain) in METRICS.items() if gain]
    gained = F.coalesce(gains[0], F.lit(False))
    for g in gains[1:]:
        gained = gained | F.coalesce(g, F.lit(False))
    light = F.col("candidate_bytes") <= F.ceil(F.col("baseline_bytes") * BYTES / 100)
    failed = [(fails(within(m, regional)), f"regional:{m}") for m, (regional, _, _) in METRICS.items()]
    failed.append((fails(light | gained), "regional:serialized_bytes"))
    failed.append((fails((F.col("eligible") > 0) & (F.col("diffused") > 0)), "diffusion:no_material_work"))
    failed += [(fails(within(m, diffusion)), f"diffusion:{m}") for m, (_, diffusion, _) in METRICS.items()]
    failed.append((fails(light), "diffusion:serialized_bytes"))
    failed += [(fails(c(m) == b(m)), f"timing:{m}") for m in COUNTS]
    failed += [(fails(within(m, TIMING)), f"timing:{m}") for m in WEIGHTED]
    for m in SEAM:
        one, both = c(m).isNull() != b(m).isNull(), c(m).isNotNull() & b(m).isNotNull()
        failed += [(one, f"timing:{m}:contract"), (both & fails(within(m, TIMING)), f"timing:{m}")]
    name, least, factor = BANDING
    failed.append((fails((b(name) > least) & (c(name) + least < b(name) * factor)), "diffusion:material_banding_gain"))
    names = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in failed]))
    return pairs.select(*keys, names.alias("failures"), (F.size(names) == 0).alias("passed"))


# Fixed values of the blind review's gate.
REVIEWERS, OVERALL_RATE, CATEGORY_RATE = 3, 0.60, 0.45


def reviewer_gate(votes: DataFrame, expected: DataFrame) -> DataFrame:
    """The checks of a blind review: check, category (null but for the checks of a category),
    value and passed; the review passes if all do.

    votes: reviewer, pair, outcome (win, loss or tie). expected: pair, category, formal; a pair
    once. Only votes on formal pairs count; of several by one reviewer on a pair the least outcome
    by name stands for all. Checks: at least REVIEWERS reviewers; votes cover all formal pairs of
    all reviewers (value: the share; none due: 0); each reviewer has voted on all; the rate of
    wins among decisive votes overall and in each category with a formal pair. A rate is null
    where no vote was decisive, and fails.
    """
    due = expected.where("formal").select("pair", "category")
    reviewers = votes.select("reviewer").where("reviewer is not null").distinct()
    cast = votes.where("reviewer is not null").groupBy("reviewer", "pair").agg(F.min("outcome").alias("outcome")).join(due, "pair")
    n_due = due.agg(F.count("*").alias("_due"))
    each = reviewers.join(cast.groupBy("reviewer").agg(F.count("*").alias("_n")), "reviewer", "left").join(F.broadcast(n_due), how="cross")
    own = each.agg(
        F.count("*").alias("_reviewers"),
        F.coalesce(F.try_divide(F.sum(F.coalesce("_n", F.lit(0))), F.sum("_due")), F.lit(0.0)).alias("_coverage"),
        F.count_if(F.coalesce("_n", F.lit(0)) == F.col("_due")).alias("_complete"),
    )
    rate = F.try_divide(F.count_if(F.col("outcome") == "win").cast("double"), F.count_if(F.col("outcome").isin("win", "loss")))
    check = lambda name, value, ok: F.struct(F.lit(name).alias("check"), F.lit(None).cast("string").alias("category"), value.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("passed"))
    n, coverage, complete = F.col("_reviewers"), F.col("_coverage"), F.col("_complete")
    whole = own.select(F.explode(F.array(check("reviewers", n, n >= REVIEWERS), check("coverage", coverage, coverage == 1), check("complete reviewers", complete, complete == n)))).select("col.*")
    overall = cast.agg(rate.alias("_rate")).select(check("overall", F.col("_rate"), F.col("_rate") >= OVERALL_RATE).alias("c")).select("c.*")
    by = due.select("category").distinct().join(cast.groupBy("category").agg(rate.alias("value")), "category", "left")
    categories = by.select(F.lit("category").alias("check"), "category", "value", F.coalesce(F.col("value") >= CATEGORY_RATE, F.lit(False)).alias("passed"))
    return whole.unionAll(overall).unionAll(categories)


# Fixed values of the acceptance: least pairs and categories; by metric the most losses (rate)
# and the least mean improvement, overall and in a category, and the least rate of wins overall.
# Other metrics take OTHERS, whose means are in units of their tie bands.
PAIRS, CATEGORIES, WIN_RATE = 28, 7, {"vmaf_neg_mean": 0.60}
MEAN_LIMITS = {"vmaf_neg_mean": ((0.10, 0.50), (0.25, -0.25)), "vmaf_neg_p05": ((0.25, -0.50), (0.25, None))}
OTHERS = ((0.25, 0.0), (0.25, -0.5))


def acceptance_slices(sources: DataFrame, compared: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics of a comparison overall (category null) and by category: wins, losses, ties,
    severe, applicable, expected and eligible pairs, and passed.

    sources: fixture, category; a fixture once, its category not null. compared: fixture, metric,
    outcome, improvement, tie_units, severe; a sound pair once a metric. A pair is eligible if it has any
    row. A metric fails with a severe loss or outside its limits; one that nothing has passes
    in a category and fails overall.
    """
    pairs = compared.join(sources.select("fixture", "category"), "fixture")
    grouped = lambda df, keys, aggs: df.groupBy(*keys).agg(*aggs)
    count = [F.count_if(F.col("outcome") == o).alias(name) for o, name in (("win", "wins"), ("loss", "losses"), ("tie", "ties"))]
    found = [*count, F.count_if("severe").alias("severe"), F.count("*").alias("applicable"), F.avg("improvement").alias("_mean"), F.avg("tie_units").alias("_units")]
    # Sums of the categories would add up to those of the whole but for the rounding of means.
    tallied = grouped(pairs, ["category", "metric"], found).unionByName(grouped(pairs, ["metric"], found).withColumn("category", F.lit(None).cast("string")), allowMissingColumns=True)
    eligible = pairs.select("fixture", "category").distinct()
    sized = sources.groupBy("category").agg(F.count("*").alias("expected")).join(eligible.groupBy("category").agg(F.count("*").alias("eligible")), "category", "left").na.fill(0, ["eligible"])
    sized = sized.unionByName(sized.agg(F.sum("expected").alias("expected"), F.sum("eligible").alias("eligible")).withColumn("category", F.lit(None).cast("string")).na.fill(0))
    cells = sized.select("*", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    same = cells["category"].eqNullSafe(tallied["category"]) & (cells["metric"] == tallied["metric"])
    both = cells.join(tallied, same, "left").select(cells["*"], *[tallied[c] for c in tallied.columns if c not in ("category", "metric")])
    counts = ["wins", "losses", "ties", "severe", "applicable"]
    both = both.na.fill(0, counts)
    rate = lambda c: F.col(c).cast("double") / F.col("applicable")
    own = F.lit(False)
    for at, whole in ((0, True), (1, False)):
        ok = F.lit(False)
        for name in metrics:
            losses, mean = MEAN_LIMITS.get(name, OTHERS)[at]
            value = F.col("_mean" if name in MEAN_LIMITS else "_units")
            this = (rate("losses") <= losses) & (F.lit(True) if mean is None else value >= mean)
            if whole and name in WIN_RATE:
                this = this & (rate("wins") >= WIN_RATE[name])
            ok = F.when(F.col("metric") == name, this).otherwise(ok)
        own = F.when(F.col("category").isNull() if whole else F.col("category").isNotNull(), ok).otherwise(own)
    passed = F.when(F.col("applicable") == 0, F.col("category").isNotNull()).otherwise((F.col("severe") == 0) & F.coalesce(own, F.lit(False)))
    return both.select("category", "metric", *counts, "expected", "eligible", passed.alias("passed"))


def acceptance_violations(slices: DataFrame) -> DataFrame:
    """What keeps the slices of a comparison from acceptance: rule, category, metric; no row, accepted."""
    c, none = F.col, F.lit(None).cast("string")
    row = lambda rule, category, metric: F.struct(F.lit(rule).alias("rule"), category.alias("category"), metric.alias("metric"))
    overall, by = slices.where("category is null"), slices.where("category is not null")
    sizes = overall.agg(F.max("expected").alias("_expected"), F.max("eligible").alias("_eligible"))
    few = by.agg(F.countDistinct("category").alias("_n"))
    rules = [
        sizes.where(F.coalesce(c("_expected"), F.lit(0)) < PAIRS).select(row("pairs", none, none).alias("r")),
        sizes.where(F.coalesce((c("_expected") == 0) | (c("_eligible") < c("_expected")), F.lit(True))).select(row("coverage", none, none).alias("r")),
        few.where(c("_n") < CATEGORIES).select(row("categories", none, none).alias("r")),
        overall.where(~c("passed")).select(row("overall", none, c("metric")).alias("r")),
        by.groupBy("category").agg(F.every(c("passed") & (c("eligible") == c("expected"))).alias("_ok")).where(~c("_ok")).select(row("category", c("category"), none).alias("r")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionAll(r)
    return out.select("r.*")


# Fixed values of delivery evidence: formats, largest width, frame rate, seconds and bytes, and
# the aspect (width by height) of each policy; null: no limit. All policies are of revision 1.
POLICIES = {
    "qq_chat": (["gif"], 560, 18, None, 1.9, None),
    "wechat_chat": (["gif"], 420, 15, None, 1.9, None),
    "wechat_sticker": (["gif"], 240, 12, 3, 0.48, 1.0),
    "feishu_chat": (["gif"], 560, 18, None, None, None),
    "xiaohongshu_live": (["live_photo"], 1080, 30, 3, None, 3 / 4),
    "douyin_live": (["live_photo"], 1080, 30, 3, None, 9 / 16),
    "web_animation": (["webp", "gif"], 960, 24, None, None, None),
    "web_transparent_ui": (["apng", "webp"], 960, 30, None, None, None),
}
REVISION, MAX_AGE_DAYS, ASPECT_ERROR = "1", 180, 0.01
FORMATS, PLATFORMS = ("gif", "webp", "apng", "mp4", "live_photo"), ("windows", "macos", "ios", "android", "web")
LIFECYCLE = ("send", "receiver_playback", "forward", "download", "reopen")


def evidence_errors(records: DataFrame, now: Column) -> DataFrame:
    """(bundle, place, code, field) of everything wrong with records of delivery evidence; a
    bundle without a row is valid.

    records: bundle, place, evidence_id, policy_id, policy_revision, tested_at (text), name,
    version, os_version, platform, artifact_sha256, format, width, height, fps, duration_s,
    size_bytes and the booleans LIFECYCLE. Of records of one sound id in a bundle the one of the
    least place is no repetition. A null value breaks the rule of its field.
    """
    c = F.col
    table = records.sparkSession.createDataFrame([(k, *v) for k, v in POLICIES.items()], "policy_id string, _formats array<string>, _width int, _fps int, _s int, _mb double, _aspect double")
    plain = c("evidence_id").rlike("^[a-z0-9][a-z0-9._-]{2,127}$")
    first = records.where(plain).groupBy("bundle", "evidence_id").agg(F.min("place").alias("_first"))
    r = records.join(F.broadcast(table), "policy_id", "left").join(first, ["bundle", "evidence_id"], "left")
    shaped = c("tested_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$")
    at = F.when(shaped, F.try_to_timestamp("tested_at"))
    held = lambda value, most: most.isNull() | value.isNull() | (value <= most)
    positive = lambda n: (c(n) > 0) & (c(n) < float("inf"))
    known = c("_formats").isNotNull()
    ratio = c("width") / c("height")
    rules = [
        ("invalid_evidence_id", "evidence_id", plain),
        ("duplicate_evidence_id", "evidence_id", c("_first").isNull() | (c("place") == c("_first"))),
        ("unknown_policy_id", "policy_id", known),
        ("policy_revision_mismatch", "policy_revision", known & (c("policy_revision") == REVISION)),
        ("invalid_iso_date", "tested_at", at.isNotNull()),
        ("future_date", "tested_at", at.isNull() | (at <= now)),
        ("evidence_expired", "tested_at", at.isNull() | (at > now) | (F.unix_micros(now) - F.unix_micros(at) <= MAX_AGE_DAYS * 86_400_000_000)),
        *[("invalid_string", n, c(n).rlike(r"\S")) for n in ("name", "version", "os_version")],
        ("invalid_platform", "platform", c("platform").isin(*PLATFORMS)),
        ("invalid_sha256", "artifact_sha256", c("artifact_sha256").rlike("^[a-f0-9]{64}$")),
        ("invalid_format", "format", c("format").isin(*FORMATS)),
        *[("invalid_positive_integer", n, positive(n) & (c(n) == F.floor(n))) for n in ("width", "height", "size_bytes")],
        *[("invalid_positive_number", n, positive(n)) for n in ("fps", "duration_s")],
        ("format_outside_policy", "format", ~known | F.array_contains("_formats", c("format"))),
        ("width_exceeds_policy", "width", held(c("width"), c("_width"))),
        ("fps_exceeds_policy", "fps", held(c("fps"), c("_fps"))),
        ("duration_exceeds_policy", "duration_s", held(c("duration_s"), c("_s"))),
        ("size_exceeds_policy", "size_bytes", held(c("size_bytes"), c("_mb") * 1024 * 1024)),
        ("aspect_outside_policy", "width", c("_aspect").isNull() | ~F.coalesce((c("width") > 0) & (c("height") > 0), F.lit(False)) | (F.abs(ratio - c("_aspect")) / c("_aspect") <= ASPECT_ERROR)),
        *[("lifecycle_incomplete", n, c(n)) for n in LIFECYCLE],
    ]
    wrong = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))) for code, field, ok in rules]
    return r.select("bundle", "place", F.explode(F.array_compact(F.array(*wrong))).alias("e")).select("bundle", "place", "e.*")
