"""Corpus manifests as tables: what their fixtures, coverage, budgets and profiles break."""

from pyspark.sql import Column, DataFrame, functions as F

from fernweave.functions.scalar import is_safe_relative_path

# The schema's version, kinds of generators and modes, and ranges of profiles.
VERSION, SCOPE, ID = 1, "stable_profiles", "^[a-z0-9][a-z0-9_-]*$"
GENERATORS, STATES, MODES = ("lavfi", "external"), ("complete", "incomplete"), ("fast_gif", "best_gif", "target_size")
SECONDS, WIDTH, FPS, COLOURS, SCALE = (0.1, 30.0), (32, 3840), (1, 60), (2, 256), (0.25, 4.0)
# The modes of a profile whose size another may match, by constraint.
MATCHED = {"symmetric_match": ("best_gif",), "hard_cap": ("fast_gif", "best_gif")}


def _broken(df: DataFrame, detail: Column, rules: dict[str, Column]) -> DataFrame:
    """(manifest, rule, detail) for each rule that does not hold; a null condition does not."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select("manifest", F.explode(names).alias("rule"), detail.cast("string").alias("detail"))


def _hash(name: str) -> Column:
    return F.col(name).rlike("^[0-9a-f]{64}$")


def _said(name: str) -> Column:
    return F.col(name).rlike(r"\S")


def manifest_violations(manifests: DataFrame, fixtures: DataFrame, required: DataFrame, profiles: DataFrame) -> DataFrame:
    """(manifest, rule, detail) of everything that manifests break; detail is the id or name
    concerned.

    manifests: manifest, version, status, min_total, min_per_category (null: no coverage asked), and
    the budget scope, memory_coverage, p95_ms, max_ms, p95_bytes, max_bytes (scope null: none).
    fixtures: manifest, id, category, tags, file, sha256 (null: not fixed), duration_s,
    generator, input, source_sha256, rights, pixel_format. required: manifest, kind
    (category or tag), name. profiles: manifest, place, id, mode, width, fps, colours, encoder,
    experimental, target_id, target_constraint (null: symmetric
    where a target is named), target_scale (null: 1). A profile
    that matches another's size names one of an earlier place; of repeated ids the first counts.
    """
    c = F.col
    own = fixtures.groupBy("manifest").agg(F.count("*").alias("_fixtures"), F.count_if(c("sha256").isNull()).alias("_open"))
    rated = profiles.groupBy("manifest").agg(F.count("*").alias("_profiles"), F.count_if(~c("experimental")).alias("_stable"))
    whole = manifests.join(own, "manifest", "left").join(rated, "manifest", "left").na.fill(0, ["_fixtures", "_open", "_profiles", "_stable"])
    free = c("scope").isNull()
    limit = lambda low, high: free | ((c(low) > 0) & (c(high) >= c(low)))
    of_whole = _broken(
        whole,
        c("manifest"),
        {
            "version": c("version") == VERSION,
            "status": c("status").isin(*STATES),
            "no fixtures": c("_fixtures") > 0,
            "no profiles": c("_profiles") > 0,
            "complete without hashes": (c("status") != "complete") | (c("_open") == 0),
            "coverage.total": c("min_total").isNull() | (c("_fixtures") >= c("min_total")),
            "budget.scope": free | (c("scope") == SCOPE),
            "budget.profiles": free | (c("_stable") > 0),
            "budget.memory_coverage": free | c("memory_coverage").between(0, 1),
            "budget.time": limit("p95_ms", "max_ms"),
            "budget.memory": limit("p95_bytes", "max_bytes"),
        },
    )
    inside = c("generator") != "external"
    of_fixtures = _broken(
        fixtures,
        c("id"),
        {
            "fixture.id": c("id").rlike(ID),
            "fixture.category": _said("category"),
            "fixture.file": is_safe_relative_path(c("file")) & F.lower("file").endswith(".mkv"),
            "fixture.sha256": c("sha256").isNull() | _hash("sha256"),
            "fixture.duration": c("duration_s").between(*SECONDS),
            "fixture.generator": c("generator").isin(*GENERATORS),
            "fixture.input": _said("input") & (inside | is_safe_relative_path(c("input"))),
            "fixture.source_sha256": inside | _hash("source_sha256"),
            "fixture.rights": inside | _said("rights"),
            "fixture.pixel_format": _said("pixel_format"),
        },
    )
    have = fixtures.select("manifest", F.lit("category").alias("kind"), c("category").alias("name"))
    have = have.unionAll(fixtures.select("manifest", F.lit("tag"), F.explode("tags"))).groupBy("manifest", "kind", "name").agg(F.count("*").alias("_n"))
    due = required.distinct().join(have, ["manifest", "kind", "name"], "left").na.fill(0, ["_n"]).join(manifests.select("manifest", "min_per_category"), "manifest")
    least = F.when(c("kind") == "tag", 1).otherwise(F.coalesce("min_per_category", F.lit(0)))
    of_coverage = due.where(c("_n") < least).select("manifest", F.concat(F.lit("coverage."), "kind").alias("rule"), c("name").alias("detail"))
    repeated = lambda df, what: df.groupBy("manifest", "id").agg(F.count("*").alias("_n")).where("_n > 1").select("manifest", F.lit(f"{what}.repeated").alias("rule"), c("id").alias("detail"))
    first = profiles.groupBy("manifest", c("id").alias("target_id")).agg(F.min(F.struct("place", "mode")).alias("_target"))
    seen = profiles.join(first, ["manifest", "target_id"], "left")
    sized, kind = F.coalesce(c("mode") == "target_size", F.lit(False)), F.coalesce("target_constraint", F.when(c("target_id").isNull(), "hard_cap").otherwise("symmetric_match"))
    scale, there = F.coalesce("target_scale", F.lit(1.0)), c("_target").isNotNull()
    alone = c("target_id").isNull() & c("target_constraint").isNull() & c("target_scale").isNull()
    fits = F.lit(False)
    for name, modes in MATCHED.items():
        fits = F.when(kind == name, c("_target.mode").isin(*modes)).otherwise(fits)
    within = lambda name, limits: c(name).between(*limits)
    of_profiles = _broken(
        seen,
        c("id"),
        {
            "profile.id": c("id").rlike(ID),
            "profile.mode": c("mode").isin(*MODES),
            "profile.width": within("width", WIDTH),
            "profile.fps": within("fps", FPS),
            "profile.colours": within("colours", COLOURS),
            "profile.encoder": _said("encoder"),
            "target.unasked": sized | alone,
            "target.constraint": ~sized | kind.isin(*MATCHED),
            "target.scale": ~sized | scale.between(*SCALE),
            "target.missing": ~sized | there,
            "target.later": ~sized | ~there | (c("_target.place") < c("place")),
            "target.mode": ~sized | ~there | fits,
            "target.symmetric_scale": ~sized | (kind != "symmetric_match") | (scale == 1),
        },
    )
    out = of_whole
    for rows in (of_fixtures, of_coverage, of_profiles, repeated(fixtures, "fixture"), repeated(profiles, "profile")):
        out = out.unionAll(rows)
    return out
