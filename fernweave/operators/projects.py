"""Projects of an editor as tables: what they break, what they use, their layers and their files.

A project is a row of `projects`; assets, clips, layers and keyframes are rows of their own
tables with its key. No rule gathers a project: limits are counts, references are joins on
(project, id), and only a layer's keyframes are put in order.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fernweave.functions.scalar import file_kind

# Most rows of a project (of a layer for keyframes), longest project and source.
LIMITS = {"assets": 128, "clips": 2048, "layers": 64, "keyframes": 128}
PROJECT_US, SOURCE_US = 300_000_000, 86_400_000_000
# Kinds of assets, and those that a replacement's extension gives.
ASSET_KINDS = ("video", "gif", "webp", "apng", "image")
REPLACEMENTS = {"gif": "gif", "webp": "webp", "apng": "apng", "png": "image", "jpg": "image", "jpeg": "image", "mp4": "video", "mov": "video", "mkv": "video", "webm": "video"}
COLOUR = "(?i)^#[0-9a-f]{6}$"


def _broken(df: DataFrame, detail: str, rules: dict[str, Column]) -> DataFrame:
    """(project, rule, detail) for each rule that does not hold; a null condition does not."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select("project", F.explode(names).alias("rule"), F.col(detail).cast("string").alias("detail"))


def _told(text: str, most_bytes: int) -> Column:
    return F.col(text).rlike(r"\S") & (F.octet_length(text) <= most_bytes)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _keyed(keyframes: DataFrame, layers: DataFrame) -> DataFrame:
    """keyframes with `_last`, the time at the place before, `_span`, the longest layer of their
    id, and in the first row of each layer `_n`, how many it has; a row without a keyframe
    (`_key` null) stands for each layer. All come of one exchange and one order: lists are
    short, and longer ones spill."""
    own = W.partitionBy("project", "layer_id")
    rows = keyframes.select("project", "layer_id", "place", "time_us", F.lit(None).cast("long").alias("_us"), F.lit(True).alias("_key"))
    ends = layers.select("project", F.col("id").alias("layer_id"), F.lit(None).alias("place"), F.lit(None).alias("time_us"), (F.col("end_us") - F.col("start_us")).alias("_us"), F.lit(None).alias("_key"))
    along = own.orderBy("place")
    first = F.when(F.row_number().over(along) == 1, F.count("_key").over(own))
    there = lambda v: F.when(F.col("project").isNotNull() & F.col("layer_id").isNotNull(), v)
    last = F.when(F.col("place").isNotNull(), F.max("time_us").over(along.rangeBetween(-1, -1)))
    return rows.unionAll(ends).select("*", there(last).alias("_last"), there(F.max("_us").over(own)).alias("_span"), first.alias("_n"))


def clip_duration(clip: dict[str, Column]) -> Column:
    """Hold, else the duration said, else the source range at its rate; zero says nothing."""
    said = F.coalesce(F.nullif(clip["hold_us"], F.lit(0)), F.nullif(clip["duration_us"], F.lit(0)))
    return F.coalesce(said, F.floor(F.try_divide(clip["out_us"] - clip["in_us"], clip["rate"]) + 0.5)).cast("long")


def project_violations(projects: DataFrame, assets: DataFrame, clips: DataFrame, layers: DataFrame, keyframes: DataFrame) -> DataFrame:
    """(project, rule, detail) of everything that projects break, a row for each; detail is the
    id concerned, or a count, or a duration.

    projects: project, revision, width, height, fps, background, max_bytes (null: no limit).
    assets: project, id, path, kind, width, height, duration_us.
    clips: project, id, asset_id, in_us, out_us, rate, hold_us, duration_us (null: by rate), fit.
    layers: project, id, kind, start_us, end_us, and of media asset_id and width, of text
    font_size, stroke_width and colour. keyframes: project, layer_id, place (from 0), time_us.
    Ids are unique over assets, clips and layers of a project. Of assets that share an id the
    largest (kind, duration) stands for it; a keyframe whose layer is not there breaks a rule.
    Null where a value is due breaks its rule.
    """
    c = F.col
    own = _broken(
        projects,
        "project",
        {
            "project.revision": c("revision") >= 0,
            "canvas.width": c("width").between(96, 1920),
            "canvas.height": c("height").between(16, 1920),
            "canvas.fps": c("fps").between(1, 60),
            "canvas.background": c("background").rlike(COLOUR),
            "output.max_bytes": c("max_bytes").isNull() | c("max_bytes").between(1024, 512 << 20),
        },
    )
    of_assets = _broken(
        assets,
        "id",
        {
            "asset.path": _told("path", 32768),
            "asset.kind": c("kind").isin(*ASSET_KINDS),
            "asset.size": c("width").between(1, 100_000) & c("height").between(1, 100_000),
            "asset.duration": c("duration_us") >= 0,
        },
    )
    known = assets.groupBy("project", c("id").alias("asset_id")).agg(F.max(F.struct("kind", "duration_us")).alias("_asset"))
    timed = clips.withColumn("_us", clip_duration({n: c(n) for n in ("hold_us", "duration_us", "in_us", "out_us", "rate")}))
    there, held = c("_asset").isNotNull(), F.coalesce(c("hold_us") > 0, F.lit(False))
    of_clips = _broken(
        timed,
        "id",
        {
            "clip.times": c("in_us").between(0, SOURCE_US) & c("out_us").between(0, SOURCE_US) & (c("hold_us") >= 0),
            "clip.range": (c("out_us") > c("in_us")) | (held & (c("out_us") == c("in_us"))),
            "clip.rate": c("rate").between(0.05, 16),
            "clip.duration": c("_us") >= 1,
            "clip.fit": c("fit").isin("contain", "cover"),
        },
    )
    # Only what the asset decides meets it.
    of_sources = _broken(
        clips.select("project", "asset_id", "id", "in_us", "out_us").join(known, ["project", "asset_id"], "left"),
        "id",
        {
            "clip.asset": there,
            "clip.source": ~there | (c("_asset.kind") == "image") | ((c("out_us") <= c("_asset.duration_us")) & (c("in_us") < c("_asset.duration_us"))),
        },
    )
    total = timed.groupBy("project").agg(F.sum("_us").alias("_total"))
    too_long = _broken(total, "_total", {"project.duration": c("_total") <= PROJECT_US})
    media, text = c("kind") == "media", c("kind") == "text"
    of_layers = _broken(
        layers,
        "id",
        {
            "layer.kind": media | text,
            "layer.times": c("start_us").between(0, PROJECT_US) & c("end_us").between(1, PROJECT_US) & (c("end_us") > c("start_us")),
            "layer.width": ~media | c("width").between(0.01, 2),
            "layer.text": ~text | (c("font_size").between(1, 512) & c("stroke_width").between(0, 32) & c("colour").rlike(COLOUR)),
        },
    )
    shown = layers.where(F.coalesce(media, F.lit(True))).select("project", "asset_id", "id").join(known, ["project", "asset_id"], "left")
    of_shown = _broken(shown, "id", {"layer.asset": there})
    keys, broken = _keyed(keyframes, layers), lambda ok: c("_key") & ~F.coalesce(ok, F.lit(False))
    told = lambda fails, name, detail: F.when(fails, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
    three = F.array(
        told(broken(c("time_us").between(0, c("_span"))), "keyframe.time", c("layer_id")),
        told(broken((c("place") == 0) | (c("time_us") > c("_last"))), "keyframe.order", c("layer_id")),
        told(c("_n") > LIMITS["keyframes"], "too many keyframes", c("_n")),
    )
    of_keys = keys.select("project", F.inline(F.array_compact(three)))
    tables = {"assets": assets, "clips": clips, "layers": layers}
    found = [own, of_assets, of_clips, of_sources, too_long, of_layers, of_shown, of_keys]
    for name, rows in tables.items():
        found.append(_broken(rows.groupBy("project").agg(F.count("*").alias("_n")), "_n", {f"too many {name}": c("_n") <= LIMITS[name]}))
    ids = assets.select("project", "id").unionAll(clips.select("project", "id")).unionAll(layers.select("project", "id"))
    found.append(_broken(ids, "id", {"id.empty": F.col("id").rlike(r"\S")}))
    found.append(_broken(ids.groupBy("project", "id").agg(F.count("*").alias("_n")), "id", {"id.repeated": c("_n") == 1}))
    out = found[0]
    for rows in found[1:]:
        out = out.unionAll(rows)
    return out


def used_assets(clips: DataFrame, layers: DataFrame) -> DataFrame:
    """Distinct (project, asset_id) of all clips and of the visible media layers."""
    shown = layers.where(F.col("visible") & (F.col("kind") == "media"))
    both = clips.select("project", "asset_id").unionAll(shown.select("project", "asset_id"))
    return both.where("asset_id is not null").distinct()


def updated_layers(layers: DataFrame, patches: DataFrame) -> DataFrame:
    """layers with the patched values of at most one patch a layer, and `refused`: why a patch
    was not applied (kind: a layer keeps its kind; times: it must last), null otherwise.

    patches: project, id and columns of layers, null where a value stays.
    """
    named = [n for n in patches.columns if n not in ("project", "id")]
    patch = patches.select("project", "id", F.struct(*named).alias("_p"))
    new = {n: F.coalesce(F.col(f"_p.{n}"), F.col(n)) for n in named}
    value = lambda n: new.get(n, F.col(n))
    turned = F.col("_p.kind") != F.col("kind") if "kind" in named else F.lit(False)
    refused = F.when(F.coalesce(turned, F.lit(False)), "kind").when(F.col("_p").isNotNull() & ~F.coalesce(value("end_us") > value("start_us"), F.lit(False)), "times")
    both = layers.join(patch, ["project", "id"], "left").withColumn("refused", refused)
    kept = [F.when(F.col("refused").isNull(), value(n)).otherwise(F.col(n)).alias(n) if n in new else F.col(n) for n in layers.columns]
    return both.select(*kept, "refused")


def kept_keyframes(keyframes: DataFrame, layers: DataFrame) -> DataFrame:
    """The keyframes that lie within their layers' lengths; those of no layer go."""
    spans = layers.select("project", F.col("id").alias("layer_id"), (F.col("end_us") - F.col("start_us")).alias("_span"))
    return keyframes.join(spans, ["project", "layer_id"]).where("time_us <= _span").select(*keyframes.columns)


def path_key(path: Column) -> Column:
    """What a Windows file system takes for the same path."""
    return F.lower(F.translate(_stripped(path), "/", "\\"))


def replacement_plans(assets: DataFrame, selected: DataFrame) -> DataFrame:
    """For each selected file the plan to put it in the place of an asset's: project, id,
    old_path, new_path, name, kind and reason, null for a plan that can be applied (unknown
    asset, empty path or unsupported format otherwise).

    assets: project, id, path; ids are unique in a project. selected: project, id, path.
    """
    asked = selected.select("project", "id", _stripped(F.col("path")).alias("new_path"))
    both = asked.join(assets.select("project", "id", F.col("path").alias("old_path"), F.lit(True).alias("_there")), ["project", "id"], "left")
    kind = file_kind(F.col("new_path"), REPLACEMENTS)
    reason = F.when(F.col("_there").isNull(), "unknown asset").when(F.coalesce("new_path", F.lit("")) == "", "empty path").when(kind.isNull(), "unsupported format")
    name = F.regexp_extract("new_path", r"([^\\/]*)$", 1)
    return both.select("project", "id", "old_path", "new_path", F.when(name == "", F.col("new_path")).otherwise(name).alias("name"), kind.alias("kind"), reason.alias("reason"))


def relinked_assets(assets: DataFrame, plans: DataFrame) -> DataFrame:
    """assets with path, name and kind of their plans; the id stays, and what was measured of
    the old file (width, height, duration_us) is null. A plan for another path than the asset
    has now is not applied."""
    plan = plans.where("reason is null").select("project", "id", F.struct("old_path", "new_path", "name", "kind").alias("_p"))
    both = assets.join(plan, ["project", "id"], "left")
    applies = F.coalesce(path_key(F.col("path")) == path_key(F.col("_p.old_path")), F.lit(False))
    new = {"path": F.col("_p.new_path"), "name": F.col("_p.name"), "kind": F.col("_p.kind")}
    stale = ("width", "height", "duration_us")
    return both.select(*[F.when(applies, new[n]).otherwise(F.col(n)).alias(n) if n in new else F.when(~applies, F.col(n)).alias(n) if n in stale else F.col(n) for n in assets.columns])


def replaced_paths(paths: DataFrame, plans: DataFrame) -> DataFrame:
    """paths (project, place, path) with old paths replaced by the plans' new ones; of those
    that are then the same file only the first place stays.

    Of several plans for one old path in a project the one of the smallest id counts."""
    old = plans.where("reason is null").groupBy("project", path_key(F.col("old_path")).alias("_key")).agg(F.min_by("new_path", "id").alias("_new"))
    asked = paths.withColumn("_key", path_key(F.col("path"))).join(old, ["project", "_key"], "left")
    put = asked.select("project", "place", F.coalesce("_new", "path").alias("path"))
    first = put.groupBy("project", path_key(F.col("path")).alias("_key")).agg(F.min(F.struct("place", "path")).alias("_first"))
    return first.select("project", "_first.place", "_first.path")
