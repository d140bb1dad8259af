"""Edits of timelines, as transformations of tables of clips and layers.

clips: project, pos (the order in the project), id, in_us, out_us, rate, reverse, hold_us (0:
none), duration_us (null: from the source range and rate). layers: project, id, start_us,
end_us, locked. Edits come as tables too, at most one for each project, so one job edits all
projects. Windows hold one project's clips. All times are whole microseconds.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fernweave.functions.scalar import frame_at, frame_boundary_us, half_up

CLIP = ["project", "pos", "id", "in_us", "out_us", "rate", "reverse", "hold_us", "duration_us"]


def clip_length() -> Column:
    """How long a clip runs: its hold, else its duration, else its source range by its rate."""
    own = half_up((F.col("out_us") - F.col("in_us")) / F.col("rate")).cast("long")
    return F.when(F.col("hold_us") > 0, F.col("hold_us")).otherwise(F.coalesce(F.col("duration_us"), own))


def timeline(clips: DataFrame) -> DataFrame:
    """clips with start_us and end_us on their project's timeline."""
    length = clips.withColumn("_length", clip_length())
    end = F.sum("_length").over(W.partitionBy("project").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return length.withColumn("end_us", end).withColumn("start_us", F.col("end_us") - F.col("_length")).drop("_length")


def renumbered(clips: DataFrame, order: list[Column | str], columns: list[str] = CLIP) -> DataFrame:
    """The columns of clips with pos counted from 0 in the given order."""
    along = W.partitionBy("project").orderBy(*order)
    return clips.withColumn("_pos", (F.row_number().over(along) - 1).cast("int")).select(*[F.col("_pos").alias("pos") if c == "pos" else F.col(c) for c in columns])


def split_clips(clips: DataFrame, cuts: DataFrame) -> DataFrame:
    """clips, each cut in two where a cut (project, at_us) lies strictly inside it.

    The source range is cut where it plays at that time; the first part of a reversed clip has
    the later source. A hold is shared out. A cut less than a source tick from an end makes the
    shorter part a hold of that source position, and the longer keeps its length as duration.
    The second part's id ends in ":b".
    """
    placed = timeline(clips).join(cuts.select("project", "at_us"), "project", "left")
    hit = F.when((F.col("at_us") > F.col("start_us")) & (F.col("at_us") < F.col("end_us")), F.col("at_us") - F.col("start_us"))
    one = placed.select(*CLIP, "start_us", "end_us", hit.alias("local"))
    length, span = F.col("end_us") - F.col("start_us"), F.col("out_us") - F.col("in_us")
    moved = F.col("local") / length * span
    at = half_up(F.when(F.col("reverse"), F.col("out_us") - moved).otherwise(F.col("in_us") + moved)).cast("long")
    ready = one.select("*", length.alias("_n"), at.alias("_at"))
    held, tiny = F.col("hold_us") > 0, (F.col("_at") <= F.col("in_us")) | (F.col("_at") >= F.col("out_us"))
    source = F.least(F.col("out_us") - 1, F.greatest("in_us", "_at"))
    rest = F.col("_n") - F.col("local")
    short = F.col("local") <= F.col("_n") / 2

    def part(first: bool) -> Column:
        own, mine = (F.col("local"), short) if first else (rest, ~short)
        frozen = ~held & tiny & mine
        takes_out = F.col("reverse") != F.lit(first)  # whether this part ends or begins at the cut
        cut_in, cut_out = F.when(takes_out, F.col("in_us")).otherwise(F.col("_at")), F.when(takes_out, F.col("_at")).otherwise(F.col("out_us"))
        return F.struct(
            F.lit(0 if first else 1).alias("_half"),
            (F.col("id") if first else F.concat("id", F.lit(":b"))).alias("id"),
            F.when(held, F.col("in_us")).when(frozen, source).when(tiny, F.col("in_us")).otherwise(cut_in).alias("in_us"),
            F.when(held, F.col("out_us")).when(frozen, source).when(tiny, F.col("out_us")).otherwise(cut_out).alias("out_us"),
            F.when(held | frozen, own).otherwise(0).cast("long").alias("hold_us"),
            F.when(held | frozen, F.col("duration_us")).otherwise(own).cast("long").alias("duration_us"),
        )

    whole = F.struct(F.lit(0).alias("_half"), F.col("id"), F.col("in_us"), F.col("out_us"), F.col("hold_us").cast("long").alias("hold_us"), F.col("duration_us").cast("long").alias("duration_us"))
    parts = F.when(F.col("local").isNull(), F.array(whole)).otherwise(F.array(part(True), part(False)))
    out = ready.select("project", "pos", "rate", "reverse", F.explode(parts).alias("p")).select("project", "pos", "rate", "reverse", "p.*")
    return renumbered(out, ["pos", "_half"])


def remove_clips(clips: DataFrame, gone: DataFrame) -> DataFrame:
    """clips (or layers: project, id, pos) without those of gone (project, id)."""
    return renumbered(clips.join(gone.select("project", "id"), ["project", "id"], "left_anti"), ["pos"], clips.columns)


def move_clips(clips: DataFrame, moves: DataFrame) -> DataFrame:
    """clips (or layers) with one of each project of moves (project, id, to_pos) at another place."""
    m = moves.select("project", F.col("id").alias("_moved"), "to_pos")
    seen = clips.join(m, "project", "left")
    is_moved = F.coalesce(F.col("id") == F.col("_moved"), F.lit(False))
    rank = (F.row_number().over(W.partitionBy("project", is_moved).orderBy("pos")) - 1).cast("double")
    # The others keep their order; the moved one goes just before the one now at its place.
    place = F.when(is_moved, F.col("to_pos") - 0.5).otherwise(rank)
    return renumbered(seen.withColumn("_place", place), ["_place"], clips.columns)


def insert_clips(clips: DataFrame, added: DataFrame) -> DataFrame:
    """clips with added ones (the columns of clips) put before the clip that now has their pos."""
    both = clips.select(*CLIP, F.lit(1).alias("_new")).unionByName(added.select(*CLIP, F.lit(0).alias("_new")))
    return renumbered(both, ["pos", "_new", "id"])


def duplicate_clips(clips: DataFrame, chosen: DataFrame) -> DataFrame:
    """clips with a copy (id ending in ":copy") right after each of chosen (project, id)."""
    copies = clips.join(chosen.select("project", "id"), ["project", "id"], "left_semi").withColumn("id", F.concat("id", F.lit(":copy"))).withColumn("pos", F.col("pos") + 1)
    return insert_clips(clips, copies)


def update_clips(clips: DataFrame, patches: DataFrame) -> DataFrame:
    """clips with the values of patches (project, id, and new values of in_us, out_us, rate,
    reverse, hold_us; null: as it was). A new source range or rate takes the set duration away."""
    names = ["in_us", "out_us", "rate", "reverse", "hold_us"]
    p = patches.select("project", "id", *[F.col(c).alias(f"_{c}") for c in names])
    joined = clips.join(p, ["project", "id"], "left")
    changed = F.lit(False)
    for c in ("in_us", "out_us", "rate"):
        changed = changed | F.coalesce(F.col(f"_{c}") != F.col(c), F.lit(False))
    new = {c: F.coalesce(f"_{c}", c) for c in names} | {"duration_us": F.when(~changed, F.col("duration_us"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in CLIP])


def frame_span(projects: DataFrame, clips: DataFrame, at: str, fps: str) -> DataFrame:
    """projects with start_us and end_us of the frame of the grid that is on at a time; the last
    frame ends with the project. Projects without clips are left out."""
    ends = timeline(clips).groupBy("project").agg(F.max("end_us").alias("_total")).where("_total > 0")
    joined = projects.join(ends, "project")
    index = frame_at(F.least(F.col(at), F.col("_total") - 1), F.col(fps))
    return joined.select(*projects.columns, frame_boundary_us(index, F.col(fps)).alias("start_us"), F.least("_total", frame_boundary_us(index + 1, F.col(fps))).alias("end_us"))


def isolate_frames(clips: DataFrame, spans: DataFrame) -> DataFrame:
    """clips cut at both ends of each project's span (project, start_us, end_us), with `inside`."""
    cut = split_clips(split_clips(clips, spans.select("project", F.col("end_us").alias("at_us"))), spans.select("project", F.col("start_us").alias("at_us")))
    placed = timeline(cut).join(spans.select("project", F.col("start_us").alias("_a"), F.col("end_us").alias("_b")), "project", "left")
    return placed.select(*CLIP, "start_us", "end_us", F.coalesce((F.col("start_us") >= F.col("_a")) & (F.col("end_us") <= F.col("_b")), F.lit(False)).alias("inside"))


def delete_frames(clips: DataFrame, spans: DataFrame) -> DataFrame:
    """clips without what plays in each project's span; what follows moves up."""
    return renumbered(isolate_frames(clips, spans).where("not inside"), ["pos"])


def freeze_frames(clips: DataFrame, spans: DataFrame) -> DataFrame:
    """clips with what plays in each project's span (with its hold_us as `freeze_us`) replaced by
    a hold of its first source position."""
    isolated = isolate_frames(clips, spans).join(spans.select("project", "freeze_us"), "project", "left")
    first = F.min(F.when(F.col("inside"), F.col("pos"))).over(W.partitionBy("project"))
    seen = isolated.withColumn("_first", first).where("not inside or pos = _first")
    start = F.when(F.col("reverse"), F.col("out_us") - 1).otherwise(F.col("in_us"))
    source = F.when(F.col("hold_us") > 0, F.col("in_us")).otherwise(start)
    kept = seen.select(
        "project", "pos", "id", F.when(F.col("inside"), source).otherwise(F.col("in_us")).alias("in_us"), F.when(F.col("inside"), source).otherwise(F.col("out_us")).alias("out_us"), "rate", "reverse",
        F.when(F.col("inside"), F.col("freeze_us")).otherwise(F.col("hold_us")).alias("hold_us"), F.when(~F.col("inside"), F.col("duration_us")).alias("duration_us"),
    )
    return renumbered(kept, ["pos"])


def splice_layers(layers: DataFrame, splices: DataFrame) -> DataFrame:
    """layers after a splice of their project (project, at_us, removed_us, inserted_us, held):
    what lies in the removed range goes, what follows moves, and with held a layer on show just
    before the splice is held over the inserted time. Locked layers stay as they are.

    Pieces: part (before, held, after), id (the layer's own for the first piece that survives of
    before and after, else with the part's name after a colon), start_us, end_us.
    """
    j = layers.join(splices, "project", "left")
    a, b = F.col("start_us"), F.col("end_us")
    at, end = F.col("at_us"), F.col("at_us") + F.col("removed_us")
    shift = F.col("inserted_us") - F.col("removed_us")
    still = F.col("locked") | at.isNull() | ((F.col("removed_us") == 0) & (F.col("inserted_us") == 0))
    before, after = a < F.least(b, at), F.greatest(a, end) < b
    held = F.col("held") & (F.col("inserted_us") > 0) & (a <= at - 1) & (b > at - 1)
    piece = lambda part, id_, s, e: F.struct(F.lit(part).alias("part"), id_.alias("id"), s.cast("long").alias("start_us"), e.cast("long").alias("end_us"))
    own = F.col("id")
    named = lambda free, part: F.when(free, own).otherwise(F.concat(own, F.lit(f":{part}")))
    pieces = F.array_compact(
        F.array(
            F.when(before, piece("before", own, a, F.least(b, at))),
            F.when(held, piece("held", named(~before & ~after, "held"), at, at + F.col("inserted_us"))),
            F.when(after, piece("after", named(~before, "after"), F.greatest(a, end) + shift, b + shift)),
        )
    )
    parts = F.when(still, F.array(piece("whole", own, a, b))).otherwise(pieces)
    return j.select("project", "locked", F.explode(parts).alias("p")).select("project", "locked", "p.*")


def without_collinear(knots: DataFrame, keys: list[str], time: str, source: str) -> DataFrame:
    """Knots of a piecewise-linear clock but those on the line of their neighbours, by exact
    whole-number products. A run of knots on one line loses all but its ends in one pass."""
    along = W.partitionBy(*keys).orderBy(time)
    d = lambda f, c: (f(c).over(along) - F.col(c)).cast("decimal(19,0)")
    flat = d(F.lead, source) * d(F.lag, time) == d(F.lag, source) * d(F.lead, time)
    return knots.withColumn("_flat", F.coalesce(flat, F.lit(False))).where("not _flat").drop("_flat")


def upsert_keyframes(keys: DataFrame, edits: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """keys with edits: rows of one key (by) are replaced, new ones added, and those whose edit
    has null in all values removed."""
    new = edits.select(*by, F.struct(*values).alias("_n"), F.lit(True).alias("_e"))
    both = keys.select(*by, F.struct(*values).alias("_o")).join(new, by, "full")
    kept = both.select(*by, F.when(F.col("_e"), F.col("_n")).otherwise(F.col("_o")).alias("v")).select(*by, "v.*")
    some = F.lit(False)
    for c in values:
        some = some | F.col(c).isNotNull()
    return kept.where(some)


def draft_state(payload: Column, version: Column, saved_ms: Column, now_ms: Column, current: int, max_age_ms: int) -> Column:
    """empty, corrupt, unsupported, expired or ready: what a saved session is worth."""
    return (
        F.when(payload.isNull() | (F.trim(payload) == ""), "empty")
        .when(F.try_parse_json(payload).isNull() | version.isNull() | saved_ms.isNull(), "corrupt")
        .when(version != current, "unsupported")
        .when(now_ms - saved_ms > max_age_ms, "expired")
        .otherwise("ready")
    )


def edit_items(items: DataFrame, edits: DataFrame) -> DataFrame:
    """items (collection, id, revision, status, settings) after edits (collection, id, settings):
    a changed item has the next revision and is a draft again; an equal setting changes nothing."""
    e = edits.select("collection", "id", F.col("settings").alias("_new"))
    j = items.join(e, ["collection", "id"], "left")
    changed = F.coalesce(F.col("_new") != F.col("settings"), F.lit(False))
    return j.select(
        "collection", "id", F.when(changed, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"),
        F.when(changed, "draft").otherwise(F.col("status")).alias("status"), F.coalesce("_new", "settings").alias("settings"),
    )


def to_retry(items: DataFrame) -> DataFrame:
    """The items that an export takes up again: the failed ones."""
    return items.where("status = 'failed'")
