"""Undo and redo over logs of any length: a scan of stretches, not a fold over a project.

Of a history, where its pointer stands and how long it is decide all that an action does: at
most depth + 1 lengths and places, and the history before the first commit. So a stretch of a
log is a function on those states, made without knowing the stretch before; functions of a
project's stretches are put together in order, which says where each one begins, and then all
run at once, in one pass over each partition's ordered rows. A commit writes its revision to a slot, numbered from the project's first one;
the current revision is the last one written to the slot that the pointer ends on.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fernweave.functions.quantiles import cell_of, joined, measured
from fernweave.sources.shared import written

#: Rows of a project's log that one task takes at once; longer logs are cut.
STRETCH = 1 << 14


def states(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and length of all histories: first the one without a revision (length -1)."""
    length, place = np.tril_indices(depth + 1)
    return np.append(0, place), np.append(-1, length)


def stepped(actions: list[str], place: np.ndarray, length: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Histories after the actions: place, length and how many slots their begin has moved, and
    for the first history the slot that each action writes, -1 if none."""
    place, length, base = place.copy(), length.copy(), np.zeros(len(place), dtype=np.int64)
    slots = np.full(len(actions), -1, dtype=np.int64)
    for i, action in enumerate(actions):
        if action == "commit":
            full = place == depth
            base += full
            place = np.where(length < 0, 0, np.where(full, depth, place + 1))
            length = place.copy()
            slots[i] = base[0] + place[0]
        elif action == "undo":
            place = np.maximum(place - 1, 0)
        elif action == "redo":
            place = np.maximum(np.minimum(place + 1, length), 0)
    return place, length, base, slots


def _number(place: int, length: int) -> int:
    """Where states() has it."""
    return 0 if length < 0 else 1 + length * (length + 1) // 2 + place


def history_state(log: DataFrame, depth: int = 100, stretch: int = STRETCH) -> DataFrame:
    """Per project of a log (project, seq, action, revision; actions commit, undo, redo): the
    current revision, and how many steps can be undone and redone. A commit ends what could be
    redone; at most `depth` steps can be undone. Rows of one seq are in the order of action and
    revision; other actions change nothing; rows without a seq are left out. A log of more than
    `stretch` rows is cut by its seq into stretches, each run by a task of its own."""
    kind = log.schema["project"].dataType.simpleString()
    own = log.where("seq is not null").select("project", "seq", "action", F.col("revision").cast("bigint").alias("revision"))
    own = written(own.withColumn("_w", F.lit(1)), "log")
    long = own.groupBy("project").agg(F.count("*").alias("_n")).where(F.col("_n") > stretch).select("project")
    sizes = measured(joined(own, long, ["project"], "left_semi"), ["project"], "seq")  # only of logs that are cut
    cut = written(joined(own, sizes, ["project"], "left").withColumn("cell", cell_of("seq", stretch)).select("project", "cell", "seq", "action", "revision"), "stretches")
    cells = written(cut.groupBy("project").agg(F.max("cell").alias("last"), F.count_distinct("cell").alias("cells")), "cells")
    along = ["seq", "action", "revision"]

    def function(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        place, length, base, _ = stepped(group.sort_values(along)["action"].tolist(), *states(depth), depth)
        return pd.DataFrame([[*key, place.tolist(), length.tolist(), base.tolist()]])

    def begins(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        place, length, base, out = 0, -1, 0, []
        for r in group.sort_values("cell").itertuples():
            out.append([*key, r.cell, place, length, base])
            at = _number(place, length)
            place, length, base = int(r.place[at]), int(r.length[at]), base + int(r.base[at])
        return pd.DataFrame(out)

    state = f"project {kind}, cell int, place int, length int, base bigint"
    several = joined(cut, cells.where("cells > 1").select("project"), ["project"], "left_semi")
    functions = several.groupBy("project", "cell").applyInPandas(function, f"project {kind}, cell int, place array<int>, length array<int>, base array<bigint>")
    starts = functions.groupBy("project").applyInPandas(begins, state)
    alone = cells.where("cells = 1").select("project", F.col("last").alias("cell"), F.lit(0).alias("place"), F.lit(-1).alias("length"), F.lit(0).cast("bigint").alias("base"))
    starts = written(starts.union(alone), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ends and writes of stretches that follow each other, whose rows are in order. Slots
        before where a history then begins are out of reach of all that follows."""
        key = kinds = place = length = base = None
        wrote, out = {}, []

        def end() -> None:
            out.append((*key, base + place if length >= 0 else -1, None, None, place, max(length - place, 0)))
            out.extend((*key, slot, *last, None, None) for slot, last in wrote.items() if slot >= base)

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

        for batch in batches:
            kinds = {"project": batch.schema.field("project").type, "cell": pa.int32(), "slot": pa.int64(), "seq": pa.int64(), "revision": pa.int64(), "undoable": pa.int32(), "redoable": pa.int32()}
            columns = (batch.column(c).to_pylist() for c in ("project", "cell", "seq", "action", "revision", "place", "length", "base"))
            for project, cell, seq, action, revision, *start in zip(*columns, strict=True):
                if (project, cell) != key:
                    if key is not None:
                        end()
                    key, wrote, (place, length, base) = (project, cell), {}, start
                if action == "commit":
                    base += place == depth
                    place = 0 if length < 0 else min(place + 1, depth)
                    length = place
                    wrote[base + place] = (seq, revision)
                elif action == "undo":
                    place = max(place - 1, 0)
                elif action == "redo":
                    place = max(min(place + 1, length), 0)
            yield told()
            out.clear()
        if key is not None:
            end()
            yield told()

    found = f"project {kind}, cell int, slot bigint, seq bigint, revision bigint, undoable int, redoable int"
    dealt = joined(cut, starts, ["project", "cell"]).repartition("project", "cell").sortWithinPartitions("project", "cell", "seq", F.asc_nulls_last("action"), F.asc_nulls_last("revision"))
    ran = written(dealt.select("project", "cell", "seq", "action", "revision", "place", "length", "base").mapInArrow(run, found), "ran")
    ends = joined(ran.where("undoable is not null"), cells.select("project", F.col("last").alias("cell")), ["project", "cell"], "left_semi")
    ends = ends.select("project", "slot", "undoable", "redoable")
    writes = ran.where("undoable is null").select("project", "slot", "seq", "revision")
    now = joined(writes, ends.select("project", "slot"), ["project", "slot"], "left_semi").groupBy("project", "slot").agg(F.max_by("revision", "seq").alias("revision"))
    return joined(ends, now, ["project", "slot"], "left").select("project", "revision", "undoable", "redoable")
