"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to BITS bits each; the position of a row's cell on the
Hilbert curve orders the table, and shards are runs of that order. Cells close on the
curve are close in every dimension, so a shard covers short ranges of all of them and a
reader prunes shards by any. Cells are quantiles of the ordered values (sources and languages
by name, sizes by number), so each holds about as many rows and neighbouring cells hold
neighbouring values; equal values share a cell. Within a cell rows are ordered by a hash of
the id.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fernweave.llm.running import quick_place, with_running_totals
from fernweave.llm.store import stored

#: Bits of each dimension; steps of a size for each doubling.
BITS, STEPS = 4, 16
#: Distinct values of a dimension whose cells are broadcast.
VALUES = 100_000
#: Most combinations of values whose cells are broadcast.
COMBINATIONS = 200_000
# Fixed values of the curve in three dimensions, by the Gray-code rank of the sub-cube
# within its parent: the corner it is entered at, and the axis along which it is crossed.
ENTRY = (0, 0, 0, 3, 3, 6, 6, 5)
AXIS = (0, 1, 1, 2, 2, 1, 1, 0)


def hilbert_index(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """The place on a Hilbert curve of a cell with coordinates of `bits` bits; any null makes null.

    From the top bit down, the three bits name a sub-cube. Turned into the orientation of
    its parent, its inverse Gray code is its rank, which also gives the next orientation.
    """
    entry, axis = F.array(*map(F.lit, ENTRY)), F.array(*map(F.lit, AXIS))

    def turn(v: Column, by: Column) -> Column:
        """Three bits turned left by 0 to 2."""
        wide = F.call_function("shiftleft", v, by)
        return wide.bitwiseOR(F.call_function("shiftright", wide, F.lit(3))).bitwiseAND(7)

    def down(s: Column, i: Column) -> Column:
        bit = lambda c: F.call_function("shiftright", c, i).bitwiseAND(1)
        corner = F.shiftleft(bit(x), 2).bitwiseOR(F.shiftleft(bit(y), 1)).bitwiseOR(bit(z))
        turned = turn(corner.bitwiseXOR(s["e"]), (F.lit(5) - s["d"]) % 3)
        rank = turned.bitwiseXOR(F.shiftright(turned, 1)).bitwiseXOR(F.shiftright(turned, 2))
        return F.struct(
            F.shiftleft(s["h"], 3).bitwiseOR(rank).alias("h"),
            s["e"].bitwiseXOR(turn(F.get(entry, rank), (s["d"] + 1) % 3)).alias("e"),
            ((s["d"] + F.get(axis, rank) + 1) % 3).alias("d"),
        )

    start = F.struct(F.lit(0).alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, down, lambda s: s["h"])


def _quantile_cells(sums: DataFrame, key: str, bits: int) -> DataFrame:
    """(key, cell): the cell in which the middle row of each value falls, when the rows are
    cut into 2^bits runs in the order of values; null comes first. sums: key and its count of
    rows `n`. Values, however many, are dealt into ranges, whose totals are summed up first."""
    by = sums.groupBy(key).agg(F.sum("n").alias("n"))
    ranged = stored(by.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "values")
    totals = ranged.groupBy("_range").agg(F.sum("n").alias("_t"))  # a row a range
    before = W.partitionBy().orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"), F.sum("_t").over(W.partitionBy()).alias("all"))
    inside = W.partitionBy("_range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("_off") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("n") / 2
    placed = ranged.join(F.broadcast(offsets), "_range").select(key, middle.alias("m"), "all")
    return placed.select(key, F.least(F.lit((1 << bits) - 1), F.floor(F.col("m") * (1 << bits) / F.col("all"))).cast("int").alias("cell"))


def curve_places(rows: DataFrame, bits: int) -> DataFrame:
    """(source, lang, step, curve) of every combination in rows (columns source, lang and step,
    a number that grows with the size). The curve is computed once a combination, not a row."""
    sums = stored(rows.groupBy("source", "lang", "step").agg(F.count("*").alias("n")), "combinations")
    out = sums
    for c in ("source", "lang", "step"):
        cells = stored(_quantile_cells(sums.select(c, "n"), c, bits), "cells").withColumnRenamed(c, "_key")
        if cells.limit(VALUES + 1).count() <= VALUES:
            cells = F.broadcast(cells)
        out = out.join(cells, F.col(c).eqNullSafe(F.col("_key"))).withColumnRenamed("cell", f"_{c}").drop("_key")
    return stored(out.select("source", "lang", "step", hilbert_index(F.col("_source"), F.col("_lang"), F.col("_step"), bits).alias("curve")), "curve")


def hilbert_shards(df: DataFrame, n_shards: int = 8, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", bits: int = BITS, size: Column | None = None) -> DataFrame:
    """df with size, curve (the cell's place), shard and slot (gapless from 0 in each shard).

    law "rows": counts of any two shards differ by one at most. law "bytes": a shard ends
    with the row in which its share of the total size is reached, so sizes differ by one
    row's at most. size is the text's UTF-8 bytes (null: none) plus 1, unless
    the caller gives another, so that texts need not be moved. Repeated rows get
    slots of their own; null ids, sources and languages are values like any other; columns
    named like the added ones are replaced; an empty table gives none.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1 if size is None else size
    added = ["size", "curve", "shard", "slot"]
    own = [c for c in df.columns if c not in added]
    named = lambda c: F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")
    dims = [named(source_col).alias("source"), named(lang_col).alias("lang"), F.floor(F.log2(size) * STEPS).cast("int").alias("step")]
    places = curve_places(df.select(*dims), bits)
    if places.count() <= COMBINATIONS:
        places = F.broadcast(places)
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(id_col).cast("string").alias("_id"), size.alias("size"), *[d.alias(f"_{n}") for d, n in zip(dims, ("source", "lang", "step"), strict=True)])
    same = [F.col(f"_{n}").eqNullSafe(places[n]) for n in ("source", "lang", "step")]
    cells = keyed.join(places, same[0] & same[1] & same[2]).select("_row", "size", "curve", F.lit(1).cast("long").alias("_one"), quick_place(F.col("curve"), F.col("_id")).alias("_place"))
    ranked = with_running_totals(cells, ["curve"], "_place", {"_one": "_rank", "size": "_bytes"})
    sums = cells.groupBy("curve").agg(F.count("*").alias("_n"), F.sum("size").alias("_b"))  # a row a cell, 2^(3 bits) at most
    before, every = W.orderBy("curve").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    offsets = sums.select(
        "curve",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"),
        F.sum("_n").over(every).alias("_rows"),
        F.sum("_b").over(every).alias("_total"),
    )
    placed = ranked.join(F.broadcast(offsets), "curve").withColumn("_rank", F.col("_rank") + F.col("_n0"))
    if law == "rows":
        placed = placed.withColumn("shard", F.expr(f"cast(_rank * {n_shards} div _rows as int)"))
        first = F.expr(f"(shard * _rows + {n_shards - 1}) div {n_shards}")
    elif law == "bytes":
        placed = placed.withColumn("shard", F.expr(f"cast((_bytes + _b0) * {n_shards} div _total as int)"))
        heads = placed.groupBy("shard").agg(F.min("_rank").alias("_head"))  # a row a shard
        placed = placed.join(F.broadcast(heads), "shard")
        first = F.col("_head")
    else:
        raise ValueError(f"law is rows or bytes, not {law}")
    return placed.withColumn("slot", F.col("_rank") - first).select("_row.*", *added)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write hilbert_shards() as Parquet: a folder a shard, rows in slot order within files
    that hold a run of slots each."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
