"""Guarded joins: lookups that must match once, inventories that must agree, matrices that
must be complete, and pairs whose failures are reported instead of lost."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: A dimension is broadcast only up to this many rows, counted first.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is. At most
    rows + 1 rows are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_dimension(facts: DataFrame, dim: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """facts left-joined with columns of a dimension; a missing row or value gives the
    default. columns: name to default."""
    kept = small(dim.select(key, *columns))
    joined = facts.join(kept, key, "left")
    return joined.select(*facts.columns, *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in columns.items()])


def strict_lookup(asked: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """asked with n_matches and status: ok, missing or ambiguous. A caller that wants an
    error filters on status."""
    counts = table.groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = asked.join(counts, keys, "left").withColumn("n_matches", F.coalesce("_n", F.lit(0)))
    return joined.withColumn("status", F.when(F.col("n_matches") == 0, "missing").when(F.col("n_matches") > 1, "ambiguous").otherwise("ok")).drop("_n")


def unknown_keys(asked: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of asked that table does not have; null keys are unknown."""
    return asked.select(*keys).distinct().join(table.select(*keys), keys, "left_anti")


def first_match(asked: DataFrame, table: DataFrame, keys: list[str], order: list[str], columns: list[str], last: bool = False) -> DataFrame:
    """asked with columns of the first (or last) row of each key in the order given, null
    without a match. One row a key is chosen by an aggregate, before the join."""
    pick = F.max_by if last else F.min_by
    one = table.groupBy(*keys).agg(pick(F.struct(*columns), F.struct(*order)).alias("_m"))
    return asked.join(one, keys, "left").select(*asked.columns, *[F.col(f"_m.{c}").alias(c) for c in columns])


def inventory_diff(expected: DataFrame, actual: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Keys that differ: missing (only expected), unexpected (only actual), changed
    (different content) or duplicate. No rows mean that the inventories are equal."""
    side = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(f"_n_{name}"), F.min(F.struct(*content)).alias(f"_c_{name}"))
    both = side(expected, "e").join(side(actual, "a"), keys, "full")
    kind = (
        F.when(F.col("_n_a").isNull(), "missing")
        .when(F.col("_n_e").isNull(), "unexpected")
        .when((F.col("_n_e") > 1) | (F.col("_n_a") > 1), "duplicate")
        .when(~F.col("_c_e").eqNullSafe(F.col("_c_a")), "changed")
    )
    return both.select(*keys, kind.alias("difference")).where("difference is not null")


def matrix_gaps(observed: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells of the full matrix rows x columns that were not observed once: cell keys,
    n_seen and status (missing, repeated, or foreign for one outside the matrix). rows and
    columns are dimensions: their product is the matrix that is asked for."""
    keys = [*rows.columns, *columns.columns]
    expected = rows.distinct().join(small(columns.distinct()), how="cross").withColumn("_due", F.lit(True))
    seen = observed.groupBy(*keys).agg(F.count("*").alias("n_seen"))
    both = expected.join(seen, keys, "full").withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))
    status = F.when(F.col("_due").isNull(), "foreign").when(F.col("n_seen") == 0, "missing").when(F.col("n_seen") > 1, "repeated")
    return both.select(*keys, "n_seen", status.alias("status")).where("status is not null")


def paired(runs: DataFrame, key: str, side: str, candidate: str, reference: str, ok: Column, equal: list[str], value: str) -> DataFrame:
    """One row a key: candidate and reference values, and the reason why the pair is omitted,
    null for a sound pair. runs has a row for each key and side; `equal` are columns in which
    the two must agree. Keys of neither side do not appear.
    """
    fields = F.struct(F.col(value).alias("v"), ok.alias("ok"), F.struct(*equal).alias("same"))
    own = runs.where(F.col(side).isin(candidate, reference)).groupBy(key)
    one = own.agg(
        *[F.count_if(F.col(side) == s).alias(f"_n{i}") for i, s in enumerate((candidate, reference))],
        *[F.max(F.when(F.col(side) == s, fields)).alias(f"_f{i}") for i, s in enumerate((candidate, reference))],
    )
    reason = (
        F.when((F.col("_n0") == 0) | (F.col("_n1") == 0), "missing side")
        .when((F.col("_n0") > 1) | (F.col("_n1") > 1), "ambiguous side")
        .when(~(F.coalesce("_f0.ok", F.lit(False)) & F.coalesce("_f1.ok", F.lit(False))), "failed run")
        .when(~F.col("_f0.same").eqNullSafe(F.col("_f1.same")), "different contract")
        .when(F.col("_f0.v").isNull() | F.col("_f1.v").isNull(), "not measurable")
    )
    return one.select(key, F.col("_f0.v").alias("candidate"), F.col("_f1.v").alias("reference"), reason.alias("omitted"))


def profile_pairs(profiles: DataFrame, id_col: str, target_col: str) -> DataFrame:
    """(reference, candidate) of profiles whose match target is another profile; a target that
    is not there gives no pair."""
    refs = profiles.select(F.col(id_col).alias("reference"), F.col(target_col).alias("candidate"))
    return refs.join(profiles.select(F.col(id_col).alias("candidate")), "candidate").where("reference <> candidate").select("reference", "candidate")


def suffix_pairs(rows: DataFrame, keys: list[str], name: str, suffix: str, value: str) -> DataFrame:
    """Pairs of a row named x + suffix with the row named x of the same keys."""
    long = rows.where(F.col(name).endswith(suffix)).withColumn("_base", F.expr(f"substring(`{name}`, 1, length(`{name}`) - {len(suffix)})"))
    left = long.select(*keys, F.col(name).alias("derived"), F.col("_base").alias("base"), F.col(value).alias("derived_value"))
    return left.join(rows.select(*keys, F.col(name).alias("base"), F.col(value).alias("base_value")), [*keys, "base"])


def nearest_centres(points: DataFrame, id_col: str, vector_col: str, centres: list[list[float]]) -> DataFrame:
    """The index and squared distance of the nearest of some literal centres, ties to the
    lowest index. A null vector has none."""
    v = F.col(vector_col)

    def squared(i: int, c: list[float]) -> Column:
        d = F.aggregate(F.zip_with(v, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x.cast("double"))
        return F.struct(d.alias("d"), F.lit(i).alias("centre"))

    best = F.array_min(F.array(*[squared(i, c) for i, c in enumerate(centres)]))
    return points.select(id_col, F.when(v.isNotNull(), best).alias("_b")).select(id_col, F.col("_b.centre").alias("centre"), F.col("_b.d").alias("distance_squared"))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Rows of left and right with equal keys whose half-open spans overlap, with the overlap
    (overlap_start, overlap_end). Spans are dealt into cells of `width`, so the join is an
    equi-join; a pair is kept in the first cell that both reach. Empty spans overlap nothing.
    """
    (ls, le), (rs, re) = left_span, right_span
    cells = lambda df, s, e, name: df.where(F.col(s) < F.col(e)).withColumn(name, F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))
    a, b = cells(left, ls, le, "_cell"), cells(right, rs, re, "_cell")
    start, end = F.greatest(ls, rs), F.least(le, re)
    joined = a.join(b, [*keys, "_cell"]).where((start < end) & (F.floor(start / width) == F.col("_cell")))
    return joined.withColumn("overlap_start", start).withColumn("overlap_end", end).drop("_cell")


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old patched with new: columns of new win where they are not null, new keys are added."""
    both = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in columns]).join(new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns]), keys, "full")
    return both.select(*keys, *[F.coalesce(f"_new_{c}", f"_old_{c}").alias(c) for c in columns])


def first_seen(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Distinct keys with the place of their first appearance, to order by."""
    return df.groupBy(*keys).agg(F.min(seq).alias("first_seen"))


def rotated_order(packets: DataFrame, order: str, reviewers: int) -> DataFrame:
    """A balanced order: reviewer r starts r packets later, so each packet comes at each place
    as often as the counts allow. packets is a dimension with a total order."""
    ranked = packets.select("*", (F.row_number().over(W.orderBy(order)) - 1).alias("_i"), F.count("*").over(W.partitionBy()).alias("_n"))
    each = ranked.withColumn("reviewer", F.explode(F.sequence(F.lit(0), F.lit(reviewers - 1))))
    return each.withColumn("place", F.pmod(F.col("_i") - F.col("reviewer"), F.col("_n")).cast("int")).drop("_i", "_n")
