"""Weighted k-means: deterministic seeds, Lloyd steps as distributed aggregations."""

from pyspark.sql import Column, DataFrame, functions as F

#: Most Lloyd steps, and the squared movement of all centres at which they end.
STEPS, STILL = 24, 1e-14


def _distance(v: Column, c: list[float]) -> Column:
    return F.aggregate(F.zip_with(v, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def weighted_kmeans(points: DataFrame, k: int, fixed: list[list[float]] | None = None) -> list[list[float]]:
    """points: id, v (array of double), w. Centres after at most STEPS steps.

    Seeds: the mean's nearest point of those of greatest weight comes first as the heaviest
    point, then always the point with the greatest weight times squared distance to its
    nearest centre; ties to the lowest id. `fixed` centres come first and never move. A centre
    without points keeps its place. Only centres (k rows) and sums come to the driver.
    """
    points = points.where("v is not null and w > 0").persist()
    centres = [list(c) for c in fixed or []]
    anchored = len(centres)
    if not centres:
        top = points.agg(F.max_by("v", F.struct("w", -F.col("id"))).alias("v")).first().v
        if top is None:
            return []
        centres.append(list(top))
    while len(centres) < k:
        gap = F.least(*[_distance(F.col("v"), c) for c in centres], F.lit(float("inf")))
        row = points.agg(F.max_by(F.struct("v", (F.col("w") * gap).alias("far")), F.struct((F.col("w") * gap).alias("far"), -F.col("id"))).alias("m")).first().m
        if row.far <= 0:
            break
        centres.append(list(row.v))
    size = len(centres[0])
    for _ in range(STEPS):
        nearest = F.array_min(F.array(*[F.struct(_distance(F.col("v"), c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centres)]))["c"]
        sums = points.groupBy(nearest.alias("c")).agg(F.sum("w").alias("w"), *[F.sum(F.get("v", F.lit(j)) * F.col("w")).alias(f"s{j}") for j in range(size)]).collect()
        moved = 0.0
        for r in sums:
            if r.c >= anchored:
                new = [r[f"s{j}"] / r.w for j in range(size)]
                moved += sum((a - b) ** 2 for a, b in zip(new, centres[r.c], strict=True))
                centres[r.c] = new
        if moved <= STILL:
            break
    points.unpersist()
    return centres
