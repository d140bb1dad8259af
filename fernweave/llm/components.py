"""Connected components of a link table, without collecting links or labels anywhere."""

from pyspark.sql import DataFrame, functions as F

from fernweave.llm.store import released, stored


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: columns a, b of one orderable type. Returns (node, root), root the smallest
    node that can be reached, for every node of a link; self links give (node, node).

    Alternates large-star and small-star rounds: in the first every node hands its larger
    neighbours to its smallest one, in the second its smaller ones. Each round keeps the
    components and never adds links; they end as stars around the smallest node. Null
    ends are left out, repeated links count once, no links give no rows. The links are
    stored first, so what makes them runs once.
    """
    both = stored(links.where("a is not null and b is not null"), f"{name}-given")
    own = both.where("a = b").select("a").distinct()
    edges = stored(both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h")).first()
        if state.n == 0 or state == before:
            break
        before = state
        around = edges.select("a", "b").union(edges.select("b", "a"))
        small = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(small, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small, "a")
        last, edges = edges, stored(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m")).where("a <> b").distinct(), name)
        released(last)
    roots = edges.select(F.col("b").alias("node")).union(own.select("a")).distinct().join(edges.select(F.col("a").alias("node")), "node", "left_anti")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
