"""Connected components of an edge table by distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.session import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): for each node of an edge the smallest node of its component.

    Edges are undirected; rows with a null end are ignored, repeated edges and self-loops are harmless, an empty table gives
    an empty one. Each round links every node to the smallest root among its neighbours' roots (the partial minimum is taken
    before the shuffle, so a hub costs no single task) and then jumps to the root's root. Nothing is collected but the count
    of changed labels; lineage is cut in the shared folder. Raises RuntimeError if ``rounds`` don't suffice.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    e = materialise(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = e.select(F.col("a").alias("node")).distinct()
    label = materialise(
        e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    )
    for _ in range(rounds):
        roots = label.select(F.col("node").alias("b"), F.col("root").alias("r"))
        # the smallest root that a neighbour has, for the node and for the node's own root
        near = e.join(roots, "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("m"))
        seen = label.join(near, "node").select("node", "root", F.least("root", "m").alias("m"))
        hook = seen.groupBy("root").agg(F.min("m").alias("h"))
        new = seen.join(hook, "root", "left").select("node", "root", F.least("m", "h").alias("new"))
        jump = label.select(F.col("node").alias("new"), F.col("root").alias("j"))
        new = new.join(jump, "new", "left").select("node", F.least("new", F.coalesce("j", "new")).alias("root"), (F.col("root") != F.least("new", F.coalesce("j", "new"))).alias("moved"))
        new = materialise(new)
        label = new.select("node", "root")
        if new.filter("moved").limit(1).count() == 0:
            return nodes.join(label, "node")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
