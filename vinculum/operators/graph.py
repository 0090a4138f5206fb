"""Questions to the property graph of resolved edges: degrees, neighbours, case graph, bounded shortest path, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vinculum.operators.components import connected_components
from vinculum.session import materialise


def both_ways(edges: DataFrame, src: str = "src", tgt: str = "tgt", keep: list[str] | None = None) -> DataFrame:
    """(node, other, direction, keep...): every edge from each of its ends; edges without an end are left out."""
    keep = keep or []
    e = edges.filter(F.col(src).isNotNull() & F.col(tgt).isNotNull())
    out = e.select(F.col(src).alias("node"), F.col(tgt).alias("other"), F.lit("OUT").alias("direction"), *keep)
    return out.unionByName(e.select(F.col(tgt).alias("node"), F.col(src).alias("other"), F.lit("IN").alias("direction"), *keep))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): ends of edges at each node; a self-loop counts twice."""
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


def top_degrees(edges: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` nodes of highest degree, ties by node."""
    return degrees(edges).orderBy(F.col("degree").desc(), "node").limit(k)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (column node) without any edge."""
    return nodes.select("node").distinct().join(degrees(edges), "node", "left_anti")


def explain_isolated(nodes: DataFrame, accepted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node, accepted_degree, candidate_degree, reason) of nodes without accepted edge."""
    a, c = degrees(accepted).withColumnRenamed("degree", "accepted_degree"), degrees(candidates).withColumnRenamed("degree", "candidate_degree")
    rows = nodes.select("node").distinct().join(a, "node", "left").join(c, "node", "left").na.fill(0, ["accepted_degree", "candidate_degree"])
    return rows.filter("accepted_degree = 0").withColumn("reason", F.when(F.col("candidate_degree") > 0, "candidate_edges_rejected").otherwise("no_relationship_evidence"))


def neighbours(edges: DataFrame, seeds: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Edges that touch a seed (column node), seen from it."""
    return both_ways(edges, keep=keep).join(seeds.select("node").distinct(), "node", "left_semi")


def ring(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(node, hop): nodes within ``hops`` edges of the seeds with their least number of hops; seeds have 0."""
    e = both_ways(edges).select("node", "other").distinct()
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, hops + 1):
        new = front.join(e, "node").select(F.col("other").alias("node")).distinct().join(seen, "node", "left_anti")
        front = materialise(new.withColumn("hop", F.lit(h)))
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, sources: DataFrame, hops: int = 5) -> DataFrame:
    """(source, node, hops, path): from each source (column node) to each node within reach the path of fewest edges; of equal
    ones the one whose '|'-joined edge ids are smallest.

    Edges: src, tgt, edge_id, undirected. Level by level, each level keeps one row per source and node, so walks don't
    multiply. Integer ids are padded to 12 digits, which makes the choice independent of their number of digits.
    """
    if not 1 <= hops <= 5:
        raise ValueError("hops must be within 1 and 5")
    kind = edges.schema["edge_id"].dataType.simpleString()
    key = F.lpad(F.col("edge_id").cast("string"), 12, "0") if kind in ("bigint", "int") else F.col("edge_id")
    e = both_ways(edges.withColumn("_k", key), keep=["_k"]).groupBy("node", "other").agg(F.min("_k").alias("_k"))
    seen = sources.select(F.col("node").alias("source"), "node").distinct().withColumn("hops", F.lit(0)).withColumn("path", F.lit(""))
    front = seen
    for h in range(1, hops + 1):
        step = front.join(e, "node").select("source", F.col("other").alias("node"), F.concat("path", F.lit("|"), "_k").alias("path"))
        step = step.join(seen.select("source", "node"), ["source", "node"], "left_anti").groupBy("source", "node").agg(F.min("path").alias("path"))
        front = materialise(step.select("source", "node", F.lit(h).alias("hops"), "path"))
        seen = seen.unionByName(front)
    return seen


def case_graph(edges: DataFrame, case: str, cap: int = 200, center: str | None = None) -> DataFrame:
    """(edge_id, src, tgt, type, truncated) of a case, at most ``cap`` edges by id text, with a flag that more exist."""
    if isinstance(cap, bool) or not 1 <= cap <= 500:
        raise ValueError("cap must be within 1 and 500")
    e = edges.filter((F.col("case_id") == case) & F.col("src").isNotNull() & F.col("tgt").isNotNull())
    if center is not None:
        e = e.filter((F.col("src") == center) | (F.col("tgt") == center))
    rows = e.withColumn("_id", F.col("edge_id").cast("string")).orderBy("_id").limit(cap + 1)
    n = W.orderBy("_id")  # at most cap + 1 rows
    rows = rows.withColumn("_n", F.row_number().over(n)).withColumn("truncated", F.max("_n").over(W.partitionBy()) > cap)
    return rows.filter(F.col("_n") <= cap).select("edge_id", "src", "tgt", "type", "truncated")


def clusters(edges: DataFrame) -> DataFrame:
    """(root, size, hub, hub_degree) of each connected component; the hub is the node of highest degree, ties to the smallest."""
    of = connected_components(edges, "src", "tgt").join(degrees(edges), "node")
    best = F.min(F.struct((-F.col("degree")).alias("d"), F.col("node").alias("n"))).alias("m")
    return of.groupBy("root").agg(F.count("*").alias("size"), best).select("root", "size", F.col("m.n").alias("hub"), (-F.col("m.d")).alias("hub_degree"))
