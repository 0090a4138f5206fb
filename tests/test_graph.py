import random

import pytest

from vinculum.operators import graph as G
from vinculum.operators.components import connected_components

SCHEMA = "edge_id bigint, src string, tgt string, type string, case_id string"
E = [(1, "a", "b", "T", "X"), (2, "b", "c", "T", "X"), (3, "c", "d", "T", "X"), (10, "a", "c", "T", "X"), (4, "p", "q", "T", "Y"), (5, None, "a", "T", "X"), (6, "z", None, "T", "X")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(E, SCHEMA)


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_degrees_and_isolated(spark, edges):
    assert {(r.node, r.degree) for r in G.degrees(edges).collect()} == {("a", 2), ("b", 2), ("c", 3), ("d", 1), ("p", 1), ("q", 1)}
    assert [r.node for r in G.top_degrees(edges, 2).collect()] == ["c", "a"]
    assert [r.node for r in G.isolated(nodes(spark, "a", "x", "x"), edges).collect()] == ["x"]
    why = {(r.node, r.reason) for r in G.explain_isolated(nodes(spark, "a", "x", "p"), edges.filter("case_id = 'X'"), edges).collect()}
    assert why == {("x", "no_relationship_evidence"), ("p", "candidate_edges_rejected")}


def test_paths_prefer_fewest_hops_then_smallest_ids(spark, edges):
    got = {r.node: (r.hops, r.path) for r in G.shortest_paths(edges, nodes(spark, "a"), 3).collect()}
    assert got == {"a": (0, ""), "b": (1, "|000000000001"), "c": (1, "|000000000010"), "d": (2, "|000000000010|000000000003")}
    with pytest.raises(ValueError):
        G.shortest_paths(edges, nodes(spark, "a"), 6)


def test_paths_against_enumeration(spark):
    rng = random.Random(4)
    e = [(k, *rng.sample("abcdefgh", 2), "T", "X") for k in range(1, 14)]
    adj = {}
    for k, s, t, *_ in e:
        adj.setdefault(s, []).append((t, k))
        adj.setdefault(t, []).append((s, k))
    front = {("a", "")}
    seen = {"a": (0, "")}
    for h in range(1, 4):
        step = {}
        for node, path in front:
            for other, k in adj.get(node, []):
                p = f"{path}|{k:012d}"
                if other not in seen and (other not in step or p < step[other]):
                    step[other] = p
        front = set(step.items())
        seen |= {n: (h, p) for n, p in step.items()}
    got = {r.node: (r.hops, r.path) for r in G.shortest_paths(spark.createDataFrame(e, SCHEMA), nodes(spark, "a"), 3).collect()}
    assert got == seen


def test_rings_and_neighbours(spark, edges):
    assert {(r.node, r.hop) for r in G.ring(edges, nodes(spark, "d"), 2).collect()} == {("d", 0), ("c", 1), ("a", 2), ("b", 2)}
    assert {(r.other, r.direction) for r in G.neighbours(edges, nodes(spark, "c")).collect()} == {("b", "IN"), ("a", "IN"), ("d", "OUT")}


def test_case_graph(edges):
    rows = G.case_graph(edges, "X", 2).collect()
    assert [r.edge_id for r in rows] == [1, 10] and all(r.truncated for r in rows)
    assert [r.truncated for r in G.case_graph(edges, "Y", 5).collect()] == [False]
    assert {r.edge_id for r in G.case_graph(edges, "X", 5, "d").collect()} == {3}
    for cap in (0, 501, True):
        with pytest.raises(ValueError):
            G.case_graph(edges, "X", cap)


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(9)
    e = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200 + k, 200 + (k + 1) % 7) for k in range(7)] + [(5, 5), (300, None), (None, 301)]
    rng.shuffle(e)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(e + e, "a int, b int")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, **{k: 200 for k in range(200, 207)}}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_clusters(edges):
    assert {(r.root, r.size, r.hub, r.hub_degree) for r in G.clusters(edges).collect()} == {("a", 4, "c", 3), ("p", 2, "p", 1)}
