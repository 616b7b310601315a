import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import closure, graphs, moves, validate
from tests import graphs as G


def _set(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def _roots(spark, clusters):
    return G.assignment(spark, [c or ["none"] for c in clusters]).where("node_id <> 'none'") if isinstance(clusters[0][0], str) else G.assignment(spark, clusters)


@pytest.mark.parametrize(("clusters", "roots", "valid"), [
    ([["n1", "n2", "n3"]], [["n1"]], True), ([["n1"], ["n2", "n3"]], [["n1"], ["n2"]], True), ([["n1", "n3"], ["n2"]], [["n1"], ["n2"]], False), ([["n1", "n2"], ["n3"]], [["n1"], ["n2"]], False),
    ([["n1", "n2"], ["n3"]], [["n2"], ["n1"]], False), ([["n1", "n2"], ["n3"]], [["n2"], ["n3"]], False), ([["n1", "n2"], ["n3"]], [["n1"], ["n1"]], False), ([["n1", "n2"], ["n3"]], [["n1"], []], False),
])
def test_validity_of_a_chain(spark, clusters, roots, valid):
    assert validate.is_valid(G.nodes(spark, ["n1", "n2", "n3"]), G.edges(spark, G.CHAIN), G.assignment(spark, clusters), _roots(spark, roots)) is valid


@pytest.mark.parametrize(("clusters", "roots", "valid"), [
    ([list(range(1, 11))], [[10]], True), ([list(range(1, 11))], [[1]], False), ([list(range(1, 11))], [[1, 7]], False), ([[1, 2, 3, 4, 5, 7, 10], [6, 8, 9]], [[10], [9, 6]], True),
    ([[6, 8, 9], [1, 2, 3, 4, 5, 7, 10]], [[9, 6], [10]], True), ([[1, 2, 3, 4, 5, 6, 7, 9, 10], [8]], [[10], [8]], True), ([[6, 8, 9], [1, 2, 3, 4, 5, 7, 9, 10]], [[9, 6], [10]], False),
    ([[1, 6, 8, 9], [2, 3, 4, 5, 7, 9, 10]], [[9, 6, 1], [10]], False), ([[2, 3], [1, 4, 5, 6, 7, 8, 9, 10]], [[2, 3], [10]], False), ([[3, 4, 5, 7, 10], [6, 9], [1, 2], [8]], [[10], [6, 9], [1, 2], [8]], True),
])
def test_validity_of_ten_nodes(spark, clusters, roots, valid):
    assert validate.is_valid(G.nodes(spark, list(range(1, 11))), G.edges(spark, G.TEN), G.assignment(spark, clusters), G.assignment(spark, roots)) is valid


@pytest.mark.parametrize(("pivot", "one", "roots"), [("b1", {"b1", "b2", "b3"}, {"root", "b1"}), ("b2", {"b2", "b3"}, {"root", "b2"}), ("n1", {"n1", "n2", "n3"}, {"root", "n1"}), ("n2", {"n2", "n3"}, {"root", "n2", "n3"})])
def test_splits(spark, pivot, one, roots):
    state, edges = G.assignment(spark, [G.VEE_NODES]), G.edges(spark, G.VEE)
    sides = moves.split_sides(moves.split_on(state, edges, G.nodes(spark, [pivot])), state)
    assert {n for (n, s) in _set(sides, "node_id", "side") if s} == one
    tops = moves.split_roots(sides, G.assignment(spark, [["root"]]), edges)
    assert {n for (n,) in _set(tops, "node_id")} == roots
    label = lambda df: df.select(F.col("side").cast("long").alias("cluster_id"), "node_id")
    assert validate.is_valid(G.nodes(spark, G.VEE_NODES), edges, label(sides), label(tops))


def test_split_that_would_cut_a_cycle_is_left_out(spark):
    # a -> x -> b in two clusters: {a, b} can't be split on a's side as x leads back
    edges = G.edges(spark, [("a", "x"), ("x", "b"), ("b", "c")])
    state = G.assignment(spark, [["a", "b", "c"], ["x"]])
    assert {p for (p,) in _set(moves.split_on(state, edges), "pivot")} == {"b", "c"}


def _reachable(pairs, start):
    seen, todo = set(), [start]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [c for p, c in pairs if p == x]
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_closures_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    ids = list(range(14))
    pairs = [(i, j) for i in ids for j in ids if i != j and rng.random() < 0.09]
    edges, nodes = G.edges(spark, pairs), G.nodes(spark, ids)
    assert _set(closure.descendants(edges, nodes), "node_id", "descendant_id") == {(i, j) for i in ids for j in _reachable(pairs, i)}
    both = pairs + [(b, a) for a, b in pairs]
    assert _set(closure.node_components(nodes, edges), "node_id", "component_id") == {(i, min(_reachable(both, i))) for i in ids}
    on_cycle = any(i in {x for _, c in [p for p in pairs if p[0] == i] for x in _reachable(pairs, c)} for i in ids)
    assert closure.is_cyclic(edges) is on_cycle


def test_long_chain(spark):
    pairs = [(i, i + 1) for i in range(15)]
    found = closure.depths(G.nodes(spark, list(range(16))), G.edges(spark, pairs))
    assert _set(found, "node_id", "depth") == {(i, i) for i in range(16)}


def test_cycles(spark):
    found = closure.cycles(G.edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]))
    assert {s for (s,) in _set(found, "start")} == {"a", "b", "c"} and found.count() == 3


def test_merges(spark):
    edges = G.edges(spark, [("r", "a"), ("r", "b"), ("a", "c")])
    state = spark.createDataFrame([(n, n) for n in "rabc"], "cluster_id string, node_id string")
    found = _set(moves.merges(state, edges), "kind", "c1", "c2")
    assert {x for x in found if x[0] == "parent"} == {("parent", "a", "r"), ("parent", "b", "r"), ("parent", "c", "a")}
    assert ("sibling", "b", "a") in found and not [x for x in found if x[0] == "root"]


def test_empty_graph(spark):
    none = G.edges(spark, [("a", "b")]).where("false")
    assert closure.components(none).count() == 0 and closure.cyclic_core(none).count() == 0
    assert _set(closure.node_components(G.nodes(spark, ["a"]), none), "node_id", "component_id") == {("a", "a")}
    assert graphs.entry_nodes(G.assignment(spark, [["a"]]), none).count() == 1
