import random

import pytest

from tessera.functions.tokens import words
from tessera.operators import closure, info
from tessera.plans import evaluate
from tessera.plans import queries_information as Q
from tessera.plans.search import infer, merge_gains, split_gains
from tests import graphs as G

GROUPS = {
    "g1": [G.VEE_NODES], "g2": [["n1", "n2", "n3"], ["b1", "b2", "b3"], ["root"]], "g3": [["n1"], ["n2"], ["n3"], ["b1", "b2", "b3"], ["root"]], "g4": [[n] for n in G.VEE_NODES],
    "spurious": [["n1", "n2"], ["n3"], ["b1", "b2", "b3"], ["root"]], "pairs": [["n1", "b1"], ["n2", "b2"], ["n3", "b3"], ["root"]],
}
ONE = {"g1": 1.0042424730540764, "g2": 0.0, "g3": 0.47083383800061834, "g4": 0.9416676760012367}
TWO = {"g1": 1.5047882836811908, "g2": 0.433458970588865, "spurious": 0.7256677897775445, "pairs": 1.7394644853140915, "g4": 1.0948598866956885}


@pytest.mark.parametrize(("names", "expected"), [(G.ONE_TOKEN, ONE), (G.TWO_TOKENS, TWO)])
def test_variation_of_groupings(spark, names, expected):
    tokens = G.tokens(spark, names)
    found = {g: info.variation(G.assignment(spark, GROUPS[g]), tokens).first()["vi"] for g in expected}
    assert found == pytest.approx(expected, abs=1e-12)
    assert all(found["g2"] < v for g, v in found.items() if g != "g2")


@pytest.mark.parametrize("alpha", [0.0, 2.0, 10.0])
def test_variation_with_prior_matches_the_definition(spark, alpha):
    rng = random.Random(5)
    ids = [f"v{i}" for i in range(9)]
    pairs = [(ids[i], ids[j]) for i in range(9) for j in range(i + 1, 9) if rng.random() < 0.3]
    names = {n: [rng.choice("abcd") for _ in range(rng.randrange(3))] for n in ids}
    clusters = [ids[:4], ids[4:6], ids[6:]]
    found = info.variation(G.assignment(spark, clusters), G.tokens(spark, names), G.edges(spark, pairs), alpha).first()["vi"]
    assert found == pytest.approx(G.variation(clusters, names, pairs, alpha), abs=1e-9)


@pytest.mark.parametrize(("names", "alpha", "start", "end"), [(G.ONE_TOKEN, 0.0, 1.004242, 0.0), (G.TWO_TOKENS, 2.0, 1.504788, 0.601271)])
def test_search(spark, names, alpha, start, end):
    edges, tokens = G.edges(spark, G.VEE), G.tokens(spark, names)
    found, gain = infer(G.nodes(spark, G.VEE_NODES), edges, tokens, alpha)
    clusters = {}
    for r in found.collect():
        clusters.setdefault(r["cluster_id"], set()).add(r["node_id"])
    assert sorted(map(sorted, clusters.values())) == [["b1", "b2", "b3"], ["n1", "n2", "n3"], ["root"]]
    assert gain == pytest.approx(start - end, abs=2e-6)
    assert not closure.clusters_are_cyclic(edges, found)


@pytest.mark.parametrize(("seed", "alpha"), [(2, 2.0)])
def test_search_on_random_graphs(spark, seed, alpha):
    """Gains add up to the difference of the objective, the quotient has no cycle, and no further merge or split gains."""
    rng = random.Random(seed)
    ids = [f"v{i:02d}" for i in range(10)]
    pairs = [(ids[i], ids[j]) for i in range(10) for j in range(i + 1, 10) if rng.random() < 0.2]
    names = {n: [rng.choice("abcd") for _ in range(rng.randrange(1, 3))] for n in ids}
    edges, tokens = G.edges(spark, pairs), G.tokens(spark, names)
    found, gain = infer(G.nodes(spark, ids), edges, tokens, alpha)
    clusters = {}
    for r in found.collect():
        clusters.setdefault(r["cluster_id"], []).append(r["node_id"])
    start = {}
    for r in closure.node_components(G.nodes(spark, ids), edges).collect():
        start.setdefault(r["component_id"], []).append(r["node_id"])
    assert sorted(n for c in clusters.values() for n in c) == ids and all(k == min(c) for k, c in clusters.items())
    assert gain == pytest.approx(G.variation(list(start.values()), names, pairs, alpha) - G.variation(list(clusters.values()), names, pairs, alpha), abs=1e-9)
    assert not closure.clusters_are_cyclic(edges, found)
    objective = info.VariationOfInformation(tokens, edges, alpha)
    parts = objective.parts(found)
    assert split_gains(found, edges, objective, parts).where("gain > 1e-9").isEmpty()
    assert merge_gains(found, edges, objective, parts).where("gain > 1e-9").isEmpty()


def test_batched_split_gains_equal_differences(spark):
    rng = random.Random(3)
    ids = [f"v{i}" for i in range(8)]
    pairs = [(ids[i], ids[j]) for i in range(8) for j in range(i + 1, 8) if rng.random() < 0.35] + [(ids[0], i) for i in ids[1:]]
    names = {n: [rng.choice("abc") for _ in range(rng.randrange(3))] for n in ids}
    state, edges, tokens = G.assignment(spark, [ids]), G.edges(spark, pairs), G.tokens(spark, names)
    for alpha in (0.0, 2.0):
        objective = info.VariationOfInformation(tokens, edges, alpha)
        for r in split_gains(state, edges, objective, objective.parts(state)).collect():
            side, todo = set(), [r["pivot"]]
            while todo:
                x = todo.pop()
                side.add(x)
                todo += [c for p, c in pairs if p == x and c not in side]
            rest = [i for i in ids if i not in side]
            expected = G.variation([ids], names, pairs, alpha) - G.variation([rest, sorted(side)], names, pairs, alpha)
            assert r["gain"] == pytest.approx(expected, abs=1e-9)


def test_runs_side_by_side_equal_runs_alone(spark):
    """Same ids in each run, roots that could merge across runs, runs that end after unequal numbers of steps."""
    every_node, every_edge, alone, scores = [], [], set(), set()
    options = evaluate.Options(alpha=0.0, tokenizer=words)
    for run in (1, 4, 6):
        rng = random.Random(run)
        ids = [f"v{i}" for i in range(4 + run % 5)]
        pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if rng.random() < 0.3] or [(ids[0], ids[1])]
        rows = [(n, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 3))), rng.choice("xy"), "variable") for n in ids]
        schema = "node_id string, name string, type string, kind string"
        found, scored = evaluate.cluster_and_score(spark.createDataFrame(rows, schema), G.edges(spark, pairs), options)
        alone |= {(run, r["cluster_id"], r["node_id"]) for r in found.collect()}
        scores |= {(run, r["cluster_id"], r["size"], round(r["purity"], 9), repr(round(r["silhouette"], 9))) for r in scored.collect()}
        every_node += [(run, *r) for r in rows]
        every_edge += [(run, *p) for p in pairs]
    nodes = spark.createDataFrame(every_node, f"run long, {schema}")
    found, scored = evaluate.cluster_and_score_runs(nodes, spark.createDataFrame(every_edge, "run long, parent_id string, child_id string"), options)
    assert {tuple(r) for r in found.select("run", "cluster_id", "node_id").collect()} == alone
    assert {(r["run"], r["cluster_id"], r["size"], round(r["purity"], 9), repr(round(r["silhouette"], 9))) for r in scored.collect()} == scores


def test_smoothed_parts_of_runs_equal_parts_alone(spark):
    names, pairs = {"a": ["x", "y"], "b": ["x"], "c": ["y", "z"], "d": ["z"]}, [("a", "b"), ("a", "c"), ("c", "d")]
    other = {"e": ["x"], "f": ["x", "z"], "g": ["w"]}
    alone = {}
    for n, p, groups in ((names, pairs, [["a", "b"], ["c", "d"]]), (other, [("e", "f")], [["e"], ["f", "g"]])):
        state = G.assignment(spark, groups).selectExpr("cluster_id + %d cluster_id" % len(alone), "node_id")
        alone |= {r["cluster_id"]: r["part"] for r in info.VariationOfInformation(G.tokens(spark, n), G.edges(spark, p), 2.0).parts(state).collect()}
    tokens = G.tokens(spark, names | other).selectExpr("*", "if(node_id < 'e', 'one', 'two') run")
    state = G.assignment(spark, [["a", "b"], ["c", "d"], ["e"], ["f", "g"]])
    both = info.VariationOfInformation(tokens, G.edges(spark, pairs + [("e", "f")]), 2.0).parts(state).collect()
    assert {r["cluster_id"]: r["part"] for r in both} == pytest.approx(alone, abs=1e-12)


def test_runs_by_hierarchy_and_type(spark, small_tree):
    found = Q.per_hierarchy(spark, small_tree).collect()
    assert {r["run"] for r in found} == {"r0", "r1"} and sum(r["size"] for r in found) == 7
    types = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "node_id int, name string")
    sets = evaluate.descendant_types(types, spark.createDataFrame([(1, 2), (2, 3)], "parent_id int, child_id int"), 1)
    assert {tuple(r) for r in sets.collect()} == {(2, "b"), (2, "c")}
    nodes = spark.createDataFrame([(i, f"n{i}", "t", "variable", "f", i, i) for i in range(6)], "node_id long, name string, type string, kind string, file string, line long, end_line long")
    spans = spark.createDataFrame([("p", "f", 0, 2), ("q", "f", 2, 3), ("empty", "f", 9, 9)], "type_id string, file string, start_line long, end_line long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "parent_id long, child_id long")
    state, _ = evaluate.per_type(nodes, edges, spans, evaluate.Options(alpha=0.0, tokenizer=words))
    assert sorted((r["run"], r["node_id"]) for r in state.collect()) == [("p", 0), ("p", 1), ("p", 2), ("q", 2), ("q", 3)]


def test_empty_tables(spark):
    tokens = G.tokens(spark, G.ONE_TOKEN).where("false")
    found = info.variation(G.assignment(spark, [["a"]]), tokens).first()
    assert found["vi"] == 0.0


@pytest.fixture(scope="module")
def small_tree(spark, tmp_path_factory):
    """Two regions of one nation each, with two customers and a supplier."""
    path = str(tmp_path_factory.mktemp("tree"))
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "east"), (1, "west")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "x_a", 0), (1, "y_b", 1)]),
        "customer": ("c_custkey int, c_name string, c_nationkey int", [(1, "buyer_a", 0), (2, "buyer_b", 1)]),
        "supplier": ("s_suppkey int, s_name string, s_nationkey int", [(1, "seller_a", 0)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def test_queries_take_all_nodes(spark, small_tree):
    found = {r["node_id"] for r in Q.infer_coloring(spark, small_tree).collect()}
    assert found == {"r0", "r1", "n0", "n1", "c1", "c2", "s1"}
    pairs = {frozenset((r["c1"], r["c2"])) for r in Q.merge_gains_query(spark, small_tree).collect()}
    assert {frozenset(p) for p in (("c1", "n0"), ("s1", "n0"), ("c1", "s1"), ("c2", "n1"))} <= pairs


def test_split_gains_take_all_pivots(spark, small_tree):
    assert {r["pivot"] for r in Q.split_gains_query(spark, small_tree).collect()} == {"n0", "n1", "c1", "c2", "s1"}
