import random

import pytest

from tessera.operators import graphs, info, moves
from tessera.plans import search
from tests import graphs as G
from tests.joins import most_shuffled


def _random(spark, seed):
    """A graph of clusters with names of repeated, shared and no tokens."""
    rng = random.Random(seed)
    ids = [f"v{i:02d}" for i in range(16)]
    pairs = [(ids[i], ids[j]) for i in range(16) for j in range(16) if i != j and rng.random() < 0.05]
    names = {n: [rng.choice("abcdef") for _ in range(rng.randrange(4))] for n in ids}
    clusters = {}
    for n in ids:
        clusters.setdefault(rng.randrange(11), []).append(n)
    rows = [(min(c), n) for c in clusters.values() for n in c]
    return rows, pairs, names, spark.createDataFrame(rows, "cluster_id string, node_id string"), G.edges(spark, pairs), G.tokens(spark, names)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("wide", [64, 2])
def test_merge_gains_are_differences_of_the_objective(spark, monkeypatch, seed, wide):
    """With counts carried along, and with those of wide clusters joined."""
    monkeypatch.setattr(search, "WIDE", wide)
    monkeypatch.setattr(moves, "BLOCK", 2)
    rows, pairs, names, state, edges, tokens = _random(spark, seed)
    objective = info.VariationOfInformation(tokens, edges, 0.0)
    found = search.merge_gains(state, edges, objective, objective.parts(state)).collect()
    expected = {tuple(sorted((r["c1"], r["c2"]))) for r in moves.merges(state, edges).collect()}
    assert expected and len(found) == len(expected) and {(r["c1"], r["c2"]) for r in found} == expected
    groups = {c: [n for k, n in rows if k == c] for c, _ in rows}
    start = G.variation(list(groups.values()), names)
    for r in found:
        after = [g for c, g in groups.items() if c not in (r["c1"], r["c2"])] + [groups[r["c1"]] + groups[r["c2"]]]
        assert r["gain"] == pytest.approx(start - G.variation(after, names), abs=1e-9)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sibling_merges_by_the_definition(spark, monkeypatch, seed):
    monkeypatch.setattr(moves, "BLOCK", 2)
    rows, pairs, _, state, edges, _ = _random(spark, seed)
    of = {n: c for c, n in rows}
    tops = {(r["cluster_id"], r["node_id"]) for r in graphs.entry_nodes(state, edges).collect()}
    parents = {c: {of[p] for p, k in pairs if (c, k) in tops} for c in of.values()}
    expected = []
    for a in parents:
        for b in parents:
            rest = (parents[a] | parents[b]) - {a, b}
            if a > b and all(1 <= len(parents[c]) <= 3 for c in (a, b)) and (len(rest) == 1 or not rest and len(parents) > 2):
                near = parents[a] & parents[b] or a in parents[b] or b in parents[a]
                expected += [(a, b, min(rest, default=None))] if near else []
    found = [(r["c1"], r["c2"], r["via"]) for r in moves.merges(state, edges).where("kind = 'sibling'").collect()]
    assert expected and sorted(found, key=str) == sorted(expected, key=str)


def test_pairs_of_siblings_are_not_shuffled(spark):
    """1,200 children of one parent have 719,400 pairs, but no shuffle has as many rows."""
    rows = [("p", f"c{i}") for i in range(1200)]
    state = spark.createDataFrame([("p", "p")] + [(c, c) for _, c in rows], "cluster_id string, node_id string")
    tokens = spark.createDataFrame([(n, 0, "same") for _, n in rows] + [("p", 0, "top")], "node_id string, pos int, token string")
    edges = G.edges(spark, rows)
    objective = info.VariationOfInformation(tokens, edges, 0.0)
    gains = search.merge_gains(state, edges, objective, objective.parts(state)).where("gain > 0.5")
    assert 0 < most_shuffled(gains) < 20_000
    assert search.merge_gains(state, edges, objective, objective.parts(state)).count() == 1200 * 1199 // 2 + 1200


@pytest.mark.parametrize("few", [0, 256])
@pytest.mark.parametrize("wide", [64, 2])
def test_gains_of_few_clusters_are_those_of_many(spark, monkeypatch, few, wide):
    """Listed and joined, and met in tiles."""
    monkeypatch.setattr(search, "FEW", few)
    monkeypatch.setattr(search, "WIDE", wide)
    rows, _, names, state, edges, tokens = _random(spark, 1)
    groups = {c: [n for k, n in rows if k == c] for c, _ in rows}
    start = G.variation(list(groups.values()), names)
    found = search.merge_gains(state, edges, info.VariationOfInformation(tokens, edges, 0.0), None).collect()
    assert {tuple(sorted((r["c1"], r["c2"]))) for r in found} == {tuple(sorted((r["c1"], r["c2"]))) for r in moves.merges(state, edges).collect()}
    for r in found:
        after = [g for c, g in groups.items() if c not in (r["c1"], r["c2"])] + [groups[r["c1"]] + groups[r["c2"]]]
        assert r["gain"] == pytest.approx(start - G.variation(after, names), abs=1e-9)


def test_one_cluster_has_no_merges(spark, monkeypatch):
    """No pairs are looked for."""
    monkeypatch.setattr(moves, "candidates", None)
    state = spark.createDataFrame([("a", "a"), ("a", "b")], "cluster_id string, node_id string")
    tokens = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], "node_id string, pos int, token string")
    edges = G.edges(spark, [("a", "b")])
    assert search.merge_gains(state, edges, info.VariationOfInformation(tokens, edges, 0.0), None).isEmpty()
