"""Hand-made graphs with their names, and a plain Python reference for entropies."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

VEE = [("n1", "n2"), ("n1", "n3"), ("n2", "n3"), ("b1", "b2"), ("b2", "b3"), ("root", "n1"), ("root", "b1")]
VEE_NODES = ["n1", "n2", "n3", "b1", "b2", "b3", "root"]
ONE_TOKEN = {n: [n[0] if n != "root" else "root"] for n in VEE_NODES}
TWO_TOKENS = ONE_TOKEN | {"n1": ["n", "yellow"], "n2": ["n", "red"], "n3": ["n", "yellow"]}
CHAIN = [("n1", "n2"), ("n2", "n3")]
TEN = [(10, 4), (10, 7), (10, 9), (7, 5), (7, 6), (6, 8), (6, 9), (5, 2), (4, 2), (4, 3), (3, 1), (2, 1)]


def nodes(spark, ids):
    kind = "long" if isinstance(ids[0], int) else "string"
    return spark.createDataFrame([(i,) for i in ids], f"node_id {kind}")


def edges(spark, pairs):
    kind = "long" if pairs and isinstance(pairs[0][0], int) else "string"
    return spark.createDataFrame(pairs, f"parent_id {kind}, child_id {kind}")


def tokens(spark, names):
    return spark.createDataFrame([(n, i, t) for n, ts in names.items() for i, t in enumerate(ts)], "node_id string, pos int, token string")


def assignment(spark, clusters):
    """clusters: list of lists; named 0, 1, ..."""
    kind = "long" if isinstance(clusters[0][0], int) else "string"
    return spark.createDataFrame([(k, n) for k, c in enumerate(clusters) for n in c], f"cluster_id long, node_id {kind}")


def variation(clusters, names, pairs=(), alpha=0.0):
    """Variation of information by the definition."""
    base = Counter(t for ts in names.values() for t in ts)
    size, effective = sum(base.values()), sum(bool(ts) for ts in names.values())
    parents = defaultdict(set)
    for p, c in pairs:
        parents[c].add(p)
    first = second = 0.0
    held = []
    for c in clusters:
        counts = Counter(t for n in c for t in names[n])
        held.append(counts)
        n = sum(counts.values())
        prior = {t: 0.001 * b / size for t, b in base.items()}
        depth, frontier, seen = 0, set(c), set(c)
        while alpha and frontier:
            depth += 1
            frontier = {p for x in frontier for p in parents[x]} - seen
            seen |= frontier
            for x in frontier:
                for t in names[x]:
                    prior[t] += 0.9**depth
        total = sum(prior.values())
        h = 0.0
        for t, k in counts.items():
            p = (k + alpha * prior[t] / total) / (n + alpha) if alpha else k / n
            h -= p * math.log(p)
        first += sum(bool(names[x]) for x in c) / effective * h
    for t, b in base.items():
        second += b / size * sum(-(k[t] / b) * math.log(k[t] / b) for k in held if k[t])
    return first + second
