"""Reachability, components, cycles and quotients, as semi-naive DataFrame loops.

Each round joins only what the last one found, and is a scratch table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import materialise, release

#: Rounds after which the parts found so far are written together, so that plans stay small on long paths.
COMPACT = 12


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth): every node reachable from each start along parent -> child, with the least depth.

    starts(start, node) are at depth 0; several nodes may belong to one start. Cycles end as nothing is found twice.
    """
    steps = materialise(edges.select("parent_id", "child_id").where("parent_id <> child_id").distinct())
    found = [materialise(starts.select("start", "node").distinct().withColumn("depth", F.lit(0)))]
    frontier = found[0]
    depth = 0
    while True:
        depth += 1
        known = found[0]
        for part in found[1:]:
            known = known.union(part)
        near = frontier.join(steps, frontier["node"] == steps["parent_id"]).select("start", F.col("child_id").alias("node")).distinct()
        frontier = materialise(near.join(known.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            release(frontier)
            break
        found.append(frontier)
        if len(found) > COMPACT:
            whole = found[0]
            for part in found[1:-1]:
                whole = whole.union(part)
            whole = materialise(whole)
            for part in found[:-1]:
                release(part)
            found = [whole, frontier]
    return known


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child_id").alias("parent_id"), F.col("parent_id").alias("child_id"))


def _each(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("start"), F.col("node_id").alias("node"))


def descendants(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, descendant_id, depth) of each of nodes(node_id), itself at depth 0."""
    return reach(edges, _each(nodes)).select(F.col("start").alias("node_id"), F.col("node").alias("descendant_id"), "depth")


def ancestors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, depth), itself at depth 0."""
    return reach(flipped(edges), _each(nodes)).select(F.col("start").alias("node_id"), F.col("node").alias("ancestor_id"), "depth")


def ancestors_of_set(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node_id of the seeds and all their ancestors."""
    return reach(flipped(edges), seeds.select(F.lit(0).alias("start"), F.col("node_id").alias("node"))).select(F.col("node").alias("node_id"))


def root_ancestors(edges: DataFrame, seeds: DataFrame, roots: DataFrame) -> DataFrame:
    """node_id of those ancestors of the seeds that are roots."""
    return ancestors_of_set(edges, seeds).join(roots.select("node_id"), "node_id", "left_semi")


def within_clusters(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster_id, parent_id, child_id): edges whose two ends are in one cluster."""
    p = assignment.select(F.col("node_id").alias("parent_id"), "cluster_id")
    c = assignment.select(F.col("node_id").alias("child_id"), "cluster_id")
    return edges.join(p, "parent_id").join(c, ["child_id", "cluster_id"]).select("cluster_id", "parent_id", "child_id")


#: Tables up to so many rows are joined without a look at their keys: one task can read them.
SMALL = 1024


def frequent_keys(rows: DataFrame, key: str, n: int, changed: Column | None = None) -> tuple[list, int]:
    """Keys that more than a 4P-th of the n rows share (P shuffle partitions), at most 4P; how many rows are changed."""
    least = max(n // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), SMALL // 4)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lit(False) if changed is None else changed).alias("changed"))
    found = counts.agg(F.collect_list(F.when(F.col("n") > least, F.col(key))).alias("keys"), F.sum("changed").alias("changed")).first()
    return (found["keys"] if n > SMALL else []), found["changed"] or 0


def looked_up(rows: DataFrame, values: DataFrame, key: str, frequent: list) -> DataFrame:
    """rows left-joined with values (one row a key at most) on key, however many rows share a key.

    The values of the frequent keys are broadcast, a row each; rows of other keys are shuffled.
    """
    if not frequent:
        return rows.join(values, key, "left")
    hot = F.coalesce(F.col(key).isin(frequent), F.lit(False))
    return rows.where(hot).join(F.broadcast(values.where(hot)), key, "left").unionByName(rows.where(~hot).join(values.where(~hot), key, "left"))


def components(edges: DataFrame) -> DataFrame:
    """(node_id, component_id) of the nodes of edges: the smallest node of the weakly connected component.

    Min-label propagation with pointer jumping. Minima are combined before the shuffle, and the labels of hubs and of
    large components reach their many rows by broadcast (looked_up), so neither is a hot group.
    """
    plain = edges.where("parent_id is not null and child_id is not null")
    both = materialise(plain.select("parent_id", "child_id").union(plain.select("child_id", "parent_id")).distinct())
    labels = materialise(both.groupBy(F.col("parent_id").alias("node_id")).agg(F.min("child_id").alias("m")).select("node_id", F.least("node_id", "m").alias("component_id")))
    hubs, n = frequent_keys(both, "child_id", both.count())[0], labels.count()
    frequent = frequent_keys(labels, "component_id", n)[0]
    while True:
        near = looked_up(both, labels.select(F.col("node_id").alias("child_id"), "component_id"), "child_id", hubs).groupBy(F.col("parent_id").alias("node_id")).agg(F.min("component_id").alias("near"))
        jump = labels.select(F.col("node_id").alias("component_id"), F.col("component_id").alias("up"))
        jumped = looked_up(labels.select("node_id", "component_id"), jump, "component_id", frequent).join(near, "node_id")
        following = materialise(jumped.select("node_id", F.col("component_id").alias("was"), F.least("component_id", F.coalesce("up", "component_id"), "near").alias("component_id")))
        release(labels)
        labels = following
        frequent, changed = frequent_keys(labels, "component_id", n, F.col("was") != F.col("component_id"))
        if not changed:
            break
    release(both)
    return labels.select("node_id", "component_id")


def node_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of all nodes; a node without edges is its own."""
    return nodes.select("node_id").join(components(edges), "node_id", "left").select("node_id", F.coalesce("component_id", "node_id").alias("component_id"))


def connected(edges: DataFrame, node) -> DataFrame:
    """node_id of everything connected with one node, either way."""
    found = components(edges).alias("a")
    own = components(edges).where(F.col("node_id") == node).select("component_id").alias("b")
    return found.join(own, "component_id", "left_semi").select("node_id")


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(start, path): simple closed walks along child -> parent, once for each start; path starts with start.

    Paths grow with the graph's cycle count, which is exponential in general: `longest` bounds their nodes.
    """
    up = materialise(flipped(edges).where("parent_id <> child_id").distinct())
    paths = up.select(F.col("parent_id").alias("start"), F.array("parent_id").alias("path"), F.col("parent_id").alias("last")).distinct()
    out = None
    length = 1
    while True:
        stepped = materialise(paths.join(up, paths["last"] == up["parent_id"]).select("start", "path", "child_id"))
        closed = stepped.where("child_id = start").select("start", "path")
        out = closed if out is None else out.union(closed)
        length += 1
        paths = stepped.where(~F.array_contains("path", F.col("child_id"))).select("start", F.concat("path", F.array("child_id")).alias("path"), F.col("child_id").alias("last"))
        if longest is not None and length > longest or paths.isEmpty():
            return out


def quotient(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster_id, parent_cluster_id): parents of clusters, without themselves; nodes outside all clusters don't count."""
    p = assignment.select(F.col("node_id").alias("parent_id"), F.col("cluster_id").alias("parent_cluster_id"))
    c = assignment.select(F.col("node_id").alias("child_id"), "cluster_id")
    return edges.join(c, "child_id").join(p, "parent_id").where("cluster_id <> parent_cluster_id").select("cluster_id", "parent_cluster_id").distinct()


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges (parent_id, child_id) left after peeling nodes without parents again and again: empty without a cycle."""
    left = materialise(edges.select("parent_id", "child_id").distinct())
    n = left.count()
    while n:
        following = materialise(left.join(left.select(F.col("child_id").alias("parent_id")).distinct(), "parent_id", "left_semi"))
        release(left)
        left, before, n = following, n, following.count()
        if n == before:
            break
    return left


def is_cyclic(edges: DataFrame) -> bool:
    return not cyclic_core(edges).isEmpty()


def clusters_are_cyclic(edges: DataFrame, assignment: DataFrame) -> bool:
    return is_cyclic(quotient(edges, assignment).select(F.col("parent_cluster_id").alias("parent_id"), F.col("cluster_id").alias("child_id")))


def node_level_ancestors(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster_id, ancestor_id): clusters that hold an ancestor of one of a cluster's nodes."""
    up = reach(flipped(edges), assignment.select(F.col("cluster_id").alias("start"), F.col("node_id").alias("node")))
    held = assignment.select(F.col("node_id").alias("node"), F.col("cluster_id").alias("ancestor_id"))
    return up.join(held, "node").where("start <> ancestor_id").select(F.col("start").alias("cluster_id"), "ancestor_id").distinct()


def quotient_ancestors(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster_id, ancestor_id): clusters reachable over cluster parents, without the own one."""
    up = quotient(edges, assignment).select(F.col("cluster_id").alias("parent_id"), F.col("parent_cluster_id").alias("child_id"))
    starts = assignment.select(F.col("cluster_id").alias("start"), F.col("cluster_id").alias("node")).distinct()
    return reach(up, starts).where("depth > 0 and start <> node").select(F.col("start").alias("cluster_id"), F.col("node").alias("ancestor_id"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without parents."""
    return nodes.join(edges.select(F.col("child_id").alias("node_id")), "node_id", "left_anti")


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, depth): least number of steps from a root; nodes that no root reaches are left out."""
    top = roots(nodes, edges).select(F.lit(0).alias("start"), F.col("node_id").alias("node"))
    return reach(edges, top).select(F.col("node").alias("node_id"), "depth")
