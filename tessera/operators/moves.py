"""Candidate changes of a clustering: splits on a pivot, merges of two clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.closure import clusters_are_cyclic, reach, within_clusters
from tessera.operators.graphs import entry_nodes
from tessera.plans.scratch import materialise


def split_on(assignment: DataFrame, edges: DataFrame, pivots: DataFrame | None = None, acyclic: bool = False) -> DataFrame:
    """(cluster_id, pivot, node_id): the side that goes with each pivot, its descendants within the cluster.

    Left out are pivots whose other side would be empty, and those where a node of the side reaches the other side
    over other clusters (the halves would be parents of each other); that needs a cyclic quotient, so the
    global closure runs only then, and a caller that knows its quotient to be acyclic says so.
    """
    own = assignment.select("cluster_id", "node_id")
    inner = within_clusters(edges, own).select("parent_id", "child_id")
    starts = own if pivots is None else own.join(pivots.select("node_id"), "node_id", "left_semi")
    side = reach(inner, starts.select(F.col("node_id").alias("start"), F.col("node_id").alias("node")))
    taken = materialise(side.join(own.select(F.col("node_id").alias("node"), "cluster_id"), "node").select("cluster_id", F.col("start").alias("pivot"), F.col("node").alias("node_id")))
    sizes = own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("whole"))
    proper = taken.groupBy("cluster_id", "pivot").agg(F.count(F.lit(1)).alias("n")).join(sizes, "cluster_id").where("n < whole").select("cluster_id", "pivot")
    if not acyclic and clusters_are_cyclic(edges, own):
        far = reach(edges, own.select(F.col("node_id").alias("start"), F.col("node_id").alias("node"))).where("depth > 0")
        held = own.select(F.col("node_id").alias("node"), F.col("cluster_id").alias("c2"))
        hits = taken.join(far.withColumnRenamed("start", "node_id"), "node_id").join(held, "node").where("cluster_id = c2").select("cluster_id", "pivot", "node").distinct()
        bad = hits.join(taken.withColumnRenamed("node_id", "node"), ["cluster_id", "pivot", "node"], "left_anti").select("cluster_id", "pivot").distinct()
        proper = proper.join(bad, ["cluster_id", "pivot"], "left_anti")
    return taken.join(proper, ["cluster_id", "pivot"], "left_semi")


def split_sides(sides: DataFrame, assignment: DataFrame) -> DataFrame:
    """(cluster_id, pivot, side, node_id): side 1 goes with the pivot, side 0 is the rest."""
    pivots = sides.select("cluster_id", "pivot").distinct()
    every = pivots.join(assignment.select("cluster_id", "node_id"), "cluster_id")
    marked = every.join(sides.withColumn("in_side", F.lit(1)), ["cluster_id", "pivot", "node_id"], "left")
    return marked.select("cluster_id", "pivot", F.coalesce("in_side", F.lit(0)).alias("side"), "node_id")


def split_roots(sides: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, pivot, side, node_id): entry nodes of both halves. sides as split_on or split_sides gives them.

    Side 0 keeps the cluster's roots that stay; side 1 has its roots, nodes with a parent outside the side, and the pivot.
    The side that stays is not listed: its roots are those of the cluster without the ones that go.
    """
    one = (sides.where("side = 1") if "side" in sides.columns else sides).select("cluster_id", "pivot", "node_id")
    own = roots.select("cluster_id", "node_id")
    stay = one.select("cluster_id", "pivot").distinct().join(own, "cluster_id").join(one, ["cluster_id", "pivot", "node_id"], "left_anti")
    up = edges.select(F.col("child_id").alias("node_id"), "parent_id")
    held = one.withColumnRenamed("node_id", "parent_id")
    outside = one.join(up, "node_id").join(held, ["cluster_id", "pivot", "parent_id"], "left_anti")
    was = one.join(own, ["cluster_id", "node_id"], "left_semi")
    parts = [x.select("cluster_id", "pivot", "node_id") for x in (was, outside, one.where(F.col("node_id") == F.col("pivot")))]
    go = parts[0].union(parts[1]).union(parts[2]).distinct()
    both = [x.select("cluster_id", "pivot", F.lit(side).alias("side"), "node_id") for side, x in ((0, stay), (1, go))]
    return both[0].union(both[1])


def grandparents(assignment: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, parents, outside): distinct clusters of all parents of the entry nodes, own one included; whether some parent has none."""
    up = roots.select("cluster_id", F.col("node_id").alias("child_id")).join(edges, "child_id")
    named = up.join(assignment.select(F.col("node_id").alias("parent_id"), F.col("cluster_id").alias("p")), "parent_id", "left")
    found = named.groupBy("cluster_id").agg(F.collect_set("p").alias("parents"), F.bool_or(F.col("p").isNull()).alias("outside"))
    empty = F.array().cast(found.schema["parents"].dataType)
    return assignment.select("cluster_id").distinct().join(found, "cluster_id", "left").select("cluster_id", F.coalesce("parents", empty).alias("parents"), F.coalesce("outside", F.lit(False)).alias("outside"))


def candidates(assignment: DataFrame, edges: DataFrame, roots: DataFrame | None = None, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """parent(c1, c2) and root(c1, c2) merges as in `merges`; inner(cluster_id, parents, clusters): those that may have sibling merges.

    clusters counts all clusters, or those of the run.
    """
    own = assignment.select("cluster_id", "node_id")
    tops = roots if roots is not None else entry_nodes(own, edges)
    gp = materialise(grandparents(own, tops, edges))
    parent = gp.where("size(parents) = 1 and not outside").select(F.col("cluster_id").alias("c1"), F.element_at("parents", 1).alias("c2")).where("c1 <> c2")
    p = own.select(F.col("node_id").alias("parent_id"), F.col("cluster_id").alias("c"))
    child = own.select(F.col("node_id").alias("child_id"), F.col("cluster_id").alias("cc"))
    with_children = edges.join(p, "parent_id").join(child, "child_id", "left").where("cc is null or c <> cc").select(F.col("c").alias("cluster_id")).distinct().withColumn("has_children", F.lit(True))
    state = gp.join(with_children, "cluster_id", "left").select("cluster_id", (F.size("parents") + F.col("outside").cast("int") == 0).alias("top"), F.coalesce("has_children", F.lit(False)).alias("has_children"))
    allowed = (F.col("c1") < F.col("c2")) & (F.col("top") | ~F.col("has_children"))
    if runs is not None:
        state, allowed = state.join(runs, "cluster_id"), (F.col("run1") == F.col("run2")) & allowed
    key = lambda c: [] if runs is None else [F.col("run").alias(c)]
    first = state.where("top").select(F.col("cluster_id").alias("c1"), "has_children", *key("run1"))
    root = first.join(state.select(F.col("cluster_id").alias("c2"), "top", *key("run2")), allowed).select("c1", "c2")

    inner = gp.where("size(parents) between 1 and 3 and not outside").select("cluster_id", "parents")
    if runs is None:
        return parent, root, inner.crossJoin(F.broadcast(gp.agg(F.count(F.lit(1)).alias("clusters"))))
    count = gp.join(runs, "cluster_id").groupBy("run").agg(F.count(F.lit(1)).alias("clusters"))
    return parent, root, inner.join(runs, "cluster_id").join(count, "run").drop("run")


#: Clusters of one parent are paired in blocks of about so many, so that no task pairs all of them.
BLOCK = 512


def siblings(inner: DataFrame) -> DataFrame:
    """(c1, c2, via, x, y): sibling merges, each once; x and y are the rows of inner of the two, in any order.

    Pairs are met at the least parent that they share, within a tile of two blocks of that parent's clusters, and are filtered
    as they are met: none is shuffled.
    """
    row = inner.select(F.struct(*inner.columns).alias("v"))
    flat = row.select("v", F.explode("v.parents").alias("p"))
    blocks = flat.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = flat.join(blocks, "p").withColumn("b", F.expr("cast(pmod(xxhash64(v.cluster_id), blocks) as int)"))
    x = placed.select("p", F.col("v").alias("x"), F.col("b").alias("i"), F.explode(F.expr("sequence(b, blocks - 1)")).alias("j"))
    y = placed.select("p", F.col("v").alias("y"), F.explode(F.expr("sequence(0, b)")).alias("i"), F.col("b").alias("j"))
    one = (F.size("x.parents") == 1) | (F.size("y.parents") == 1)
    least = one | (F.col("p") == F.array_min(F.array_intersect("x.parents", "y.parents")))
    shared = x.join(y, ["p", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("x.cluster_id") > F.col("y.cluster_id"))) & least).select("p", "x", "y")
    # a cluster and one of its parents, if they share none; where each is the other's parent, once
    up = flat.where("v.cluster_id <> p").select("p", F.col("v").alias("x")).join(row.select(F.col("v.cluster_id").alias("p"), F.col("v").alias("y")), "p")
    direct = up.where(~F.arrays_overlap("x.parents", "y.parents") & ~(F.array_contains("y.parents", F.col("x.cluster_id")) & (F.col("x.cluster_id") > F.col("y.cluster_id")))).select("p", "x", "y")
    few, via = _via(F.col("x"), F.col("y"))
    only = (F.size("x.parents") == 1) & (F.size("y.parents") == 1) & (F.col("p") != F.col("x.cluster_id")) & (F.col("p") != F.col("y.cluster_id"))
    met = [shared.where(only | few).withColumn("via", F.when(only, F.col("p")).otherwise(via)), direct.where(few).withColumn("via", via)]
    return met[0].union(met[1]).select(F.greatest("x.cluster_id", "y.cluster_id").alias("c1"), F.least("x.cluster_id", "y.cluster_id").alias("c2"), "via", "x", "y")


def _via(x: Column, y: Column) -> tuple[Column, Column]:
    """Whether at most one third cluster holds the parents of x and y that lie in neither of them, and which."""
    rest = F.array_except(F.array_union(x["parents"], y["parents"]), F.array(x["cluster_id"], y["cluster_id"]))
    return (F.size(rest) == 1) | (F.size(rest) == 0) & (x["clusters"] > 2), F.get(rest, F.lit(0))


def merges(assignment: DataFrame, edges: DataFrame, roots: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """(kind, c1, c2, via): 'parent', 'root' and 'sibling' merges of two clusters.

    parent: all parents of c1's entry nodes lie in c2. root: c1 < c2, c1 has no such parents, and c2 has none or c1 has
    no children outside. sibling: c1 > c2, both have such parents and a third cluster `via` holds all
    that lie in neither; where all lie in the two, any third cluster does and via is null.
    Parent and sibling candidates come from equi-joins on parent clusters. With runs(cluster_id, run), only clusters of one
    run are paired, and each run counts its own clusters.
    """
    parent, root, inner = candidates(assignment, edges, roots, runs)
    none = F.lit(None).cast(assignment.schema["cluster_id"].dataType)
    return (
        parent.select(F.lit("parent").alias("kind"), "c1", "c2", none.alias("via"))
        .union(root.select(F.lit("root"), "c1", "c2", none))
        .union(siblings(inner).select(F.lit("sibling"), "c1", "c2", "via"))
    )


def merge_pairs(assignment: DataFrame, edges: DataFrame, about: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """(c1, c2) of each possible merge once, c1 < c2; with about(cluster_id, a, b) also x(a, b, ...) and y(a, b, ...) of the two, in any order.

    Parent and root merges that are no sibling merges are added to those: the many pairs of siblings need no distinct.
    """
    parent, root, inner = candidates(assignment, edges, None, runs)
    about = assignment.select("cluster_id").distinct() if about is None else about
    known = about.join(inner, "cluster_id", "left")
    ends = lambda c, v: known.select(F.col("cluster_id").alias(c), F.struct(*known.columns).alias(v))
    others = parent.union(root).select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).distinct().join(ends("c1", "x"), "c1").join(ends("c2", "y"), "c2")
    near = F.arrays_overlap("x.parents", "y.parents") | F.array_contains("x.parents", F.col("c2")) | F.array_contains("y.parents", F.col("c1"))
    met = F.coalesce(near & _via(F.col("x"), F.col("y"))[0], F.lit(False))
    found = siblings(known.where("parents is not null"))
    return found.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), "x", "y").union(others.where(~met).select("c1", "c2", "x", "y"))


def relabelled(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(cluster_id, node_id): each group of keys is a cluster, named by its smallest node."""
    least = groups.groupBy(*keys).agg(F.min("node_id").alias("label"))
    return groups.join(least, keys).select(F.col("label").alias("cluster_id"), "node_id")


def apply_split(assignment: DataFrame, side: DataFrame) -> DataFrame:
    """assignment after the nodes of side(node_id) have left their clusters together."""
    moved = assignment.join(side.select("node_id", F.lit(True).alias("moved")), "node_id", "left").select("cluster_id", F.coalesce("moved", F.lit(False)).alias("moved"), "node_id")
    return relabelled(moved, ["cluster_id", "moved"])


def apply_merge(assignment: DataFrame, pairs: DataFrame) -> DataFrame:
    """assignment with the clusters of each pair (c1, c2) as one; no cluster is in two pairs."""
    into = pairs.select(F.col("c2").alias("cluster_id"), F.col("c1").alias("into"))
    return relabelled(assignment.join(into, "cluster_id", "left").select(F.coalesce("into", "cluster_id").alias("group"), "node_id"), ["group"])
