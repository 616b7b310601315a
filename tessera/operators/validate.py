"""Validity of a clustering with its roots, as a table of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.closure import flipped, reach


def violations(nodes: DataFrame, edges: DataFrame, assignment: DataFrame, roots: DataFrame) -> DataFrame:
    """(rule, cluster_id, node_id) of each breach; empty for a valid clustering.

    missing: a node without cluster. unknown: a member that is no node. parentless: a node without parents that is no root.
    foreign_root: a root outside its cluster. different_parents: a cluster whose nodes differ in the roots above them,
    its own not counted (node_id is null). unlisted_root: a node without parents, or with a parent outside
    its cluster, that is not among the cluster's roots.
    """
    own = assignment.select("cluster_id", "node_id").distinct()
    top = roots.select("cluster_id", "node_id").distinct()
    none = F.lit(None).cast(own.schema["cluster_id"].dataType)
    everything = nodes.select("node_id").distinct()
    missing = everything.join(own, "node_id", "left_anti").select(F.lit("missing").alias("rule"), none.alias("cluster_id"), "node_id")
    unknown = own.join(everything, "node_id", "left_anti").select(F.lit("unknown").alias("rule"), "cluster_id", "node_id")
    has_parent = edges.select(F.col("child_id").alias("node_id")).distinct()
    parentless = own.join(has_parent, "node_id", "left_anti")
    unmarked = parentless.join(top.select("node_id"), "node_id", "left_anti").select(F.lit("parentless").alias("rule"), "cluster_id", "node_id")
    foreign = top.join(own, ["cluster_id", "node_id"], "left_anti").select(F.lit("foreign_root").alias("rule"), "cluster_id", "node_id")

    # roots above each node: itself included
    above = reach(flipped(edges), own.select(F.col("node_id").alias("start"), F.col("node_id").alias("node"))).join(top.select(F.col("node_id").alias("node")).distinct(), "node", "left_semi")
    member = own.join(above.select(F.col("start").alias("node_id"), "node"), "node_id", "left")
    outer = member.join(top.select("cluster_id", F.col("node_id").alias("node"), F.lit(True).alias("own_root")), ["cluster_id", "node"], "left").withColumn("node", F.when(F.col("own_root").isNull(), F.col("node")))
    sets = outer.groupBy("cluster_id", "node_id").agg(F.array_sort(F.collect_set("node")).alias("above"))
    different = sets.groupBy("cluster_id").agg(F.min("above").alias("a"), F.max("above").alias("b")).where("a <> b")
    differing = different.select(F.lit("different_parents").alias("rule"), "cluster_id", F.lit(None).cast(own.schema["node_id"].dataType).alias("node_id"))

    up = own.join(edges.select(F.col("child_id").alias("node_id"), "parent_id"), "node_id")
    held = own.select("cluster_id", F.col("node_id").alias("parent_id"))
    entering = up.join(held, ["cluster_id", "parent_id"], "left_anti").select("cluster_id", "node_id").union(parentless.select("cluster_id", "node_id")).distinct()
    unlisted = entering.join(top, ["cluster_id", "node_id"], "left_anti").select(F.lit("unlisted_root").alias("rule"), "cluster_id", "node_id")
    return missing.unionByName(unknown).unionByName(unmarked).unionByName(foreign).unionByName(differing).unionByName(unlisted)


def is_valid(nodes: DataFrame, edges: DataFrame, assignment: DataFrame, roots: DataFrame) -> bool:
    return violations(nodes, edges, assignment, roots).isEmpty()
