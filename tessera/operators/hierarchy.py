"""Type hierarchies over types(type_id, namespace, name, base_id, is_generic, is_abstract, in_source)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import closure


def parsed(types: DataFrame) -> DataFrame:
    """(type_key, type_id, parent_key): types outside System namespaces that are neither generic nor abstract and lie in source.

    The parent is the base type if that passes as well. Types of one simple namespace and name are one (least id).
    """
    own = types.where("in_source and not is_generic and not is_abstract and not startswith(namespace, 'System')")
    key = F.concat(F.substring_index("namespace", ".", -1), F.lit("."), "name")
    keyed = own.select("type_id", "base_id", key.alias("type_key"))
    base = keyed.select(F.col("type_id").alias("base_id"), F.col("type_key").alias("parent_key"))
    return keyed.join(base, "base_id", "left").groupBy("type_key").agg(F.min("type_id").alias("type_id"), F.min("parent_key").alias("parent_key"))


def parent_edges(tree: DataFrame) -> DataFrame:
    """(parent_id, child_id) by type key."""
    return tree.where("parent_key is not null and parent_key <> type_key").select(F.col("parent_key").alias("parent_id"), F.col("type_key").alias("child_id"))


def several_parents(edges: DataFrame) -> DataFrame:
    """(child_id, parents): children with more than one parent, which a tree may not have."""
    return edges.distinct().groupBy("child_id").agg(F.count(F.lit(1)).alias("parents")).where("parents > 1")


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return closure.depths(nodes, edges)


def at_depth(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    return closure.depths(nodes, edges).where(F.col("depth") == depth)


def descendant_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, names): sorted names of a node and its descendants."""
    pairs = closure.descendants(edges, nodes).join(nodes.select(F.col("node_id").alias("descendant_id"), "name"), "descendant_id")
    return pairs.groupBy("node_id").agg(F.array_sort(F.collect_list("name")).alias("names"))


def random_subtree(nodes: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """descendant_id of one root and its descendants; the root is that of least hash, so a seed gives one tree."""
    root = closure.roots(nodes, edges).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("node_id").cast("string"))), "node_id").limit(1)
    return closure.descendants(edges, root).select("descendant_id")


def locations(spans: DataFrame) -> DataFrame:
    """(type_id, locations): sorted file:start-end of each type."""
    return spans.groupBy("type_id").agg(F.array_sort(F.collect_list(F.format_string("%s:%d-%d", "file", "start_line", "end_line"))).alias("locations"))


def all_in_source(spans: DataFrame) -> DataFrame:
    """type_id of types with at least one location, all of them in source. spans(type_id, in_source)."""
    return spans.groupBy("type_id").agg(F.bool_and("in_source").alias("ok")).where("ok").select("type_id")
