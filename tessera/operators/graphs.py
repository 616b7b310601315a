"""Graph loading, filters and projections over nodes(node_id, ...) and edges(parent_id, child_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Set semantics: each edge once."""
    return edges.select("parent_id", "child_id").distinct()


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("parent_id <> child_id")


def adjacency(edges: DataFrame) -> DataFrame:
    """(parent_id, children): children sorted."""
    return edges.groupBy("parent_id").agg(F.array_sort(F.collect_set("child_id")).alias("children"))


def of_type_sets(nodes: DataFrame, edges: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """of_types for each run of types(run, type): nodes(run, ...) and edges(run, parent_id, child_id)."""
    typed = nodes.join(types.select("run", "type").distinct(), "type").select("run", "node_id")
    parents = edges.join(typed.withColumnRenamed("node_id", "parent_id"), "parent_id")
    kept = parents.join(typed.withColumnRenamed("node_id", "child_id"), ["run", "child_id"], "left_semi").select("run", "parent_id", "child_id")
    ids = parents.select("run", F.col("parent_id").alias("node_id")).union(kept.select("run", "child_id")).distinct()
    return nodes.join(ids, "node_id").select("run", *nodes.columns), kept


def of_types(nodes: DataFrame, edges: DataFrame, types: DataFrame | list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges whose two ends have one of the types, a list or a table types(type); a parent stays even without such a child."""
    listed = isinstance(types, list)
    typed = (nodes.where(F.col("type").isin(types)) if listed else nodes.join(types.select("type").distinct(), "type", "left_semi")).select("node_id")
    parents = edges.join(typed.withColumnRenamed("node_id", "parent_id"), "parent_id", "left_semi")
    kept = parents.join(typed.withColumnRenamed("node_id", "child_id"), "child_id", "left_semi").select("parent_id", "child_id")
    ids = parents.select(F.col("parent_id").alias("node_id")).union(kept.select("child_id")).distinct()
    return nodes.join(ids, "node_id", "left_semi"), kept


def load(edges: DataFrame, resolution: str = "identity", nodes: DataFrame | None = None) -> DataFrame:
    """Edges between nodes. By 'identity' each end is itself; by 'name' it is the first node (least order) of its name.

    The name mode keeps the multiplicity of edges that fall together; nodes then need columns name and order.
    """
    if resolution == "identity":
        return distinct_edges(edges)
    first = Window.partitionBy("name").orderBy("order", "node_id")
    named = nodes.withColumn("target", F.first("node_id").over(first)).select("node_id", "target")
    ends = edges.join(named.selectExpr("node_id parent_id", "target p"), "parent_id").join(named.selectExpr("node_id child_id", "target c"), "child_id")
    return ends.groupBy(F.col("p").alias("parent_id"), F.col("c").alias("child_id")).agg(F.count(F.lit(1)).alias("multiplicity"))


def effective_nodes(tokens: DataFrame) -> DataFrame:
    """Nodes with at least one token."""
    return tokens.select("node_id").distinct()


def entry_nodes(assignment: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, node_id): nodes without parents, or with a parent outside their cluster."""
    own = assignment.select("cluster_id", "node_id")
    up = edges.select(F.col("child_id").alias("node_id"), "parent_id").join(own.select(F.col("node_id").alias("parent_id"), F.col("cluster_id").alias("parent_cluster")), "parent_id", "left")
    seen = own.join(up, "node_id", "left").groupBy("cluster_id", "node_id")
    outside = F.bool_or(F.col("parent_id").isNull() | ~F.col("parent_cluster").eqNullSafe(F.col("cluster_id")))
    return seen.agg(outside.alias("entry")).where("entry").select("cluster_id", "node_id")


def without_empty(assignment: DataFrame, tokens: DataFrame) -> DataFrame:
    """Clusters with at least one effective node."""
    some = assignment.join(effective_nodes(tokens), "node_id", "left_semi").select("cluster_id").distinct()
    return assignment.join(some, "cluster_id", "left_semi").select("cluster_id", "node_id")


def contained(nodes: DataFrame, spans: DataFrame, bucket: int = 256) -> DataFrame:
    """(node_id, type_id): nodes whose lines lie within the lines of a type of the same file.

    Lines are cut in buckets and joined on (file, bucket), so the range test runs within buckets only.
    """
    buckets = spans.select("type_id", "file", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))).alias("bucket"))
    keyed = nodes.select("node_id", "file", "line", "end_line", F.floor(F.col("line") / bucket).alias("bucket"))
    n, s = keyed.alias("n"), buckets.alias("s")
    return n.join(s, ["file", "bucket"]).where("n.line >= s.start_line and n.end_line <= s.end_line").select("node_id", "type_id")


def relations_within(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(type_id, parent_id, child_id): edges whose two ends lie in the same type; inside as `contained` gives it."""
    parents = edges.join(inside.selectExpr("node_id parent_id", "type_id"), "parent_id")
    return parents.join(inside.selectExpr("node_id child_id", "type_id"), ["child_id", "type_id"]).select("type_id", "parent_id", "child_id")


def line_span(spans: DataFrame) -> DataFrame:
    return spans.select("type_id", (F.col("end_line") - F.col("start_line") + 1).alias("line_span"))
