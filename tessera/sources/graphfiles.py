"""Graphs as JSON and DOT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import materialise


def dense_ids(nodes: DataFrame) -> DataFrame:
    """(node_id, dense): 0-based ids in the order of node_id, ranked within ranges and offset."""
    ids = materialise(nodes.select("node_id").distinct().repartitionByRange("node_id").withColumn("part", F.spark_partition_id()))
    sizes = ids.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("node_id"))
    return ids.withColumn("own", own).join(F.broadcast(before), "part").select("node_id", (F.col("before") + F.col("own") - 1).alias("dense"))


def node_info(nodes: DataFrame) -> DataFrame:
    """(node_id, info): JSON of a node's attributes by kind. nodes(node_id, kind, symbol_kind, name, type, value, location)."""
    const = F.to_json(F.struct(F.coalesce("location", F.lit("implicit")).alias("Location"), F.col("value"), F.lit("const").alias("kind")))
    other = F.to_json(F.struct(F.coalesce("location", F.lit("implicit")).alias("Location"), "name", "kind", "type", F.col("symbol_kind").alias("symbolKind")))
    return nodes.select("node_id", F.when(F.col("kind") == "const", const).otherwise(other).alias("info"))


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dense, info, children): nodes with dense ids and those of their children, null for a leaf."""
    ids = dense_ids(nodes)
    child = edges.join(ids.select(F.col("node_id").alias("child_id"), F.col("dense").alias("child")), "child_id")
    lists = child.groupBy(F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_set("child")).alias("children"))
    return node_info(nodes).join(ids, "node_id").join(lists, "node_id", "left").select("dense", "info", "children")


def graph_document(rows: DataFrame) -> DataFrame:
    """One row (json): {"nodes": [...], "relations": [[child, ...] or null, ...]} of graph_rows, by dense id.

    One document by format, so one task holds it: an export for tools that read nothing else; the rows are the scalable form.
    """
    ordered = F.array_sort(F.collect_list(F.struct("dense", "info", F.coalesce(F.to_json("children"), F.lit("null")).alias("children"))))
    part = lambda name: F.array_join(F.transform("r", lambda x: x[name]), ",")
    return rows.agg(ordered.alias("r")).select(F.concat(F.lit('{"nodes":['), part("info"), F.lit('],"relations":['), part("children"), F.lit("]}")).alias("json"))


def write_graph_document(rows: DataFrame, path: str) -> None:
    graph_document(rows).write.mode("overwrite").option("compression", "gzip").text(path)


def scope_entry(key: Column, names: Column) -> Column:
    """A member of a JSON object: a key, and the JSON text of the names in scope."""
    text = F.to_json(F.array(key))
    return F.concat(text.substr(F.lit(2), F.length(text) - 2), F.lit(":"), names)


def scope_entries(rows: DataFrame) -> DataFrame:
    """(key, entry): the members of a JSON object, one row each. rows(key, in_scope)."""
    return rows.select("key", scope_entry(F.col("key"), F.to_json("in_scope")).alias("entry"))


def write_scopes(rows: DataFrame, path: str) -> None:
    """scope_entries as one JSON object, in the order of keys, written by one task."""
    one = scope_entries(rows).agg(F.array_sort(F.collect_list("entry")).alias("e"))
    one.select(F.concat(F.lit("{"), F.array_join("e", ","), F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def write_graph(rows: DataFrame, path: str) -> None:
    """graph_rows as gzipped JSON lines."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def dot_lines(nodes: DataFrame, edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(part, cluster_place, n, line): the lines of a DOT graph, to be written in the order of the first three columns.

    One subgraph per cluster; only edges with both ends in a cluster. nodes(node_id, label).
    """
    from tessera.sources.clusterings import places

    at = places(assignment)
    ids = dense_ids(assignment)
    member = assignment.join(at, "cluster_id").join(ids, "node_id").join(nodes.select("node_id", "label"), "node_id")
    cluster = F.col("place") + 1
    opening = at.select(F.lit(1).alias("part"), cluster.alias("cluster_place"), F.lit(-1).cast("long").alias("n"), F.concat(F.lit("subgraph cluster_"), cluster.cast("string"), F.lit(" {style=filled; color = lightgrey; node[style = filled, shape=box; color = white]; ")).alias("line"))
    closing = at.select(F.lit(1), cluster, F.lit((1 << 62)).cast("long"), F.concat(F.lit("} //subgraph cluster_"), cluster.cast("string")))
    inner = member.select(F.lit(1), cluster, F.col("dense").cast("long"), F.format_string('n%d [label="%s"]; ', "dense", "label"))
    end = lambda c, x: ids.select(F.col("node_id").alias(c), F.col("dense").alias(x))
    arrows = edges.join(end("parent_id", "p"), "parent_id").join(end("child_id", "c"), "child_id").select(F.lit(2), F.col("p").cast("int"), F.col("c").cast("long"), F.format_string("n%d->n%d;", "p", "c"))
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, 0, 0, 'digraph "extractedGraph"{'), (3, 0, 0, "}")], "part int, cluster_place int, n long, line string")
    return frame.union(opening).union(closing).union(inner).union(arrows)


def write_dot(lines: DataFrame, path: str) -> None:
    lines.orderBy("part", "cluster_place", "n").select("line").coalesce(1).write.mode("overwrite").text(path)


def hierarchy_dot(edges: DataFrame) -> DataFrame:
    """(line): one arrow per parent and child."""
    return edges.select(F.format_string('"%s"->"%s";', "parent_id", "child_id").alias("line"))
