"""Clusterings as JSON: {"Clusters": [[key, ...], ...], "Parents": [[place, ...], ...]}.

A key names a node: path below the repository:start->end:node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import materialise
from tessera.schema import CLUSTERING


def location_key(root_length: int, path: Column, start: Column, end: Column, node: Column) -> Column:
    """The key of a node, null if any part is."""
    return F.concat(path.substr(F.lit(root_length + 1), F.length(path)), F.lit(":"), start, F.lit("->"), end, F.lit(":"), node)


def places(assignment: DataFrame) -> DataFrame:
    """(cluster_id, place): 0-based places in the order of cluster ids.

    Clusters are ranked within ranges and ranges offset, so no task orders all of them.
    """
    ids = materialise(assignment.select("cluster_id").distinct().repartitionByRange("cluster_id").withColumn("part", F.spark_partition_id()))
    sizes = ids.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("cluster_id"))
    return ids.withColumn("own", own).join(F.broadcast(before), "part").select("cluster_id", (F.col("before") + F.col("own") - 1).cast("int").alias("place"))


def cluster_rows(assignment: DataFrame, keys: DataFrame, parents: DataFrame) -> DataFrame:
    """(place, keys, parents): sorted keys of a cluster's nodes and places of its parent clusters."""
    at = places(assignment)
    named = assignment.join(keys.select("node_id", "key"), "node_id").join(at, "cluster_id").groupBy("place").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    up = parents.join(at, "cluster_id").join(at.select(F.col("cluster_id").alias("parent_cluster_id"), F.col("place").alias("parent_place")), "parent_cluster_id")
    ups = up.groupBy("place").agg(F.array_sort(F.collect_set("parent_place")).alias("parents"))
    return named.join(ups, "place", "left").select("place", "keys", F.coalesce("parents", F.array().cast("array<int>")).alias("parents"))


def clustering_json(rows: DataFrame) -> DataFrame:
    """One row: the JSON text of a clustering. It is one document by format; the rows are the scalable form."""
    ordered = rows.agg(F.array_sort(F.collect_list(F.struct("place", "keys", "parents"))).alias("r"))
    return ordered.select(F.to_json(F.struct(F.transform("r", lambda x: x["keys"]).alias("Clusters"), F.transform("r", lambda x: x["parents"]).alias("Parents"))).alias("json"))


def write_clustering(path: str, assignment: DataFrame, keys: DataFrame, parents: DataFrame) -> None:
    clustering_json(cluster_rows(assignment, keys, parents)).coalesce(1).write.mode("overwrite").text(path)


def parse_clustering(texts: DataFrame, column: str = "value") -> DataFrame:
    """(place, key): members of the clusters of JSON texts."""
    parsed = texts.select(F.from_json(column, CLUSTERING).alias("c"))
    return parsed.select(F.posexplode("c.Clusters").alias("place", "keys")).select("place", F.explode("keys").alias("key"))


def parse_parents(texts: DataFrame, column: str = "value") -> DataFrame:
    """(place, parent_place)."""
    parsed = texts.select(F.from_json(column, CLUSTERING).alias("c"))
    return parsed.select(F.posexplode("c.Parents").alias("place", "up")).select("place", F.explode("up").alias("parent_place"))


def resolve_keys(members: DataFrame, keys: DataFrame) -> DataFrame:
    """(place, key, node_id): each member's node, the first (least id) of its key; null for unknown keys."""
    first = keys.groupBy("key").agg(F.min("node_id").alias("node_id"))
    return members.join(first, "key", "left").select("place", "key", "node_id")


def read_clustering(spark: SparkSession, path: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((place, key, node_id), (place, parent_place)) of a file that write_clustering has written, or one JSON document a file."""
    texts = spark.read.text(path, wholetext=True)
    return resolve_keys(parse_clustering(texts), keys), parse_parents(texts)


def result_json(assignment: DataFrame, nodes: DataFrame, line_span: int) -> DataFrame:
    """One row: {"1": [{Type, Name, Location, Linespan}, ...], ..., "linespan": n}, clusters from 1 in the order of ids."""
    at = places(assignment)
    entry = F.struct(F.col("type").alias("Type"), F.col("name").alias("Name"), F.col("file").alias("Location"), F.col("line").cast("string").alias("Linespan"))
    rows = assignment.join(nodes, "node_id").join(at, "cluster_id").groupBy("place").agg(F.array_sort(F.collect_list(entry)).alias("members"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "members"))), lambda s: F.concat(F.lit('"'), (s["place"] + 1).cast("string"), F.lit('":'), F.to_json(s["members"])))
    return rows.agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit(f',"linespan":{line_span}}}')).alias("json"))


def write_histogram(rows: DataFrame, path: str) -> None:
    """Diagnostics as JSON lines; the folder is emptied first."""
    rows.write.mode("overwrite").json(path)
