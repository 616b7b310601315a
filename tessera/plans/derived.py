"""Graphs derived from relational tables, for queries and tests, with their SQL as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import table


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Region -> nation -> customer and supplier: nodes(node_id, name, type, kind), edges."""
    parts = (("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name"))
    nodes = None
    for name, prefix, key, label in parts:
        one = table(spark, sf, name).select(_id(prefix, key).alias("node_id"), F.col(label).alias("name"), F.lit(name).alias("type"), F.lit("variable").alias("kind"))
        nodes = one if nodes is None else nodes.union(one)
    n, c, s = (table(spark, sf, x) for x in ("nation", "customer", "supplier"))
    edges = (
        n.select(_id("r", "n_regionkey").alias("parent_id"), _id("n", "n_nationkey").alias("child_id"))
        .union(c.select(_id("n", "c_nationkey"), _id("c", "c_custkey")))
        .union(s.select(_id("n", "s_nationkey"), _id("s", "s_suppkey")))
    )
    return nodes, edges


TREE = """nodes AS (SELECT 'r' || r_regionkey AS node_id, r_name AS name, 'region' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier' FROM supplier),
edges AS (SELECT 'r' || n_regionkey AS parent_id, 'n' || n_nationkey AS child_id FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


def dag(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Brand -> part and type -> part."""
    part = table(spark, sf, "part")
    nodes = (
        part.select(F.concat(F.lit("b:"), "p_brand").alias("node_id"), F.col("p_brand").alias("name"), F.lit("brand").alias("type")).distinct()
        .union(part.select(F.concat(F.lit("t:"), "p_type"), "p_type", F.lit("type")).distinct())
        .union(part.select(_id("p:", "p_partkey"), F.translate("p_name", " ", "_"), F.lit("part")))
    )
    edges = part.select(F.concat(F.lit("b:"), "p_brand").alias("parent_id"), _id("p:", "p_partkey").alias("child_id")).union(part.select(F.concat(F.lit("t:"), "p_type"), _id("p:", "p_partkey")))
    return nodes, edges


DAG = """nodes AS (SELECT DISTINCT 'b:' || p_brand AS node_id, p_brand AS name, 'brand' AS type FROM part UNION ALL SELECT DISTINCT 't:' || p_type, p_type, 'type' FROM part
  UNION ALL SELECT 'p:' || p_partkey, replace(p_name, ' ', '_'), 'part' FROM part),
edges AS (SELECT 'b:' || p_brand AS parent_id, 'p:' || p_partkey AS child_id FROM part UNION ALL SELECT 't:' || p_type, 'p:' || p_partkey FROM part)"""


def cyclic(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with repeats and loops: an event's type -> the user's next event's type."""
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select(F.col("event_type").alias("parent_id"), following.alias("child_id")).where("child_id is not null")


CYCLIC = """raw AS (SELECT event_type AS parent_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS child_id FROM events),
looped AS (SELECT parent_id, child_id FROM raw WHERE child_id IS NOT NULL), edges AS (SELECT DISTINCT parent_id, child_id FROM looped WHERE parent_id <> child_id)"""


def chain(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Turn -> next turn of each conversation."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    key = lambda c: F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col(c).cast("string"))
    after = turns.withColumn("next", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    return turns.select(key("turn").alias("node_id")), after.where("next is not null").select(key("turn").alias("parent_id"), key("next").alias("child_id"))


CHAIN = """steps AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
nodes AS (SELECT conv_id || ':' || turn AS node_id FROM steps), edges AS (SELECT conv_id || ':' || turn AS parent_id, conv_id || ':' || next AS child_id FROM steps WHERE next IS NOT NULL)"""


def part_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """tokens(node_id, pos, token): words of part names."""
    from tessera.functions.tokens import token_table, words

    return token_table(table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name")), words)


def part_clusters(spark: SparkSession, sf: str, column: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col(column).cast("string").alias("cluster_id"), F.col("p_partkey").alias("node_id"))


PART_TOKENS = "tokens AS (SELECT node_id, token FROM (SELECT p_partkey AS node_id, unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token <> '')"


def r6(c):
    """Rounded to six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)
