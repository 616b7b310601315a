"""Operator 5: cumulative-snapshot collapse of logged conversations, then rendering. DataFrame functions only.

Each turn's prefix has a rolling hash: two 64-bit sums modulo 2 (xor) of hashes salted with the
turn's place, as window functions, so no conversation is collected to be compared. A conversation
whose whole hash is the hash of a proper prefix of another is dropped by an anti-join against the
distinct proper prefixes; of conversations that are equal turn by turn, that of the smallest conv_id
stays.

Defined results: turns are ordered by (turn, role, text), nulls first; exact repeats of a row count
once; a null role or text is a value of its own and renders as empty; rows with a null conv_id are one
conversation with a null id; of equal conversations the smallest id stays and n_equal counts them; turns are hashed and
rendered whole, however long; further columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, release, table


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, n, h1, h2): each turn with the hashes of the prefix that it ends."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    item = lambda seed: F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    placed = (
        conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").dropDuplicates()
        .withColumn("place", F.row_number().over(order))
    )
    rolling = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(
        "conv_id", "place", "role", "text", F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"),
        F.bit_xor(item(17)).over(rolling).alias("h1"), F.bit_xor(item(29)).over(rolling).alias("h2"),
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): conversations that are no proper prefix of another; equal ones once."""
    whole = prefixes.where("place = n").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    proper = prefixes.where("place < n").select("place", "h1", "h2").distinct()
    return whole.join(proper, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_equal")


def render(rows: DataFrame) -> DataFrame:
    """(conv_id, rendered): the turns of each conversation as <|role|>, line break, text, line break."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "").alias("rendered"))


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, rendered) of the maximal conversations."""
    hashed = turns(conversations)
    prefixes = materialise(hashed.select("conv_id", "place", "n", "h1", "h2"))
    kept = materialise(maximal(prefixes))
    release(prefixes)
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    texts = render(hashed.alias("a").join(kept.alias("b"), same, "left_semi").select("conv_id", "place", "role", "text"))
    return texts.alias("a").join(kept.alias("b"), same).select("b.conv_id", "n_turns", "n_equal", "rendered")


def op5_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


OP5_SQL = """
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
           FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
     c AS (SELECT conv_id, count(*) AS n_turns, list(struct_pack(role := role, text := text) ORDER BY place) AS items,
                  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY place) AS rendered
           FROM t GROUP BY conv_id),
     u AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_equal, items, min(rendered) AS rendered FROM c GROUP BY n_turns, items)
SELECT conv_id, n_turns, n_equal, rendered FROM u
WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.items[1] = u.items[1] AND o.n_turns > u.n_turns AND o.items[1:u.n_turns] = u.items)
"""
