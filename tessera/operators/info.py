"""Token distributions, entropies and variation of information between clusters and tokens.

tokens(node_id, pos, token); assignment(cluster_id, node_id). Natural logarithms. Both entropies are sums of
contributions of clusters, so the gain of a change needs the clusters it touches alone. Where tokens have a column
run, each run is a table of its own: its totals are those of its tokens, and clusters lie within runs.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.closure import flipped, reach

DISCOUNT, TOLERANCE = 0.9, 0.001


def plogp(p: Column) -> Column:
    """-p ln p, 0 at 0."""
    return F.when(p > 0, -p * F.ln(p) + 0.0).otherwise(0.0)


def distribution(rows: DataFrame, key: str = "token", weight: Column | None = None) -> DataFrame:
    """(key, n): weighted counts, 1 a row by default."""
    return rows.groupBy(key).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))


def probability(n: Column, size: Column, prior: Column | None = None, alpha: float = 1.0) -> Column:
    """n / size; with a prior (as a probability) and alpha > 0, (n + alpha prior) / (size + alpha)."""
    return n / size if prior is None or alpha == 0 else (n + alpha * prior) / (size + alpha)


def run_keys(tokens: DataFrame) -> list[str]:
    return [c for c in tokens.columns if c == "run"]


def with_totals(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """rows beside the one row of totals, or that of their run."""
    return rows.join(totals, keys) if keys else rows.crossJoin(F.broadcast(totals))


def ancestor_prior(members: DataFrame, edges: DataFrame, tokens: DataFrame, discount: float = DISCOUNT, tolerance: float = TOLERANCE) -> DataFrame:
    """(cluster_id, token, weight): tolerance times the share of the token in all nodes, plus discount^depth for each
    occurrence in an ancestor outside the cluster. Each ancestor counts once, at its least depth."""
    up = reach(flipped(edges), members.select(F.col("cluster_id").alias("start"), F.col("node_id").alias("node"))).where("depth > 0")
    keys = run_keys(tokens)
    above = up.join(tokens.select(F.col("node_id").alias("node"), *keys, "token"), "node").groupBy(F.col("start").alias("cluster_id"), *keys, "token").agg(F.sum(F.pow(F.lit(discount), "depth")).alias("weight"))
    counts = tokens.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))
    base = with_totals(counts, counts.groupBy(*keys).agg(F.sum("n").alias("size")), keys).select(*keys, "token", (tolerance * F.col("n") / F.col("size")).alias("base"))
    clusters = members.select("cluster_id").distinct()
    # one row of base per cluster and token only where the cluster holds the token or an ancestor does
    held = members.join(tokens.select("node_id", *keys, "token"), "node_id").select("cluster_id", *keys, "token").union(above.select("cluster_id", *keys, "token")).distinct()
    return held.join(clusters, "cluster_id", "left_semi").join(base, [*keys, "token"]).join(above.drop(*keys), ["cluster_id", "token"], "left").select("cluster_id", "token", (F.col("base") + F.coalesce("weight", F.lit(0.0))).alias("weight"), F.coalesce("weight", F.lit(0.0)).alias("above"))


def contributions(members: DataFrame, tokens: DataFrame, edges: DataFrame | None = None, alpha: float = 0.0) -> DataFrame:
    """(cluster_id, effective, token_given_cluster, cluster_given_token): each cluster's part of the two entropies.

    members may hold overlapping alternatives under different cluster_ids; totals are those of all tokens.
    """
    keys = run_keys(tokens)
    counts = tokens.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("total"))
    sizes = tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.countDistinct("node_id").alias("nodes"))
    own = members.select("cluster_id", "node_id").join(tokens.select("node_id", *keys, "token"), "node_id")
    held = own.groupBy("cluster_id", *keys, "token").agg(F.count(F.lit(1)).alias("n"))
    whole = own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size_c"), F.countDistinct("node_id").alias("effective"))
    rows = with_totals(held.join(whole, "cluster_id").join(counts, [*keys, "token"]), sizes, keys)
    p = probability(F.col("n"), F.col("size_c"))
    if alpha > 0:
        prior = ancestor_prior(members, edges, tokens)
        # the base sums to TOLERANCE over all tokens, the rest to what ancestors add
        total = prior.groupBy("cluster_id").agg((F.sum("above") + TOLERANCE).alias("prior_size"))
        rows = rows.join(prior.select("cluster_id", "token", "weight"), ["cluster_id", "token"]).join(total, "cluster_id")
        p = probability(F.col("n"), F.col("size_c"), F.col("weight") / F.col("prior_size"), alpha)
    q = F.col("n") / F.col("total")
    return rows.groupBy("cluster_id").agg(
        F.first("effective").alias("effective"),
        (F.sum(plogp(p)) * F.first("effective") / F.first("nodes")).alias("token_given_cluster"),
        F.sum(F.col("total") / F.col("size") * plogp(q)).alias("cluster_given_token"),
    )


def variation(members: DataFrame, tokens: DataFrame, edges: DataFrame | None = None, alpha: float = 0.0) -> DataFrame:
    """One row (token_given_cluster, cluster_given_token, vi)."""
    parts = contributions(members, tokens, edges, alpha)
    a, b = F.coalesce(F.sum("token_given_cluster"), F.lit(0.0)), F.coalesce(F.sum("cluster_given_token"), F.lit(0.0))
    return parts.agg(a.alias("token_given_cluster"), b.alias("cluster_given_token"), (a + b).alias("vi"))


def name_probability(tokens: DataFrame, probabilities: DataFrame) -> DataFrame:
    """(node_id, geomean): geometric mean of the probabilities (token, p) of a node's tokens."""
    return tokens.join(probabilities.select("token", "p"), "token").groupBy("node_id").agg(F.exp(F.avg(F.ln("p"))).alias("geomean"))


class Objective(Protocol):
    """What the search minimises: a sum over clusters."""

    def parts(self, members: DataFrame) -> DataFrame:
        """(cluster_id, part) of each of the clusters in members(cluster_id, node_id)."""


class VariationOfInformation:
    """The default objective: variation of information between clusters and tokens."""

    def __init__(self, tokens: DataFrame, edges: DataFrame, alpha: float = 0.0):
        self.tokens, self.edges, self.alpha = tokens, edges, alpha

    def parts(self, members: DataFrame) -> DataFrame:
        rows = contributions(members, self.tokens, self.edges, self.alpha)
        return rows.select("cluster_id", (F.col("token_given_cluster") + F.col("cluster_given_token")).alias("part"))
