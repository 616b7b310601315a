import random

import pytest
from pyspark.sql import functions as F

from tessera.catalogue import QUERIES
from tessera.operators import graphs, moves
from tests import graphs as G
from tests.joins import most_joined


@pytest.mark.parametrize("seed", [1, 2])
def test_split_roots_need_the_moving_side_only(spark, seed):
    """From split_on's sides alone, the same as by the definition."""
    rng = random.Random(seed)
    ids = list(range(14))
    pairs = [(i, j) for i in ids for j in ids if i < j and rng.random() < 0.2]
    clusters = [ids[:8], ids[8:]]
    state, edges = G.assignment(spark, clusters), G.edges(spark, pairs)
    sides, roots = moves.split_on(state, edges), graphs.entry_nodes(state, edges)
    top, moving = {}, {}
    for r in roots.collect():
        top.setdefault(r["cluster_id"], set()).add(r["node_id"])
    for r in sides.collect():
        moving.setdefault((r["cluster_id"], r["pivot"]), set()).add(r["node_id"])
    expected = set()
    for (c, pivot), side in moving.items():
        expected |= {(c, pivot, 0, n) for n in top.get(c, set()) - side}
        expected |= {(c, pivot, 1, n) for n in side if n == pivot or n in top.get(c, ()) or any(p not in side for p, k in pairs if k == n)}
    for given in (sides, moves.split_sides(sides, state)):
        found = [tuple(r) for r in moves.split_roots(given, roots, edges).select("cluster_id", "pivot", "side", "node_id").collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_split_roots_make_no_pairs_of_pivots_and_members(spark, tmp_path):
    """Of a nation with 300 suppliers and 300 customers."""
    key = F.col("id").cast("long")
    spark.sql("select 0 r_regionkey, 'r' r_name").write.parquet(f"{tmp_path}/region.parquet")
    spark.sql("select 0 n_nationkey, 0 n_regionkey, 'n' n_name").write.parquet(f"{tmp_path}/nation.parquet")
    for table in ("customer", "supplier"):
        c = table[0]
        rows = spark.range(300).select(key.alias({"c": "c_custkey", "s": "s_suppkey"}[c]), F.lit(0).alias(f"{c}_nationkey"), F.lit("x").alias(f"{c}_name"))
        rows.write.parquet(f"{tmp_path}/{table}.parquet")
    found = QUERIES["split_roots"](spark, str(tmp_path))
    assert most_joined(found) <= 1000
    assert {tuple(r) for r in found.collect()} == {("n0", f"s{i}", 1, f"s{i}") for i in range(300)} | {("n0", f"s{i}", 0, "n0") for i in range(300)}
