"""Queries on distributions, entropies, gains and cluster quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.tokens import token_table
from tessera.operators import closure, info, metrics, moves
from tessera.plans import derived as D, evaluate
from tessera.plans.derived import r6
from tessera.plans.queries_tokens import PART_NODES, part_nodes, sub_sql
from tessera.plans.scratch import materialise
from tessera.plans.search import infer, merge_gains, split_gains
from tessera.registry import ORACLES, query
from tessera.session import table

PT = D.PART_TOKENS


def clusters_sql(column: str, name: str = "members") -> str:
    return f"{name} AS (SELECT {column}::VARCHAR AS cluster_id, p_partkey AS node_id FROM part)"


def vi_sql(members: str, tokens: str = "tokens") -> str:
    """Common table expressions counts, sizes and parts(cluster_id, tgc, cgt) over members and tokens."""
    return f"""own AS (SELECT m.cluster_id, t.node_id, t.token FROM {members} m JOIN {tokens} t USING (node_id)),
totals AS (SELECT token, count(*) AS total FROM {tokens} GROUP BY token), sizes AS (SELECT count(*) AS size, count(DISTINCT node_id) AS nodes FROM {tokens}),
held AS (SELECT cluster_id, token, count(*) AS n FROM own GROUP BY ALL), whole AS (SELECT cluster_id, count(*) AS size_c, count(DISTINCT node_id) AS e FROM own GROUP BY cluster_id),
parts AS (SELECT cluster_id, max(e)::DOUBLE / max(nodes) * sum(-(n::DOUBLE / size_c) * ln(n::DOUBLE / size_c)) AS tgc,
  sum(total::DOUBLE / size * -(n::DOUBLE / total) * ln(n::DOUBLE / total)) AS cgt FROM held JOIN whole USING (cluster_id) JOIN totals USING (token), sizes GROUP BY cluster_id)"""


def _vi(name: str, column: str):
    @query(name, f"WITH {PT}, {clusters_sql(column)}, {vi_sql('members')} SELECT round(sum(tgc), 6) + 0.0 AS token_given_cluster, round(sum(cgt), 6) + 0.0 AS cluster_given_token, round(sum(tgc) + sum(cgt), 6) + 0.0 AS vi FROM parts")
    def run(spark, sf):
        found = info.variation(D.part_clusters(spark, sf, column), D.part_tokens(spark, sf))
        return found.select(*[r6(c).alias(c) for c in found.columns])


_vi("vi_brand", "p_brand")
_vi("vi_type", "p_type")


@query("token_probability", f"WITH {PT} SELECT token, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM tokens), 6) + 0.0 AS p FROM tokens GROUP BY token")
def token_probability(spark, sf):
    counts = info.distribution(D.part_tokens(spark, sf))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("size")))).select("token", "n", r6(info.probability(F.col("n"), F.col("size"))).alias("p"))


@query("token_probability_dirichlet", f"""WITH {PT}, {clusters_sql('p_brand')}, own AS (SELECT cluster_id, token FROM members JOIN tokens USING (node_id)), c AS (SELECT cluster_id, token, count(*) AS n FROM own GROUP BY ALL),
s AS (SELECT cluster_id, count(*) AS size FROM own GROUP BY cluster_id), b AS (SELECT token, count(*)::DOUBLE / (SELECT count(*) FROM tokens) AS prior FROM tokens GROUP BY token)
SELECT s.cluster_id, b.token, round((coalesce(n, 0) + 2.0 * prior) / (size + 2.0), 6) + 0.0 AS p FROM s CROSS JOIN b LEFT JOIN c ON c.cluster_id = s.cluster_id AND c.token = b.token""")
def token_probability_dirichlet(spark, sf):
    """Every brand with every token of the vocabulary, absent ones included: both sides are small vocabularies."""
    tokens = D.part_tokens(spark, sf)
    own = D.part_clusters(spark, sf, "p_brand").join(tokens, "node_id")
    counts = own.groupBy("cluster_id", "token").agg(F.count(F.lit(1)).alias("n"))
    sizes = own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    base = info.distribution(tokens)
    prior = base.crossJoin(F.broadcast(base.agg(F.sum("n").alias("all")))).select("token", (F.col("n") / F.col("all")).alias("prior"))
    rows = sizes.crossJoin(prior).join(counts, ["cluster_id", "token"], "left").na.fill(0, ["n"])
    return rows.select("cluster_id", "token", r6(info.probability(F.col("n"), F.col("size"), F.col("prior"), 2.0)).alias("p"))


@query("name_geomean_prob", f"WITH {PT}, p AS (SELECT token, count(*)::DOUBLE / (SELECT count(*) FROM tokens) AS p FROM tokens GROUP BY token) SELECT node_id, round(exp(avg(ln(p))), 6) + 0.0 AS geomean FROM tokens JOIN p USING (token) GROUP BY node_id")
def name_geomean_prob(spark, sf):
    tokens = D.part_tokens(spark, sf)
    counts = info.distribution(tokens)
    p = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("size")))).select("token", (F.col("n") / F.col("size")).alias("p"))
    return info.name_probability(tokens, p).select("node_id", r6(F.col("geomean")).alias("geomean"))


@query("h_token_given_cluster", f"WITH {PT}, {clusters_sql('p_brand')}, {vi_sql('members')} SELECT cluster_id, round(tgc, 6) + 0.0 AS h FROM parts")
def h_token_given_cluster(spark, sf):
    return info.contributions(D.part_clusters(spark, sf, "p_brand"), D.part_tokens(spark, sf)).select("cluster_id", r6(F.col("token_given_cluster")).alias("h"))


@query("h_cluster_given_token", f"WITH {PT}, {clusters_sql('p_brand')}, {vi_sql('members')} SELECT cluster_id, round(cgt, 6) + 0.0 AS h FROM parts")
def h_cluster_given_token(spark, sf):
    return info.contributions(D.part_clusters(spark, sf, "p_brand"), D.part_tokens(spark, sf)).select("cluster_id", r6(F.col("cluster_given_token")).alias("h"))


@query("vi_compare_groupings", " UNION ALL ".join(f"(WITH {PT}, {clusters_sql(c)}, {vi_sql('members')} SELECT '{c}' AS grouping, round(sum(tgc) + sum(cgt), 6) + 0.0 AS vi FROM parts)" for c in ("p_brand", "p_type", "p_size")))
def vi_compare_groupings(spark, sf):
    out = None
    for c in ("p_brand", "p_type", "p_size"):
        one = info.variation(D.part_clusters(spark, sf, c), D.part_tokens(spark, sf)).select(F.lit(c).alias("grouping"), r6(F.col("vi")).alias("vi"))
        out = one if out is None else out.union(one)
    return out


def pair_gains(members, tokens):
    """(c1, c2, gain) of merging any two clusters, without smoothing: all pairs of a small set of clusters."""
    parts = info.contributions(members, tokens).select("cluster_id", (F.col("token_given_cluster") + F.col("cluster_given_token")).alias("part"))
    ids = members.select("cluster_id").distinct()
    pairs = ids.select(F.col("cluster_id").alias("c1")).join(ids.select(F.col("cluster_id").alias("c2")), F.col("c1") < F.col("c2"))
    both = pairs.join(members.withColumnRenamed("cluster_id", "c1"), "c1").select("c1", "c2", "node_id").union(pairs.join(members.withColumnRenamed("cluster_id", "c2"), "c2").select("c1", "c2", "node_id"))
    after = info.contributions(both.select(F.struct("c1", "c2").alias("cluster_id"), "node_id"), tokens).select("cluster_id.c1", "cluster_id.c2", (F.col("token_given_cluster") + F.col("cluster_given_token")).alias("after"))
    before = lambda c: parts.select(F.col("cluster_id").alias(c), F.col("part").alias(f"{c}_part"))
    return after.join(before("c1"), "c1").join(before("c2"), "c2").select("c1", "c2", (F.col("c1_part") + F.col("c2_part") - F.col("after")).alias("gain"))


@query("vi_gain_merge_pairs", f"""WITH {PT}, {clusters_sql('p_brand')}, {vi_sql('members')},
pair AS (SELECT a.cluster_id AS c1, b.cluster_id AS c2, a.tgc + a.cgt + b.tgc + b.cgt AS before, (a2.e + b2.e) AS e, (a2.size_c + b2.size_c) AS size_c
  FROM parts a JOIN parts b ON a.cluster_id < b.cluster_id JOIN whole a2 ON a2.cluster_id = a.cluster_id JOIN whole b2 ON b2.cluster_id = b.cluster_id),
ph AS (SELECT c1, c2, token, sum(n) AS n FROM pair JOIN held ON held.cluster_id IN (c1, c2) GROUP BY ALL)
SELECT c1, c2, round(max(before) - (max(e)::DOUBLE / max(nodes) * sum(-(n::DOUBLE / size_c) * ln(n::DOUBLE / size_c)) + sum(total::DOUBLE / size * -(n::DOUBLE / total) * ln(n::DOUBLE / total))), 6) + 0.0 AS gain
FROM ph JOIN pair USING (c1, c2) JOIN totals USING (token), sizes GROUP BY c1, c2""")
def vi_gain_merge_pairs(spark, sf):
    return pair_gains(D.part_clusters(spark, sf, "p_brand"), D.part_tokens(spark, sf)).select("c1", "c2", r6(F.col("gain")).alias("gain"))


def tree_tokens(spark, sf):
    return token_table(D.tree(spark, sf)[0])


TREE_TOKENS = f"tokens AS (SELECT node_id, unnest({sub_sql('name')}) AS token FROM nodes)"


@query("ancestor_prior", f"""WITH RECURSIVE {D.TREE}, {TREE_TOKENS}, up AS (SELECT n.type AS cluster_id, e.parent_id AS node_id, 1 AS depth FROM nodes n JOIN edges e ON e.child_id = n.node_id
  UNION ALL SELECT cluster_id, e.parent_id, depth + 1 FROM up JOIN edges e ON e.child_id = up.node_id),
outside AS (SELECT cluster_id, up.node_id, min(depth) AS depth FROM up JOIN nodes n ON n.node_id = up.node_id WHERE n.type <> cluster_id GROUP BY ALL),
above AS (SELECT cluster_id, token, sum(pow(0.9, depth)) AS w FROM outside JOIN tokens USING (node_id) GROUP BY ALL),
base AS (SELECT token, 0.001 * count(*) / (SELECT count(*) FROM tokens) AS b FROM tokens GROUP BY token),
k AS (SELECT n.type AS cluster_id, token FROM nodes n JOIN tokens USING (node_id) UNION SELECT cluster_id, token FROM above)
SELECT cluster_id, token, round(b + coalesce(w, 0), 6) + 0.0 AS weight FROM k JOIN base USING (token) LEFT JOIN above USING (cluster_id, token)""")
def ancestor_prior(spark, sf):
    nodes, edges = D.tree(spark, sf)
    return info.ancestor_prior(nodes.select(F.col("type").alias("cluster_id"), "node_id"), edges, token_table(nodes)).select("cluster_id", "token", r6(F.col("weight")).alias("weight"))


def _dirichlet(alpha: int):
    @query(f"vi_dirichlet_{alpha}", f"""WITH RECURSIVE {D.TREE}, {TREE_TOKENS}, up AS (SELECT n.type AS cluster_id, e.parent_id AS node_id, 1 AS depth FROM nodes n JOIN edges e ON e.child_id = n.node_id
  UNION ALL SELECT cluster_id, e.parent_id, depth + 1 FROM up JOIN edges e ON e.child_id = up.node_id),
outside AS (SELECT cluster_id, up.node_id, min(depth) AS depth FROM up JOIN nodes n ON n.node_id = up.node_id WHERE n.type <> cluster_id GROUP BY ALL),
above AS (SELECT cluster_id, token, sum(pow(0.9, depth)) AS w FROM outside JOIN tokens USING (node_id) GROUP BY ALL),
prior_sizes AS (SELECT type AS cluster_id, 0.001 + coalesce(max(w), 0) AS prior_size FROM (SELECT DISTINCT type FROM nodes) LEFT JOIN (SELECT cluster_id, sum(w) AS w FROM above GROUP BY cluster_id) ON cluster_id = type GROUP BY type),
totals AS (SELECT token, count(*) AS total FROM tokens GROUP BY token), sizes AS (SELECT count(*) AS size, count(DISTINCT node_id) AS nodes FROM tokens),
own AS (SELECT n.type AS cluster_id, t.node_id, t.token FROM nodes n JOIN tokens t USING (node_id)), held AS (SELECT cluster_id, token, count(*) AS n FROM own GROUP BY ALL),
whole AS (SELECT cluster_id, count(*) AS size_c, count(DISTINCT node_id) AS e FROM own GROUP BY cluster_id),
ps AS (SELECT cluster_id, token, n, total, e, (n + {alpha} * (0.001 * total / size + coalesce(w, 0)) / prior_size) / (size_c + {alpha}) AS p FROM held JOIN whole USING (cluster_id) JOIN prior_sizes USING (cluster_id) JOIN totals USING (token) LEFT JOIN above USING (cluster_id, token), sizes),
parts AS (SELECT cluster_id, max(e)::DOUBLE / max(nodes) * sum(-p * ln(p)) AS tgc, sum(total::DOUBLE / size * -(n::DOUBLE / total) * ln(n::DOUBLE / total)) AS cgt FROM ps, sizes GROUP BY cluster_id)
SELECT round(sum(tgc), 6) + 0.0 AS token_given_cluster, round(sum(cgt), 6) + 0.0 AS cluster_given_token, round(sum(tgc) + sum(cgt), 6) + 0.0 AS vi FROM parts""")
    def run(spark, sf):
        """The tree by type, smoothed with the ancestors' tokens."""
        nodes, edges = D.tree(spark, sf)
        found = info.variation(nodes.select(F.col("type").alias("cluster_id"), "node_id"), token_table(nodes), edges, float(alpha))
        return found.select(*[r6(c).alias(c) for c in found.columns])


_dirichlet(2)
_dirichlet(10)


SPLITS = f"""{D.TREE}, {TREE_TOKENS}, down AS (SELECT node_id AS "pivot", node_id FROM nodes UNION ALL SELECT "pivot", e.child_id FROM down JOIN edges e ON e.parent_id = down.node_id),
top AS (SELECT "pivot" AS root, node_id FROM down WHERE "pivot" IN (SELECT node_id FROM nodes WHERE type = 'region')), region AS (SELECT min(m.node_id) AS cluster_id, root FROM top m GROUP BY root),
members AS (SELECT cluster_id, node_id FROM top JOIN region USING (root)), sizes0 AS (SELECT cluster_id, count(*) AS whole FROM members GROUP BY cluster_id),
sides AS (SELECT m.cluster_id, "pivot", d.node_id FROM down d JOIN members m ON m.node_id = d."pivot" JOIN sizes0 USING (cluster_id) QUALIFY count(*) OVER (PARTITION BY "pivot") < whole)"""


def tree_state(spark, sf):
    nodes, edges = D.tree(spark, sf)
    return nodes, edges, materialise(closure.node_components(nodes, edges).select(F.col("component_id").alias("cluster_id"), "node_id"))


@query("split_candidates", f"""WITH RECURSIVE {SPLITS} SELECT cluster_id, "pivot", count(*) AS side FROM sides GROUP BY ALL""")
def split_candidates(spark, sf):
    nodes, edges, state = tree_state(spark, sf)
    return moves.split_on(state, edges).groupBy("cluster_id", "pivot").agg(F.count(F.lit(1)).alias("side"))


@query("split_gain_top", f"""WITH RECURSIVE {SPLITS}, totals AS (SELECT token, count(*) AS total FROM tokens GROUP BY token), sizes AS (SELECT count(*) AS size, count(DISTINCT node_id) AS nodes FROM tokens),
c AS (SELECT cluster_id, token, count(*) AS c FROM members JOIN tokens USING (node_id) GROUP BY ALL), w AS (SELECT cluster_id, count(*) AS n, count(DISTINCT node_id) AS e FROM members JOIN tokens USING (node_id) GROUP BY ALL),
s AS (SELECT cluster_id, "pivot", token, count(*) AS m FROM sides JOIN tokens USING (node_id) GROUP BY ALL), sw AS (SELECT cluster_id, "pivot", count(*) AS n1, count(DISTINCT node_id) AS e1 FROM sides JOIN tokens USING (node_id) GROUP BY ALL),
top2 AS (SELECT cluster_id, "pivot" FROM sw WHERE left("pivot", 1) IN ('n')),
x AS (SELECT t.cluster_id, t."pivot", c.token, c.c, coalesce(m, 0) AS m, n, n1, e, e1, total, size, nodes FROM top2 t JOIN c USING (cluster_id) LEFT JOIN s ON s."pivot" = t."pivot" AND s.token = c.token JOIN w ON w.cluster_id = t.cluster_id JOIN sw ON sw."pivot" = t."pivot" JOIN totals ON totals.token = c.token, sizes),
y AS (SELECT *, CASE WHEN k > 0 THEN -k * ln(k) ELSE 0 END AS h FROM (SELECT *, unnest([0, 1, 2]) AS half, unnest([c::DOUBLE / n, m::DOUBLE / n1, CASE WHEN n > n1 THEN (c - m)::DOUBLE / (n - n1) ELSE 0 END]) AS k, unnest([c::DOUBLE / total, m::DOUBLE / total, (c - m)::DOUBLE / total]) AS q, unnest([e, e1, e - e1]) AS ee FROM x)),
z AS (SELECT cluster_id, "pivot", half, sum(h) * max(ee)::DOUBLE / max(nodes) + sum(total::DOUBLE / size * CASE WHEN q > 0 THEN -q * ln(q) ELSE 0 END) AS part FROM y GROUP BY ALL)
SELECT cluster_id, "pivot", round(sum(CASE WHEN half = 0 THEN part ELSE -part END), 6) + 0.0 AS gain FROM z GROUP BY ALL""")
def split_gain_top(spark, sf):
    """Gains of splitting a region's component at each nation; split_gains has all pivots."""
    nodes, edges, state = tree_state(spark, sf)
    tokens = materialise(token_table(nodes))
    sides = materialise(moves.split_on(state, edges, nodes.where("type = 'nation'")))
    objective = info.VariationOfInformation(tokens, edges, 0.0)
    return split_gains(state, edges, objective, objective.parts(state), sides).select("cluster_id", "pivot", r6(F.col("gain")).alias("gain"))


_TOP_SQL = ORACLES["split_gain_top"]


@query("split_gains", _TOP_SQL.replace("""WHERE left("pivot", 1) IN ('n')""", ""))
def split_gains_query(spark, sf):
    """Gains of splitting a region's component at each pivot that leaves a rest, without smoothing."""
    nodes, edges, state = tree_state(spark, sf)
    objective = info.VariationOfInformation(materialise(token_table(nodes)), edges, 0.0)
    return split_gains(state, edges, objective, objective.parts(state)).select("cluster_id", "pivot", r6(F.col("gain")).alias("gain"))


@query("infer_coloring")
def infer_coloring(spark, sf):
    """Search over all nodes of the tree, without smoothing: at sf0.01 it takes ten steps."""
    nodes, edges = D.tree(spark, sf)
    assignment, _ = infer(nodes, edges, token_table(nodes), alpha=0.0)
    return assignment


def hierarchy_runs(spark, sf):
    """The tree with nodes typed by nation, the regions' nodes by region, and the hierarchy region -> nation of these types."""
    nodes, edges = D.tree(spark, sf)
    top = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.col("r_name").alias("name"))
    nation = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.col("n_name").alias("name"))
    types = top.union(nation)
    of = edges.where("parent_id like 'n%'").select(F.col("child_id").alias("node_id"), F.col("parent_id").alias("of")).union(types.select("node_id", "node_id"))
    typed = nodes.drop("type").join(of, "node_id").join(types.select(F.col("node_id").alias("of"), F.col("name").alias("type")), "of").drop("of")
    return typed, edges, types, edges.where("parent_id like 'r%'")


@query("per_hierarchy")
def per_hierarchy(spark, sf):
    """A search and scores for each region's hierarchy of types, over all nodes of the tree, without smoothing."""
    scores = evaluate.per_hierarchy(*hierarchy_runs(spark, sf), evaluate.Options(alpha=0.0))[1]
    return scores.select("run", "cluster_id", "size", *[r6(F.col(c)).alias(c) for c in ("purity", "silhouette")])


@query("per_type")
def per_type(spark, sf):
    """A search and scores for each supplier's lines, over relations of all customers within them, without smoothing."""
    key = F.col("c_custkey")
    nodes = table(spark, sf, "customer").select(key.alias("node_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.lit("variable").alias("kind"), (key % 3).alias("file"), key.alias("line"), key.alias("end_line"))
    edges = table(spark, sf, "customer").select(key.alias("parent_id"), (key + 3).alias("child_id"))
    line = F.col("s_suppkey") * 15
    spans = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("type_id"), (F.col("s_suppkey") % 3).alias("file"), line.alias("start_line"), (line + 30).alias("end_line"))
    scores = evaluate.per_type(nodes, edges, spans, evaluate.Options(alpha=0.0))[1]
    return scores.select("run", "cluster_id", "size", *[r6(F.col(c)).alias(c) for c in ("purity", "silhouette")])


#: Merges of single nodes of the tree: along edges, of children of one parent, of regions.
_MERGES = f"""WITH {D.TREE}, {TREE_TOKENS}, members AS (SELECT node_id AS cluster_id, node_id FROM nodes), {vi_sql('members')},
p AS (SELECT DISTINCT least(a, b) AS c1, greatest(a, b) AS c2 FROM (SELECT parent_id AS a, child_id AS b FROM edges UNION ALL SELECT x.child_id, y.child_id FROM edges x JOIN edges y USING (parent_id) WHERE x.child_id < y.child_id
  UNION ALL SELECT x.node_id, y.node_id FROM nodes x JOIN nodes y ON x.type = 'region' AND y.type = 'region' AND x.node_id < y.node_id)),
pair AS (SELECT c1, c2, a.tgc + a.cgt + b.tgc + b.cgt AS before, a2.e + b2.e AS e, a2.size_c + b2.size_c AS size_c FROM p JOIN parts a ON a.cluster_id = c1 JOIN parts b ON b.cluster_id = c2 JOIN whole a2 ON a2.cluster_id = c1 JOIN whole b2 ON b2.cluster_id = c2),
ph AS (SELECT c1, c2, token, sum(n) AS n FROM (SELECT c1, c2, token, n FROM pair JOIN held ON held.cluster_id = c1 UNION ALL SELECT c1, c2, token, n FROM pair JOIN held ON held.cluster_id = c2) GROUP BY ALL)
SELECT c1, c2, round(max(before) - (max(e)::DOUBLE / max(nodes) * sum(-(n::DOUBLE / size_c) * ln(n::DOUBLE / size_c)) + sum(total::DOUBLE / size * -(n::DOUBLE / total) * ln(n::DOUBLE / total))), 6) + 0.0 AS gain
FROM ph JOIN pair USING (c1, c2) JOIN totals USING (token), sizes GROUP BY c1, c2"""


@query("merge_gains", _MERGES)
def merge_gains_query(spark, sf):
    """Gains of all merges that the parents of clusters allow, with each node of the tree as a cluster of its own."""
    nodes, edges = D.tree(spark, sf)
    state = materialise(nodes.select(F.col("node_id").alias("cluster_id"), "node_id"))
    edges = materialise(edges)
    objective = info.VariationOfInformation(materialise(token_table(nodes)), edges, 0.0)
    return merge_gains(state, edges, objective, objective.parts(state)).select("c1", "c2", r6(F.col("gain")).alias("gain"))


@query("purity", "SELECT p_brand AS cluster_id, sum(n)::BIGINT AS size, round(max(n)::DOUBLE / sum(n), 6) + 0.0 AS purity FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def purity(spark, sf):
    found = metrics.purity(D.part_clusters(spark, sf, "p_brand"), part_nodes(spark, sf))
    return found.select("cluster_id", "size", r6(F.col("purity")).alias("purity"))


@query("avg_purity", "SELECT round(avg(purity), 6) + 0.0 AS average_purity FROM (SELECT max(n)::DOUBLE / sum(n) AS purity FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand)")
def avg_purity(spark, sf):
    return metrics.average_purity(metrics.purity(D.part_clusters(spark, sf, "p_brand"), part_nodes(spark, sf))).select(r6(F.col("average_purity")).alias("average_purity"))


@query("levenshtein_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name)::BIGINT AS distance FROM nation a CROSS JOIN nation b")
def levenshtein_pairs(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    return a.crossJoin(b).select("a", "b", F.levenshtein("x", "y").cast("long").alias("distance"))


def _silhouette_sql(classic: bool) -> str:
    """Over distinct (cluster, name, kind) with counts, as names repeat."""
    other = "WHERE m.cluster_id <> m.other" if classic else ""
    return f"""WITH {PART_NODES}, g AS (SELECT type AS cluster_id, name, kind, count(*) AS n FROM part_nodes GROUP BY ALL), names AS (SELECT DISTINCT name FROM g),
gn AS (SELECT cluster_id AS other, name AS name2, sum(n) AS n FROM g GROUP BY ALL),
far AS (SELECT names.name, other, sum(levenshtein(names.name, name2) * n)::DOUBLE / sum(n) AS d FROM names CROSS JOIN gn GROUP BY ALL),
m AS (SELECT g.cluster_id, g.name, g.kind, far.other, far.d FROM g JOIN far USING (name)),
b AS (SELECT cluster_id, name, kind, {'min' if classic else 'max'}(d) AS b FROM m {other} GROUP BY ALL),
a AS (SELECT g.cluster_id, g.name, g.kind, sum(CASE WHEN g.kind = 'methodReturn' OR h.kind = 'methodReturn' THEN 0 ELSE levenshtein(g.name, h.name) END * h.n)::DOUBLE / sum(h.n) AS a FROM g JOIN g h USING (cluster_id) GROUP BY ALL)
SELECT cluster_id, round(sum(g.n * (b - a) / greatest(a, b)) / sum(g.n), 6) + 0.0 AS silhouette FROM g JOIN a USING (cluster_id, name, kind) JOIN b USING (cluster_id, name, kind) GROUP BY cluster_id"""


@query("silhouette", _silhouette_sql(False))
def silhouette(spark, sf):
    return metrics.silhouette(D.part_clusters(spark, sf, "p_type"), part_nodes(spark, sf)).select("cluster_id", r6(F.col("silhouette")).alias("silhouette"))


@query("silhouette_classic", _silhouette_sql(True))
def silhouette_classic(spark, sf):
    return metrics.silhouette(D.part_clusters(spark, sf, "p_type"), part_nodes(spark, sf), classic=True).select("cluster_id", r6(F.col("silhouette")).alias("silhouette"))


@query("cluster_scores", f"""SELECT cluster_id, size, purity, silhouette FROM ({_silhouette_sql(False)}) JOIN (SELECT p_type AS cluster_id, sum(n)::BIGINT AS size, round(max(n)::DOUBLE / sum(n), 6) + 0.0 AS purity
 FROM (SELECT p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_type) USING (cluster_id)""")
def cluster_scores(spark, sf):
    found = metrics.scores(D.part_clusters(spark, sf, "p_type"), part_nodes(spark, sf))
    return found.select("cluster_id", "size", r6(F.col("purity")).alias("purity"), r6(F.col("silhouette")).alias("silhouette"))
