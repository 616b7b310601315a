"""Queries on graphs: loading, closures, components, cycles, quotients, merges, validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.tokens import token_table
from tessera.operators import closure, graphs, hierarchy, moves, validate
from tessera.plans import derived as D
from tessera.plans.queries_information import TREE_TOKENS
from tessera.plans.scratch import materialise
from tessera.registry import query
from tessera.session import table

UP = "up AS (SELECT node_id, node_id AS ancestor_id, 0 AS depth FROM nodes UNION ALL SELECT up.node_id, e.parent_id, depth + 1 FROM up JOIN edges e ON e.child_id = up.ancestor_id)"
DOWN = "down AS (SELECT node_id, node_id AS descendant_id, 0 AS depth FROM nodes UNION ALL SELECT down.node_id, e.child_id, depth + 1 FROM down JOIN edges e ON e.parent_id = down.descendant_id)"
#: Assignment of the tree: each nation with its customers and suppliers, each region alone.
NATIONS = "members AS (SELECT node_id AS cluster_id, node_id FROM nodes WHERE type IN ('region', 'nation') UNION ALL SELECT parent_id, child_id FROM edges WHERE left(child_id, 1) IN ('c', 's'))"


def nations(nodes, edges):
    own = nodes.where("type in ('region', 'nation')").select(F.col("node_id").alias("cluster_id"), "node_id")
    leaves = edges.where(F.substring("child_id", 1, 1).isin("c", "s")).select(F.col("parent_id").alias("cluster_id"), F.col("child_id").alias("node_id"))
    return materialise(own.union(leaves))


@query("edges_distinct", f"WITH {D.CYCLIC} SELECT DISTINCT parent_id, child_id FROM looped")
def edges_distinct(spark, sf):
    return graphs.distinct_edges(D.cyclic(spark, sf))


@query("drop_self_links", f"WITH {D.CYCLIC} SELECT parent_id, child_id FROM edges")
def drop_self_links(spark, sf):
    return graphs.without_loops(graphs.distinct_edges(D.cyclic(spark, sf)))


@query("adjacency", f"WITH {D.CYCLIC} SELECT parent_id, string_agg(child_id, ',' ORDER BY child_id) AS children FROM (SELECT DISTINCT parent_id, child_id FROM looped) GROUP BY parent_id")
def adjacency(spark, sf):
    return graphs.adjacency(D.cyclic(spark, sf)).select("parent_id", F.array_join("children", ",").alias("children"))


@query("type_filter_endpoints", f"WITH {D.TREE}, t AS (SELECT node_id FROM nodes WHERE type IN ('nation', 'customer')) SELECT parent_id, child_id FROM edges WHERE parent_id IN (SELECT * FROM t) AND child_id IN (SELECT * FROM t)")
def type_filter_endpoints(spark, sf):
    return graphs.of_types(*D.tree(spark, sf), ["nation", "customer"])[1]


@query("type_filter_nodes", f"WITH {D.TREE}, t AS (SELECT node_id FROM nodes WHERE type IN ('region', 'supplier')), p AS (SELECT parent_id, child_id FROM edges WHERE parent_id IN (SELECT * FROM t)) SELECT DISTINCT parent_id AS node_id FROM p UNION SELECT child_id FROM p WHERE child_id IN (SELECT * FROM t)")
def type_filter_nodes(spark, sf):
    """A parent stays although none of its children has the type."""
    return graphs.of_types(*D.tree(spark, sf), ["region", "supplier"])[0].select("node_id")


@query("edges_by_name", f"""WITH {D.DAG}, f AS (SELECT name, min(node_id) AS target FROM nodes GROUP BY name) SELECT p.target AS parent_id, c.target AS child_id, count(*) AS multiplicity
FROM edges JOIN nodes a ON a.node_id = parent_id JOIN f p ON p.name = a.name JOIN nodes b ON b.node_id = child_id JOIN f c ON c.name = b.name GROUP BY ALL""")
def edges_by_name(spark, sf):
    """Edges whose ends fall together by name, with their multiplicity."""
    nodes, edges = D.dag(spark, sf)
    return graphs.load(edges, "name", nodes.withColumn("order", F.lit(0)))


@query("effective_nodes", f"WITH {D.TREE}, {TREE_TOKENS} SELECT n.type, count(DISTINCT t.node_id) AS n FROM nodes n JOIN tokens t USING (node_id) GROUP BY n.type")
def effective_nodes(spark, sf):
    nodes, _ = D.tree(spark, sf)
    return graphs.effective_nodes(token_table(nodes)).join(nodes, "node_id").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("entry_nodes", f"WITH {D.TREE}, {NATIONS} SELECT m.cluster_id, m.node_id FROM members m LEFT JOIN edges e ON e.child_id = m.node_id LEFT JOIN members p ON p.node_id = e.parent_id GROUP BY ALL HAVING bool_or(e.parent_id IS NULL OR p.cluster_id IS DISTINCT FROM m.cluster_id)")
def entry_nodes(spark, sf):
    nodes, edges = D.tree(spark, sf)
    return graphs.entry_nodes(nations(nodes, edges), edges)


@query("descendants", f"WITH RECURSIVE {D.TREE}, {DOWN} SELECT node_id, descendant_id, depth FROM down")
def descendants(spark, sf):
    nodes, edges = D.tree(spark, sf)
    return closure.descendants(edges, nodes)


@query("ancestors", f"WITH RECURSIVE {D.TREE}, {UP} SELECT node_id, ancestor_id, depth FROM up")
def ancestors(spark, sf):
    nodes, edges = D.tree(spark, sf)
    return closure.ancestors(edges, nodes)


@query("descendants_within", f"WITH RECURSIVE {D.TREE}, {NATIONS}, inner_edges AS (SELECT e.* FROM edges e JOIN members p ON p.node_id = e.parent_id JOIN members c ON c.node_id = e.child_id AND c.cluster_id = p.cluster_id), d AS (SELECT node_id, node_id AS descendant_id FROM nodes UNION ALL SELECT d.node_id, e.child_id FROM d JOIN inner_edges e ON e.parent_id = d.descendant_id) SELECT node_id, count(*) AS n FROM d GROUP BY node_id")
def descendants_within(spark, sf):
    nodes, edges = D.tree(spark, sf)
    inner = closure.within_clusters(edges, nations(nodes, edges)).select("parent_id", "child_id")
    return closure.descendants(inner, nodes).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query("ancestors_of_set", f"WITH RECURSIVE {D.TREE}, {UP} SELECT DISTINCT ancestor_id AS node_id FROM up WHERE left(node_id, 1) = 's'")
def ancestors_of_set(spark, sf):
    nodes, edges = D.tree(spark, sf)
    return closure.ancestors_of_set(edges, nodes.where("type = 'supplier'"))


@query("root_ancestors", f"WITH RECURSIVE {D.TREE}, {UP} SELECT DISTINCT ancestor_id AS node_id FROM up WHERE left(node_id, 1) = 's' AND ancestor_id NOT IN (SELECT child_id FROM edges)")
def root_ancestors(spark, sf):
    nodes, edges = D.tree(spark, sf)
    return closure.root_ancestors(edges, nodes.where("type = 'supplier'"), closure.roots(nodes, edges))


@query("depth_levels", f"WITH RECURSIVE {D.TREE}, d AS (SELECT node_id, 0 AS depth FROM nodes WHERE node_id NOT IN (SELECT child_id FROM edges) UNION ALL SELECT e.child_id, depth + 1 FROM d JOIN edges e ON e.parent_id = d.node_id) SELECT node_id, min(depth) AS depth FROM d GROUP BY node_id")
def depth_levels(spark, sf):
    return closure.depths(*D.tree(spark, sf))


@query("types_at_depth", f"WITH {D.TREE} SELECT node_id, 1 AS depth FROM nodes WHERE type = 'nation'")
def types_at_depth(spark, sf):
    return hierarchy.at_depth(*D.tree(spark, sf), 1)


@query("roots", f"WITH {D.DAG} SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT child_id FROM edges)")
def roots(spark, sf):
    return closure.roots(*D.dag(spark, sf)).select("node_id")


@query("descendant_names", f"WITH RECURSIVE {D.TREE}, {DOWN} SELECT down.node_id, string_agg(n.name, ',' ORDER BY n.name) AS names FROM down JOIN nodes n ON n.node_id = descendant_id GROUP BY down.node_id")
def descendant_names(spark, sf):
    return hierarchy.descendant_names(*D.tree(spark, sf)).select("node_id", F.array_join("names", ",").alias("names"))


@query("single_parent_guard", f"WITH {D.DAG} SELECT child_id, count(DISTINCT parent_id) AS parents FROM edges GROUP BY child_id HAVING count(DISTINCT parent_id) > 1")
def single_parent_guard(spark, sf):
    return hierarchy.several_parents(D.dag(spark, sf)[1])


@query("random_subtree", f"WITH RECURSIVE {D.TREE}, {DOWN} SELECT descendant_id FROM down WHERE node_id = (SELECT min_by(node_id, (md5('1:' || node_id), node_id)) FROM nodes WHERE node_id NOT IN (SELECT child_id FROM edges))")
def random_subtree(spark, sf):
    return hierarchy.random_subtree(*D.tree(spark, sf), seed=1)


@query("wcc", f"WITH RECURSIVE {D.TREE}, {UP}, root AS (SELECT node_id, ancestor_id AS root FROM up WHERE ancestor_id NOT IN (SELECT child_id FROM edges)) SELECT node_id, min(node_id) OVER (PARTITION BY root) AS component_id FROM root")
def wcc(spark, sf):
    return closure.node_components(*D.tree(spark, sf))


@query("wcc_chain", f"WITH {D.CHAIN} SELECT node_id, min(node_id) OVER (PARTITION BY split_part(node_id, ':', 1)) AS component_id FROM nodes")
def wcc_chain(spark, sf):
    return closure.node_components(*D.chain(spark, sf))


@query("undirected_closure", f"WITH RECURSIVE {D.TREE}, both_ways AS (SELECT parent_id AS a, child_id AS b FROM edges UNION ALL SELECT child_id, parent_id FROM edges), c AS (SELECT 'n3' AS node_id UNION SELECT b FROM c JOIN both_ways ON a = c.node_id) SELECT node_id FROM c")
def undirected_closure(spark, sf):
    found = materialise(closure.components(D.tree(spark, sf)[1]))
    return found.join(found.where("node_id = 'n3'").select("component_id"), "component_id", "left_semi").select("node_id")


@query("cycles_simple", f"""WITH RECURSIVE {D.CYCLIC}, p AS (SELECT DISTINCT child_id AS start, [child_id] AS path, child_id AS last FROM edges
 UNION ALL SELECT start, list_append(path, parent_id), parent_id FROM p JOIN edges e ON e.child_id = p.last WHERE NOT list_contains(path, parent_id))
SELECT start, array_to_string(path, ',') AS path FROM p JOIN edges e ON e.child_id = p.last AND e.parent_id = p.start""")
def cycles_simple(spark, sf):
    return closure.cycles(D.cyclic(spark, sf)).select("start", F.array_join("path", ",").alias("path"))


@query("quotient_edges", f"WITH {D.TREE}, {NATIONS} SELECT DISTINCT c.cluster_id, p.cluster_id AS parent_cluster_id FROM edges JOIN members c ON c.node_id = child_id JOIN members p ON p.node_id = parent_id WHERE c.cluster_id <> p.cluster_id")
def quotient_edges(spark, sf):
    nodes, edges = D.tree(spark, sf)
    return closure.quotient(edges, nations(nodes, edges))


@query("quotient_is_cyclic", f"""WITH RECURSIVE {D.TREE}, {NATIONS}, {D.CYCLIC.replace("edges AS", "steps AS")}, q AS (SELECT DISTINCT p.cluster_id AS a, c.cluster_id AS b FROM edges JOIN members c ON c.node_id = child_id JOIN members p ON p.node_id = parent_id WHERE c.cluster_id <> p.cluster_id),
t AS (SELECT a, b FROM q UNION SELECT t.a, q.b FROM t JOIN q ON q.a = t.b), v AS (SELECT parent_id AS a, child_id AS b FROM steps UNION SELECT v.a, s.child_id FROM v JOIN steps s ON s.parent_id = v.b)
SELECT 'tree' AS graph, count(*) > 0 AS cyclic FROM t WHERE a = b UNION ALL SELECT 'events', count(*) > 0 FROM v WHERE a = b""")
def quotient_is_cyclic(spark, sf):
    nodes, edges = D.tree(spark, sf)
    tree = closure.clusters_are_cyclic(edges, nations(nodes, edges))
    events = closure.is_cyclic(graphs.without_loops(D.cyclic(spark, sf)))
    return spark.createDataFrame([("tree", tree), ("events", events)], "graph string, cyclic boolean")


@query("cyclic_core", f"WITH {D.CYCLIC} SELECT parent_id, child_id FROM edges")
def cyclic_core(spark, sf):
    """Every event type follows every other, so peeling leaves all edges."""
    return closure.cyclic_core(graphs.without_loops(D.cyclic(spark, sf)))


_TYPES = "members AS (SELECT type AS cluster_id, node_id FROM nodes)"


@query("cluster_ancestors_node", f"WITH RECURSIVE {D.TREE}, {_TYPES}, {UP} SELECT DISTINCT a.cluster_id, b.cluster_id AS ancestor_id FROM up JOIN members a USING (node_id) JOIN members b ON b.node_id = ancestor_id WHERE a.cluster_id <> b.cluster_id")
def cluster_ancestors_node(spark, sf):
    nodes, edges = D.tree(spark, sf)
    return closure.node_level_ancestors(edges, nodes.select(F.col("type").alias("cluster_id"), "node_id"))


@query("cluster_ancestors_quotient", f"""WITH RECURSIVE {D.TREE}, {NATIONS}, q AS (SELECT DISTINCT c.cluster_id, p.cluster_id AS parent FROM edges JOIN members c ON c.node_id = child_id JOIN members p ON p.node_id = parent_id WHERE c.cluster_id <> p.cluster_id),
a AS (SELECT cluster_id, parent FROM q UNION SELECT a.cluster_id, q.parent FROM a JOIN q ON q.cluster_id = a.parent) SELECT cluster_id, parent AS ancestor_id FROM a WHERE cluster_id <> parent""")
def cluster_ancestors_quotient(spark, sf):
    nodes, edges = D.tree(spark, sf)
    return closure.quotient_ancestors(edges, nations(nodes, edges))


GP = """entry AS (SELECT m.cluster_id, m.node_id FROM members m LEFT JOIN edges e ON e.child_id = m.node_id LEFT JOIN members p ON p.node_id = e.parent_id GROUP BY ALL HAVING bool_or(e.parent_id IS NULL OR p.cluster_id IS DISTINCT FROM m.cluster_id)),
gp AS (SELECT DISTINCT entry.cluster_id, p.cluster_id AS p FROM entry JOIN edges e ON e.child_id = entry.node_id JOIN members p ON p.node_id = e.parent_id), ids AS (SELECT DISTINCT cluster_id FROM members)"""


def _merges(kind: str, sql: str):
    @query(f"merge_candidates_{kind}", f"WITH {D.TREE}, {NATIONS}, {GP} {sql}")
    def run(spark, sf):
        nodes, edges = D.tree(spark, sf)
        return moves.merges(nations(nodes, edges), edges).where(F.col("kind") == kind).select("c1", "c2", "via")


_merges("parent", "SELECT cluster_id AS c1, min(p) AS c2, NULL::VARCHAR AS via FROM gp GROUP BY cluster_id HAVING count(*) = 1 AND min(p) <> cluster_id")
_merges("root", """, kids AS (SELECT DISTINCT p.cluster_id FROM edges JOIN members p ON p.node_id = parent_id JOIN members c ON c.node_id = child_id WHERE c.cluster_id <> p.cluster_id)
SELECT a.cluster_id AS c1, b.cluster_id AS c2, NULL::VARCHAR AS via FROM ids a JOIN ids b ON a.cluster_id < b.cluster_id WHERE a.cluster_id NOT IN (SELECT cluster_id FROM gp) AND (b.cluster_id NOT IN (SELECT cluster_id FROM gp) OR a.cluster_id NOT IN (SELECT cluster_id FROM kids))""")
_merges("sibling", """, s AS (SELECT cluster_id, list(DISTINCT p) AS ps FROM gp GROUP BY cluster_id)
SELECT a.cluster_id AS c1, b.cluster_id AS c2, list_filter(list_distinct(list_concat(a.ps, b.ps)), lambda x: x <> a.cluster_id AND x <> b.cluster_id)[1] AS via FROM s a JOIN s b ON a.cluster_id > b.cluster_id
WHERE len(list_filter(list_distinct(list_concat(a.ps, b.ps)), lambda x: x <> a.cluster_id AND x <> b.cluster_id)) <= 1""")


@query("split_roots", f"""WITH {D.TREE}, {NATIONS}, kids AS (SELECT parent_id AS cluster_id, child_id AS "pivot" FROM edges WHERE left(child_id, 1) = 's')
SELECT cluster_id, "pivot", 1 AS side, "pivot" AS node_id FROM kids UNION ALL SELECT cluster_id, "pivot", 0, cluster_id FROM kids""")
def split_roots(spark, sf):
    """Entry nodes of both halves of a nation's cluster after each supplier has left it."""
    nodes, edges = D.tree(spark, sf)
    state = nations(nodes, edges)
    sides = materialise(moves.split_on(state, edges, nodes.where("type = 'supplier'")))
    return moves.split_roots(sides, graphs.entry_nodes(state, edges), edges)


#: A clustering that breaks every rule: some customers lack a cluster, suppliers share one, some nodes are unknown, a
#: region is no root, and a root lies in another cluster.
_BROKEN = """st AS (SELECT CASE WHEN left(node_id, 1) = 's' THEN 'zz' ELSE cluster_id END AS cluster_id, node_id FROM members WHERE left(node_id, 1) <> 'c' OR substr(node_id, 2)::INT % 7 <> 0 UNION ALL SELECT 'n0', 'ghost' || s_suppkey FROM supplier),
entries AS (SELECT m.cluster_id, m.node_id FROM members m LEFT JOIN edges e ON e.child_id = m.node_id LEFT JOIN members p ON p.node_id = e.parent_id GROUP BY ALL HAVING bool_or(e.parent_id IS NULL OR p.cluster_id IS DISTINCT FROM m.cluster_id)),
ro AS (SELECT cluster_id, node_id FROM entries WHERE node_id <> 'r0' UNION ALL SELECT 'r1', 'n2'),
orphan AS (SELECT cluster_id, node_id FROM st WHERE node_id NOT IN (SELECT child_id FROM edges)),
entering AS (SELECT s.cluster_id, s.node_id FROM st s JOIN edges e ON e.child_id = s.node_id LEFT JOIN st p ON p.node_id = e.parent_id AND p.cluster_id = s.cluster_id WHERE p.node_id IS NULL UNION SELECT * FROM orphan),
climb AS (SELECT node_id, node_id AS ancestor_id FROM st UNION SELECT climb.node_id, e.parent_id FROM climb JOIN edges e ON e.child_id = climb.ancestor_id),
above AS (SELECT s.cluster_id, s.node_id, coalesce(list(DISTINCT c.ancestor_id ORDER BY c.ancestor_id) FILTER (WHERE c.ancestor_id IN (SELECT node_id FROM ro) AND r.node_id IS NULL), []) AS roots
  FROM st s JOIN climb c USING (node_id) LEFT JOIN ro r ON r.cluster_id = s.cluster_id AND r.node_id = c.ancestor_id GROUP BY ALL),
found AS (SELECT 'missing' AS rule, count(*) AS n FROM nodes WHERE node_id NOT IN (SELECT node_id FROM st) UNION ALL SELECT 'unknown', count(*) FROM st WHERE node_id NOT IN (SELECT node_id FROM nodes)
  UNION ALL SELECT 'parentless', count(*) FROM orphan WHERE node_id NOT IN (SELECT node_id FROM ro) UNION ALL SELECT 'foreign_root', count(*) FROM ro WHERE (cluster_id, node_id) NOT IN (SELECT (cluster_id, node_id) FROM st)
  UNION ALL SELECT 'unlisted_root', count(*) FROM entering WHERE (cluster_id, node_id) NOT IN (SELECT (cluster_id, node_id) FROM ro)
  UNION ALL SELECT 'different_parents', count(*) FROM (SELECT cluster_id FROM above GROUP BY cluster_id HAVING count(DISTINCT roots) > 1))"""


@query("coloring_violations", f"WITH RECURSIVE {D.TREE}, {NATIONS}, {_BROKEN} SELECT 'valid' AS clustering, 'none' AS rule, 0::BIGINT AS n UNION ALL SELECT 'broken', rule, n FROM found WHERE n > 0")
def coloring_violations(spark, sf):
    """A valid clustering has no violations; of one that breaks every rule each rule is counted."""
    nodes, edges = D.tree(spark, sf)
    state = nations(nodes, edges)
    roots_ = materialise(graphs.entry_nodes(state, edges))
    valid = validate.violations(nodes, edges, state, roots_)
    kept = state.where((F.substring("node_id", 1, 1) != "c") | (F.expr("cast(substring(node_id, 2) as int)") % 7 != 0))
    moved = kept.select(F.when(F.substring("node_id", 1, 1) == "s", F.lit("zz")).otherwise(F.col("cluster_id")).alias("cluster_id"), "node_id")
    ghosts = table(spark, sf, "supplier").select(F.lit("n0").alias("cluster_id"), F.concat(F.lit("ghost"), F.col("s_suppkey").cast("string")).alias("node_id"))
    tops = roots_.select("cluster_id", "node_id").where("node_id <> 'r0'").union(spark.createDataFrame([("r1", "n2")], "cluster_id string, node_id string"))
    broken = validate.violations(nodes, edges, materialise(moved.union(ghosts)), materialise(tops))
    none = spark.createDataFrame([("valid", "none")], "clustering string, rule string").crossJoin(valid.agg(F.count(F.lit(1)).alias("n")))
    return none.union(broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select(F.lit("broken"), "rule", "n"))


@query("set_union", f"WITH {D.TREE} SELECT parent_id AS node_id FROM edges UNION SELECT child_id FROM edges")
def set_union(spark, sf):
    edges = D.tree(spark, sf)[1]
    return edges.select(F.col("parent_id").alias("node_id")).union(edges.select("child_id")).distinct()


@query("set_except", f"WITH {D.TREE} SELECT parent_id AS node_id FROM edges EXCEPT SELECT child_id FROM edges")
def set_except(spark, sf):
    edges = D.tree(spark, sf)[1]
    return edges.select(F.col("parent_id").alias("node_id")).subtract(edges.select("child_id"))


@query("set_intersect", f"WITH {D.TREE} SELECT parent_id AS node_id FROM edges INTERSECT SELECT child_id FROM edges")
def set_intersect(spark, sf):
    edges = D.tree(spark, sf)[1]
    return edges.select(F.col("parent_id").alias("node_id")).intersect(edges.select("child_id"))


@query("first_per_group", "SELECT p_brand, min_by(p_partkey, (p_size, p_partkey)) AS p_partkey FROM part GROUP BY p_brand")
def first_per_group(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("p_partkey"))


@query("uniform_sample", f"WITH {D.TREE} SELECT name FROM (SELECT DISTINCT name FROM nodes) ORDER BY md5('0:' || name), name LIMIT 200")
def uniform_sample(spark, sf):
    """At most 200 types of a consolidated run, by a seeded hash."""
    from tessera.plans.evaluate import uniform_sample as sample

    return sample(D.tree(spark, sf)[0].select("name").distinct(), 200, 0, "name")
