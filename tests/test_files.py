import gzip
import json
from pathlib import Path

from pyspark.sql import functions as F

from tessera.functions.tokens import link, subtokens, words
from tessera.plans import evaluate
from tessera.plans.scratch import materialise, release
from tessera.sources import clusterings, graphfiles, projects
from tests import graphs as G


def _texts(path, pattern="part-*"):
    return [p.read_text() for p in sorted(Path(path).glob(pattern))]


def test_clustering_round_trip(spark, tmp_path):
    state = G.assignment(spark, [["a", "b"], ["c"], ["d", "e"]])
    keys = spark.createDataFrame([(n, f"x/{n}.cs:1->2:{n}") for n in "abcde"], "node_id string, key string")
    parents = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "cluster_id long, parent_cluster_id long")
    clusterings.write_clustering(f"{tmp_path}/c", state, keys, parents)
    written = json.loads("".join(_texts(f"{tmp_path}/c")))
    assert written == {"Clusters": [["x/a.cs:1->2:a", "x/b.cs:1->2:b"], ["x/c.cs:1->2:c"], ["x/d.cs:1->2:d", "x/e.cs:1->2:e"]], "Parents": [[], [0], [0, 1]]}
    members, ups = clusterings.read_clustering(spark, f"{tmp_path}/c", keys.where("node_id <> 'c'"))
    assert {(r["place"], r["node_id"]) for r in members.collect()} == {(0, "a"), (0, "b"), (1, None), (2, "d"), (2, "e")}
    assert {tuple(r) for r in ups.collect()} == {(1, 0), (2, 0), (2, 1)}


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "variable", "Local", "x", "int", None, "u#L1"), ("b", "const", None, "", "string", "v", None)], "node_id string, kind string, symbol_kind string, name string, type string, value string, location string")
    edges = G.edges(spark, [("a", "b")])
    graphfiles.write_graph(graphfiles.graph_rows(nodes, edges), f"{tmp_path}/g")
    rows = [json.loads(x) for p in Path(f"{tmp_path}/g").glob("*.gz") for x in gzip.open(p, "rt")]
    found = {r["dense"]: (json.loads(r["info"]), r.get("children")) for r in rows}
    assert found == {0: ({"Location": "u#L1", "name": "x", "kind": "variable", "type": "int", "symbolKind": "Local"}, [1]), 1: ({"Location": "implicit", "value": "v", "kind": "const"}, None)}
    lines = graphfiles.dot_lines(nodes.select("node_id", F.col("name").alias("label")), edges, G.assignment(spark, [["a"], ["b"]]))
    graphfiles.write_dot(lines, f"{tmp_path}/d")
    text = "".join(_texts(f"{tmp_path}/d")).splitlines()
    assert text[0] == 'digraph "extractedGraph"{' and text[-2:] == ["n0->n1;", "}"] and sum(x.startswith("subgraph") for x in text) == 2


def test_facts_round_trip(spark, tmp_path):
    spark.createDataFrame([(1, "variable", "Local", "aB", "int", None, "f", 1, 2)], "node_id long, kind string, symbol_kind string, name string, type string, value string, file string, line int, end_line int").write.parquet(f"{tmp_path}/nodes")
    spark.createDataFrame([(1, 2)], "parent_id long, child_id long").write.parquet(f"{tmp_path}/edges")
    nodes, edges = projects.open_facts(spark, str(tmp_path))
    assert projects.with_tokens(nodes, subtokens).first()["tokens"] == ["a", "b"] and edges.count() == 1


def test_unreadable_facts_are_kept(spark, tmp_path):
    for name, lines in (("nodes", ['{"node_id": 1, "kind": "variable"}', "no json"]), ("edges", ['{"parent_id": 1, "child_id": 2}', '{"parent_id": "x"}'])):
        Path(tmp_path, name).mkdir()
        Path(tmp_path, name, "a.json").write_text("\n".join(lines))
    nodes, edges = projects.open_facts(spark, str(tmp_path), "json")
    assert [(r["node_id"], r["_corrupt_record"]) for r in nodes.collect()] == [(1, None), (None, "no json")]
    assert [(r["child_id"], r["_corrupt_record"]) for r in edges.collect()] == [(2, None), (None, '{"parent_id": "x"}')]


def test_documents_of_a_graph_and_of_scopes(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "variable", "Local", 'x"', "int", None, None), ("b", "const", None, "", "string", "v", None)], "node_id string, kind string, symbol_kind string, name string, type string, value string, location string")
    graphfiles.write_graph_document(graphfiles.graph_rows(nodes, G.edges(spark, [("a", "b")])), f"{tmp_path}/g")
    found = json.loads("".join(gzip.open(p, "rt").read() for p in Path(f"{tmp_path}/g").glob("*.gz")))
    assert found["relations"] == [[1], None] and [n["kind"] for n in found["nodes"]] == ["variable", "const"] and found["nodes"][0]["name"] == 'x"'
    graphfiles.write_scopes(spark.createDataFrame([('p"1', ["a", "b"]), ("p2", [])], "key string, in_scope array<string>"), f"{tmp_path}/s")
    assert json.loads("".join(_texts(f"{tmp_path}/s"))) == {'p"1': ["a", "b"], "p2": []}


def test_long_paths_are_whole(spark):
    row = spark.createDataFrame([("r/" + "x" * (1 << 21),)], "path string").select(clusterings.location_key(2, F.col("path"), F.lit("1"), F.lit("2"), F.lit("n")).alias("k"), link("u/", 2, "path", F.lit(0)).alias("l")).first()
    assert len(row["k"]) == (1 << 21) + len(":1->2:n") and len(row["l"]) == (1 << 21) + len("u/#L1")


def test_scratch_is_released(spark):
    df = materialise(spark.range(3))
    path = Path(df._scratch_path.removeprefix("file:").replace("//", "/"))
    assert path.exists() and df.count() == 3
    release(df)
    assert not path.exists()


def test_consolidated_run(spark):
    names = {n: " ".join(t) for n, t in G.TWO_TOKENS.items()}
    nodes = spark.createDataFrame([(n, names[n], "string", "variable") for n in G.VEE_NODES], "node_id string, name string, type string, kind string")
    types = spark.createDataFrame([("t", "string")], "node_id string, name string")
    state, scores = evaluate.consolidated(nodes, G.edges(spark, G.VEE), types, evaluate.Options(alpha=0.0, max_iterations=1, tokenizer=words))
    assert state.count() == 7
    rows = scores.collect()
    assert sum(r["size"] for r in rows) == 7 and all(r["purity"] == 1.0 for r in rows)
