"""Rewrite plans: wrapper types for clusters, declarations to retype, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_declarations(clusters: DataFrame, ancestors: DataFrame, type_name: str) -> DataFrame:
    """(cluster_id, declaration): a wrapper type ClusterN with a value, conversions from and to references and the wrapped type, and
    one to each ancestor cluster."""
    ups = ancestors.groupBy("cluster_id").agg(F.array_sort(F.collect_set("ancestor_id")).alias("ups"))
    joined = clusters.select("cluster_id").distinct().join(ups, "cluster_id", "left")
    name = F.concat(F.lit("Cluster"), F.col("cluster_id").cast("string"))
    head = F.format_string(
        "public class %1$s\n{\n    public %1$s(%2$s d) { val = d; }\n    public %2$s val;\n    public static implicit operator %1$s(ref %1$s d) { return d.Value; }\n    public static implicit operator ref %1$s(%1$s d) { return new %1$s(d.val); }\n    public static implicit operator %2$s(%1$s d) { return d.val; }\n    public static implicit operator %1$s(%2$s d) { return new %1$s(d); }\n",
        name, F.lit(type_name),
    )
    each = F.transform(F.coalesce("ups", F.array().cast(ups.schema["ups"].dataType)), lambda a: F.concat(F.lit("    public static implicit operator Cluster"), a.cast("string"), F.lit("("), name, F.lit(" d) { return new Cluster"), a.cast("string"), F.lit("(d.val); }\n")))
    return joined.select("cluster_id", F.concat(head, F.array_join(each, ""), F.lit("}")).alias("declaration"))


def namespace_text(declarations: DataFrame, name: str = "Inferred") -> DataFrame:
    """One row: all declarations in a namespace, in the order of clusters."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "declaration"))), lambda s: s["declaration"])
    return declarations.agg(F.concat(F.lit(f"namespace {name} {{\n"), F.array_join(ordered, "\n"), F.lit("\n};\n")).alias("text"))


def declaration_index(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """(node_id, cluster_id, kind, ...): declarations of clustered nodes; constants have none."""
    return nodes.where("kind <> 'const'").join(assignment.select("node_id", "cluster_id"), "node_id")


def kind_histogram(index: DataFrame) -> DataFrame:
    return index.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def plan(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """(file, line, name, old_type, new_type): declarations to retype. Constants, lambda parameters and ref/out parameters stay.

    nodes(node_id, kind, symbol_kind, name, type, file, line, is_const, in_lambda, by_ref); missing flags count as false.
    """
    flags = [f for f in ("is_const", "in_lambda", "by_ref") if f in nodes.columns]
    rows = declaration_index(nodes, assignment)
    for f in flags:
        rows = rows.where(~F.coalesce(F.col(f), F.lit(False)))
    return rows.select("file", "line", "name", F.col("type").alias("old_type"), F.concat(F.lit("Cluster"), F.col("cluster_id").cast("string")).alias("new_type"))


def casts(expressions: DataFrame, type_name: str) -> DataFrame:
    """(expr_id, file, action, text): expressions of a cluster's type to be unwrapped once declarations are retyped.

    Arguments and indexed expressions take their value, owners of member accesses a cast; other places stay.
    expressions(expr_id, file, place, cluster_id, source), cluster_id null for other types.
    """
    taken = F.col("place").isin("argument", "element_access")
    text = F.when(taken, F.concat("source", F.lit(".val"))).otherwise(F.concat(F.lit(f"(({type_name})"), "source", F.lit(")")))
    rows = expressions.where(F.col("cluster_id").isNotNull() & F.col("place").isin("argument", "element_access", "member_access"))
    return rows.select("expr_id", "file", F.when(taken, "value").otherwise("cast").alias("action"), text.alias("text"))


def rewritten_files(plan_rows: DataFrame, cast_rows: DataFrame, suffix: str = "_modified.cs") -> DataFrame:
    """(file, target, declarations, casts) of each file that a rewrite changes."""
    a = plan_rows.groupBy("file").agg(F.count(F.lit(1)).alias("declarations"))
    b = cast_rows.groupBy("file").agg(F.count(F.lit(1)).alias("casts"))
    return a.join(b, "file", "full").select("file", F.concat("file", F.lit(suffix)).alias("target"), F.coalesce("declarations", F.lit(0)).alias("declarations"), F.coalesce("casts", F.lit(0)).alias("casts"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """(id, n, messages): errors (warning level 0) by id with their sorted messages. rows(id, warning_level, message)."""
    return rows.where("warning_level = 0").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("message")).alias("messages"))
