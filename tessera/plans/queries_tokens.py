"""Queries on tokenisers and string functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import tokens as T
from tessera.registry import query
from tessera.session import table


def names(spark, sf):
    """Identifiers of part, customer, nation and supplier: (name), each once; spaces become underscores."""
    parts = (("part", "p_name"), ("customer", "c_name"), ("nation", "n_name"), ("supplier", "s_name"), ("part", "p_brand"), ("part", "p_type"))
    out = None
    for t, c in parts:
        one = table(spark, sf, t).select(F.translate(c, " ", "_").alias("name"))
        out = one if out is None else out.union(one)
    return out.distinct()


NAMES = "names AS (SELECT DISTINCT replace(name, ' ', '_') AS name FROM (" + " UNION ALL ".join(f"SELECT {c} AS name FROM {t}" for t, c in (("part", "p_name"), ("customer", "c_name"), ("nation", "n_name"), ("supplier", "s_name"), ("part", "p_brand"), ("part", "p_type"))) + "))"


def sub_sql(e: str) -> str:
    """DuckDB list of the subtokens of e: four passes that put a mark between capture groups."""
    for rule in ("([^A-Z0-9])([A-Z0-9])", "([A-Z])([0-9])", "([0-9])([A-Za-z])", "([A-Z])([A-Z][a-z])"):
        e = f"regexp_replace({e}, '{rule}', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(string_split(lower(regexp_replace({e}, '[_.]', chr(1), 'g')), chr(1)), lambda t: t <> '')"


def grams_sql(e: str, n: int) -> str:
    return f"list_transform(range(1, greatest(length({e}) - {n - 2}, 1)), lambda i: substr({e}, i, {n}))"


_SUB = sub_sql("name")
_BI = "flatten(list_transform(" + _SUB + ", lambda t: " + grams_sql("t", 2) + "))"
_TRI = "flatten(list_transform(" + _SUB + ", lambda t: CASE WHEN length(t) < 3 THEN [t] ELSE " + grams_sql("t", 3) + " END))"


def _joined(name, tokenizer, sql):
    @query(name, f"WITH {NAMES} SELECT name, array_to_string({sql}, ' ') AS tokens, len({sql})::BIGINT AS n FROM names")
    def run(spark, sf):
        t = tokenizer("name")
        return names(spark, sf).select("name", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n"))


_joined("subtokens_split", T.subtokens, _SUB)
_joined("char_split", T.characters, "list_filter(string_split(lower(name), ''), lambda t: t <> '')")
_joined("char_bigrams", T.character_bigrams, f"CASE WHEN name = '' THEN [''] ELSE {grams_sql('name', 2)} END")
_joined("subtoken_bigrams", T.subtoken_bigrams, _BI)
_joined("subtoken_trigrams", T.subtoken_trigrams, _TRI)
_joined("trigram_and_subtoken", T.subtokens_and_trigrams, f"list_concat({_SUB}, {_TRI})")


@query("subtoken_counts", f"WITH {NAMES} SELECT token, count(*) AS n FROM (SELECT unnest({_SUB}) AS token FROM names) GROUP BY token")
def subtoken_counts(spark, sf):
    from tessera.operators.info import distribution

    return distribution(names(spark, sf).select(F.explode(T.subtokens("name")).alias("token")))


@query("dot_escape", "SELECT event_id, replace(replace(replace(replace(replace(replace(props, '\"', ''''''), '\\', '\\\\'), chr(13), ' '), chr(10), ' '), '^', ' '), '\t', '\t') AS escaped FROM events")
def dot_escape(spark, sf):
    return table(spark, sf, "events").select("event_id", T.dot_escape("props").alias("escaped"))


@query("source_links", "SELECT c_custkey, 'https://host/repo/' || replace(substr('C:\\src\\' || c_mktsegment || '\\' || c_name, 8), '\\', '/') || '#L' || (c_nationkey + 1) AS link FROM customer")
def source_links(spark, sf):
    path = F.concat(F.lit("C:\\src\\"), "c_mktsegment", F.lit("\\"), "c_name")
    return table(spark, sf, "customer").select("c_custkey", T.link("https://host/repo/", 7, path, F.col("c_nationkey")).alias("link"))


_KIND = "CASE p_size % 3 WHEN 0 THEN 'const' WHEN 1 THEN 'methodReturn' ELSE 'variable' END"


def part_nodes(spark, sf):
    """Parts as nodes of three kinds, with a type, a value for constants, a file and lines."""
    kind = F.when(F.col("p_size") % 3 == 0, "const").when(F.col("p_size") % 3 == 1, "methodReturn").otherwise("variable")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("node_id"), kind.alias("kind"), F.when(kind == "methodReturn", F.when(F.col("p_size") % 2 == 0, "constructor").otherwise("method")).when(kind == "variable", "Local").alias("symbol_kind"),
        F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.when(kind == "const", F.col("p_size").cast("string")).alias("value"),
        F.concat(F.lit("src/"), "p_brand").alias("file"), F.col("p_size").alias("line"),
    )


PART_NODES = f"part_nodes AS (SELECT p_partkey AS node_id, {_KIND} AS kind, CASE WHEN p_size % 3 = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'constructor' ELSE 'method' END WHEN p_size % 3 = 2 THEN 'Local' END AS symbol_kind, p_name AS name, p_type AS type, CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR END AS value, 'src/' || p_brand AS file, p_size AS line FROM part)"


@query("display_strings", f"""WITH {PART_NODES} SELECT node_id, CASE WHEN kind = 'const' THEN 'const:' || value ELSE name END || ' : ' || type AS display,
 CASE kind WHEN 'const' THEN 'const:' || value || chr(10) || '<B>' || type || '</B>' WHEN 'methodReturn' THEN '*' || name ELSE name END AS label FROM part_nodes""")
def display_strings(spark, sf):
    k = ("kind", "name", "value", "type")
    return part_nodes(spark, sf).select("node_id", T.display(*k).alias("display"), T.dot_label(*k).alias("label"))
