"""Operator 4: URL filter with redirect equivalence. DataFrame functions only.

The longest fitting rule decides a url. Where none fits, decisions of its aliases do: a component of aliases is
blocked if any of its urls is blocked by rule and none is allowed by rule (allow has precedence); without
either it is allowed. Components come from these edges, distributed over all pages:

* redirect and canonical links: every canonical <link> and every meta refresh of a page, with entities decoded and
  relative targets resolved (also ?query, name, ./name and ../name);
* normal form: the url that a site's own redirects lead to, without a leading www. or m., default port, index.html,
  .html or .htm, trailing slashes, and TRACKING parameters of the query; other parameters stay as they are.

An alias key is host, path and query; scheme and fragment don't count. Defined results: a null url, or
one without ://, has empty host and path and no alias; a null html has no links; repeated pages give repeated rows; a
link to itself, an empty link and one of another kind (mailto:) is no edge; of equally long rules an allow fits first; html
and urls are read whole, however long; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, materialise, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

LINK_TAG = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_TAG = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH_URL = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
TRACKING = r"&(utm_[^&=]*|ref|fbclid|gclid|sessionid)=[^&]*"
HOST_FORMS, FILE_FORMS = r"^(www|m)\.|:(80|443)$", r"(/index)?\.html?$"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def key_of(url: Column) -> Column:
    """The alias key of a url with ://, else null."""
    return F.when(url.contains("://"), F.concat(host_of(url), F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule, else null; of equally long ones an allow."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[1], r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("string")


def verdict_of(rule: Column, rules=RULES) -> Column:
    pairs = [F.lit(x) for r in rules for x in r]
    return F.create_map(*pairs)[rule] if pairs else F.lit(None).cast("string")


def normal_key(key: Column) -> Column:
    """The alias key of the normal form of the url with this alias key."""
    host = F.regexp_replace(F.regexp_extract(key, r"^([^/?]*)", 1), HOST_FORMS, "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(key, r"^[^/?]*([^?]*)", 1), FILE_FORMS, ""), r"/+$", "")
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(key, r"^[^?]*\?(.*)$", 1)), TRACKING, "")
    kept = F.regexp_replace(query, "^&+", "")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def resolved(link: Column, url: Column) -> Column:
    """The absolute url that a link of the page url names; null for other kinds of link."""
    root = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    target, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    joined = F.when(target.startswith("/"), target).otherwise(F.concat(F.regexp_extract(path, r"^(.*)/", 1), F.lit("/"), target))
    # the last piece ends the path: after . or .. it is empty
    pieces = F.split(F.regexp_replace(joined, r"(^|/)(\.\.?)$", "$1$2/"), "/", -1)
    step = lambda done, x: F.when(x == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    plain = F.array_join(F.aggregate(pieces, F.array().cast("array<string>"), step), "/")
    return (
        F.when(link.contains("://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(F.regexp_extract(url, r"^([^:/?#]*):", 1), F.lit(":"), link))
        .when(target == "", F.concat(root, path, rest))
        .otherwise(F.concat(root, plain, rest))
    )


def links_of(html: Column) -> Column:
    """All links of canonical tags and refreshes, in array order, with entities of & decoded."""
    named = lambda tags, link: F.transform(tags, lambda t: F.regexp_extract(t, link, 1))
    every = F.concat(named(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0)), HREF), named(F.regexp_extract_all(html, F.lit(REFRESH_TAG), F.lit(0)), REFRESH_URL))
    return F.transform(every, lambda x: F.regexp_replace(x, "(?i)&(amp|#38|#x26);", "&"))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): alias keys of a page and of what it links to as canonical or by refresh, and of both and their normal forms."""
    url = F.col("url")
    own = pages.select(key_of(url).alias("a"), url, links_of(F.col("html")).alias("links")).where("a is not null")
    linked = own.select("a", url, F.explode("links").alias("link")).where("link <> ''").select("a", key_of(resolved(F.col("link"), url)).alias("b")).where("b is not null")
    linked = materialise(linked.distinct())
    keys = own.select("a").union(linked.select("b")).distinct()
    normal = keys.select("a", normal_key(F.col("a")).alias("b"))
    return linked.union(normal).where("a <> b").distinct()


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, component, decided_by) of each page.

    component is the smallest alias key of the page's component (null without ://); decided_by is rule, alias (a rule
    of another url of the component) or default.
    """
    labels = components(alias_edges(pages))
    url = F.concat(F.lit("://"), F.col("node"))
    decided = labels.withColumn("v", verdict_of(rule_of(host_of(url), path_of(url), rules), rules))
    either = decided.groupBy("component").agg(F.bool_or(F.col("v") == "allow").alias("allowed"), F.bool_or(F.col("v") == "block").alias("blocked"))
    ruled = either.select("component", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("shared")).where("shared is not null")
    aliases = labels.join(ruled, "component", "left").select(F.col("node").alias("alias"), "component", "shared")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("rule"), key_of(F.col("url")).alias("key"))
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.col("shared"), F.lit("allow"))
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("shared").isNotNull(), "alias").otherwise("default")
    found = judged.join(aliases, judged["key"] == aliases["alias"], "left")
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("component", "key").alias("component"), by.alias("decided_by"))


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


_RULE_SQL = """CASE WHEN (h = 'example.org' OR h LIKE '%.example.org') AND starts_with(p, '/en/1') THEN 'example.org/en/1'
      WHEN (h = 'example.org' OR h LIKE '%.example.org') AND starts_with(p, '/es/') THEN 'example.org/es/'
      WHEN (h = 'com' OR h LIKE '%.com') AND starts_with(p, '/de/') THEN 'com/de/'
      WHEN (h = 'com' OR h LIKE '%.com') AND starts_with(p, '/fr/') THEN 'com/fr/'
      WHEN (h = 'org' OR h LIKE '%.org') AND starts_with(p, '/') THEN 'org/' END"""
_VERDICT_SQL = "CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END"
OP4_SQL = rf"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS h, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS p,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') || regexp_extract(url, '://[^/?#]*([^#]*)', 1) END AS k FROM pages),
tag AS (SELECT k, url, h, p, unnest([regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) FOR t IN regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0)]
    || [regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FOR t IN regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0)]) AS raw FROM u WHERE k IS NOT NULL),
parsed AS (SELECT k, h, p, link, regexp_extract(link, '^([^?#]*)', 1) AS target, regexp_extract(link, '^[^?#]*(.*)$', 1) AS rest FROM (SELECT k, h, p, regexp_replace(raw, '(?i)&(amp|#38|#x26);', '&', 'g') AS link FROM tag) WHERE link <> ''),
whole AS (SELECT k, CASE WHEN contains(link, '://') THEN link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(link, '//') THEN 'x:' || link
    WHEN target = '' THEN 'x://' || h || p || rest
    ELSE 'x://' || h || array_to_string(list_reduce(list_prepend([], [[x] FOR x IN string_split(regexp_replace(CASE WHEN starts_with(target, '/') THEN target ELSE regexp_extract(p, '^(.*)/', 1) || '/' || target END, '(^|/)(\.\.?)$', '\1\2/'), '/')]),
        lambda a, b: CASE WHEN b[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[:-2] ELSE a END WHEN b[1] = '.' THEN a ELSE a || b END), '/') || rest END AS link FROM parsed),
linked AS (SELECT DISTINCT k AS a, translate(regexp_extract(link, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') || regexp_extract(link, '://[^/?#]*([^#]*)', 1) AS b FROM whole WHERE contains(link, '://')),
keys AS (SELECT k AS a FROM u WHERE k IS NOT NULL UNION SELECT b FROM linked),
normal AS (SELECT a, regexp_replace(regexp_replace(regexp_extract(a, '^([^/?]*)', 1), '^(www|m)\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_extract(a, '^[^/?]*([^?]*)', 1), '(/index)?\.html?$', ''), '/+$', '')
    || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS b
  FROM (SELECT a, regexp_replace(regexp_replace('&' || regexp_extract(a, '^[^?]*\?(.*)$', 1), '{TRACKING}', '', 'g'), '^&+', '') AS q FROM keys)),
d AS (SELECT a, b FROM linked WHERE a <> b UNION SELECT a, b FROM normal WHERE a <> b),
e AS (SELECT a, b FROM d UNION SELECT b, a FROM d),
r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
n AS (SELECT a, b, translate(regexp_extract(b, '^([^/?]*)', 1), '{UPPER}', '{LOWER}') AS h, regexp_extract(b, '^[^/?]*([^?]*)', 1) AS p FROM r),
v AS (SELECT a, min(b) AS component, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS shared FROM (SELECT a, b, {_VERDICT_SQL} AS v FROM (SELECT a, b, {_RULE_SQL} AS rule FROM n)) GROUP BY a),
j AS (SELECT page_id, h AS host, p AS path, {_RULE_SQL} AS rule, k FROM u)
SELECT page_id, host, path, rule, coalesce({_VERDICT_SQL}, shared, 'allow') AS verdict, coalesce(component, k) AS component,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN shared IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by FROM j LEFT JOIN v ON v.a = j.k
"""
