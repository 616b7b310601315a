"""URL filter: links, normal forms and components against a plain search, and the SQL on the same pages."""

import random
import re
from collections import defaultdict
from posixpath import normpath

import pytest

from tessera.llm import urls

PAGES = "page_id long, url string, html string, node string, key long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "n", 1) for i, u, h in rows], PAGES)


def key(url):
    m = re.match(r"^.*?://([^/?#]*)([^#]*)", url or "", re.S)
    return (m.group(1).lower(), m.group(2)) if m else None


def normal(k):
    host = re.sub(r":(80|443)$", "", re.sub(r"^(www|m)\.", "", k[0]))
    path, _, query = k[1].partition("?")
    for end in (".html", ".htm"):
        if path.endswith(end):
            path = path[: -len(end)]
            path = path[:-6] if path.endswith("/index") else path
            break
    kept = [x for x in query.split("&") if not re.match(r"(utm_[^=]*|ref|fbclid|gclid|sessionid)=", x)]
    query = "&".join(kept).lstrip("&")
    return host, path.rstrip("/") + ("?" + query if query else "")


def target(url, link):
    if "://" in link:
        return link
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", link):
        return None
    scheme, host, path = re.match(r"([^:]*)://([^/?#]*)([^?#]*)", url).groups()
    if link.startswith("//"):
        return f"{scheme}:{link}"
    name, rest = re.match(r"([^?#]*)(.*)", link).groups()
    if not name:
        return f"{scheme}://{host}{path}{rest}"
    joined = name if name.startswith("/") else path.rpartition("/")[0] + "/" + name
    plain = normpath(joined)
    if joined.endswith(("/", "/.", "/..")) and plain != "/":
        plain += "/"
    return f"{scheme}://{host}{plain}{rest}"


def rule_of(host, path):
    best = None
    for rule, verdict in urls.RULES:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def brute(rows, links):
    """(page_id, verdict, component, decided_by) in order; links: those of each page."""
    near = defaultdict(set)
    for (_, url, _), own in zip(rows, links, strict=True):
        if key(url) is None:
            continue
        reached = {key(url)} | {key(t) for x in own if x and (t := target(url, x)) and key(t)}
        for k in reached:
            for x in (k, normal(k)):
                near[key(url)].add(x if k == key(url) else k)
                near[x].add(k)
                near[k].add(x)
                near[k].add(key(url))
    group = {}
    for k in near:
        if k in group:
            continue
        todo, found = [k], {k}
        while todo:
            for x in near[todo.pop()] - found:
                found.add(x)
                todo.append(x)
        verdicts = {rule_of(h, p.partition("?")[0])[1] for h, p in found}
        shared = "allow" if "allow" in verdicts else "block" if "block" in verdicts else None
        for x in found:
            group[x] = (shared, min(h + p for h, p in found))
    out = []
    for i, url, _ in rows:
        k = key(url)
        host, path = (k[0], k[1].partition("?")[0]) if k else ("", "")
        rule, verdict = rule_of(host, path)
        shared, component = group.get(k, (None, None))
        out.append((i, host, path, rule, verdict or shared or "allow", component, "rule" if rule else "alias" if shared else "default"))
    return sorted(out, key=str)


def random_pages(seed):
    rng = random.Random(seed)
    hosts = ["a.example.net", "www.a.example.net", "m.a.example.net", "A.Example.NET:443", "b.com", "www.b.com", "c.example.org", *[f"{x}.net" for x in "defghijk"]]
    paths = ["", "/", "/de/1", "/de/1/", "/de/1.html", "/en/2", "/en/2.html?utm_source=x", "/en/2?ref=y&page=3&utm_id=", "/fr/3?page=2", "/en/index.html", "/es/4#top", "/x/y/z", "/en/17"]
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}"
    rows, links = [], []
    for i in range(60):
        own, parts = [], []
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            x = rng.choice([url(), url().split(":", 1)[1], "../" * rng.randrange(3) + "de/1", "./q", "name.html", "/de/../en/2", "..", "?page=2&amp;ref=1", "?a=1&#38;b=2", "mailto:a@b.com", "/de/1/"])
            own.append((rng.random() < 0.5, x))
        for canonical, x in own:
            parts.append(f'<LINK href="{x}" rel=canonical>' if canonical else f"<meta content='0; URL={x}' http-equiv=refresh>")
        # canonical links come first in the order of links
        links.append([re.sub("&(amp|#38);", "&", x) for c, x in own if c] + [re.sub("&(amp|#38);", "&", x) for c, x in own if not c])
        rows.append((i % 57, url(), None if not own and i % 5 == 0 else "<p>text" + " words".join(parts) + "<a href='/de/9'>nav</a>"))
    rows += [(90, None, "<link rel=canonical href=http://b.com/de/1>"), (91, "no-scheme", None), (92, "", ""), (None, "http://b.com/de/1", "x" * 200_000)]
    return rows, links + [[], [], [], []]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_plain_search(spark, seed):
    rows, links = random_pages(seed)
    found = urls.judge(pages(spark, rows))
    got = sorted([(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["component"], r["decided_by"]) for r in found.collect()], key=str)
    expected = brute(rows, links)
    assert got == expected


def test_sql_on_pages_with_links(spark):
    import duckdb

    rows, _ = random_pages(5)
    found = urls.judge(pages(spark, rows))
    got = sorted([tuple(r) for r in found.select("page_id", "host", "path", "rule", "verdict", "component", "decided_by").collect()], key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    names = "page_id, host, path, rule, verdict, component, decided_by"
    assert got == sorted(con.execute(f"SELECT {names} FROM ({urls.OP4_SQL})").fetchall(), key=str)


def test_blocks_spread_over_normal_forms_and_links(spark):
    rows = [
        (1, "http://www.d.net/en/1.html?utm_source=feed", "<link rel=canonical href='https://b.com/de/7'>"), (2, "https://d.net/en/1/", ""), (3, "https://m.d.net/en/1#top", None),
        (4, "https://d.net/en/2", "<link rel=canonical href='https://b.com/de/7'><link rel=canonical href='https://b.com/fr/7'>"), (5, "https://e.net/en/1", None),
        (6, "https://www.f.net/en/1", "<meta http-equiv=refresh content='0; url=../de/1'>"), (7, "https://f.net/de/1/", None),
    ]
    got = {r["page_id"]: (r["verdict"], r["decided_by"]) for r in urls.judge(pages(spark, rows[:3] + rows[4:5])).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "alias"), 5: ("allow", "default")}
    # a second canonical link to an allowed url frees them all
    got = {r["page_id"]: (r["verdict"], r["decided_by"]) for r in urls.judge(pages(spark, rows)).collect()}
    assert got == {1: ("allow", "alias"), 2: ("allow", "alias"), 3: ("allow", "alias"), 4: ("allow", "alias"), 5: ("allow", "default"), 6: ("allow", "default"), 7: ("allow", "default")}


def test_empty_table(spark):
    assert urls.judge(pages(spark, [(1, "http://a.b/c", "")]).where("false")).count() == 0
