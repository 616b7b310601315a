import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import linededup
from tests.llm.conftest import documents, words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_patience_matches_equal_lines_in_order(x, y):
    found = linededup.patience(x, y)
    assert all(x[i] == y[j] for i, j in found)
    assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))


def test_patience_anchors():
    assert linededup.patience(list("abcXde"), list("abYcde")) == [(0, 0), (1, 1), (2, 3), (4, 4), (5, 5)]


def canonical(line):
    return tuple(line.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split())


def runs(lines, min_words):
    """(first line, last line, words) of the runs that have min_words words and none to spare on one side or the other."""
    n = [len(x) for x in lines]
    for a in range(len(lines)):
        for z in range(a, len(lines)):
            if sum(n[a : z + 1]) >= min_words and (sum(n[a:z]) < min_words or sum(n[a + 1 : z + 1]) < min_words):
                yield a, z, tuple(lines[a : z + 1])


def brute(rows, min_words):
    """Text by row: a line goes if a run of lines around it stands in an earlier document."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None}, key=lambda d: (d[0], version(d[1])))
    seen, gone = set(), defaultdict(set)
    for d in docs:
        places = [(p, canonical(x)) for p, x in enumerate(d[1].split("\n")) if canonical(x)]
        own = list(runs([x for _, x in places], min_words))
        for a, z, words_ in own:
            if words_ in seen:
                gone[d] |= {p for p, _ in places[a : z + 1]}
        seen |= {words_ for _, _, words_ in own}
    return sorted((i if i is not None else -1, t if t is None or not gone[i, t] else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i, t])) for i, t in rows if t is not None)


_versions = {}


def version(text):
    return _versions[text]


def test_against_brute_force(spark, awkward):
    rng = random.Random(9)
    pool = [" ".join(words(rng, rng.choice([2, 4, 12, 60]))) for _ in range(25)]
    texts = list(awkward)
    for i in range(60):
        own = [" ".join(words(rng, 8)) for _ in range(rng.randrange(4))]
        picked = [rng.choice(pool) for _ in range(rng.randrange(5))]
        if i % 3 == 0:
            a = rng.randrange(20)
            picked += pool[a : a + 4]
        lines = own + picked
        if i % 2:
            rng.shuffle(lines)
        texts.append((100 + i % 55, "\n".join(lines).upper() if i % 7 == 0 else "\n".join(lines)))
    df = documents(spark, texts)
    for r in df.selectExpr("text", "xxhash64(text) v").distinct().collect():
        _versions[r["text"]] = r["v"]
    out = linededup.dedup(df, min_words=10)
    assert out.columns == df.columns
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in out.where("text is not null").collect())
    assert got == brute(texts, 10)
    assert out.where("text is null").count() == sum(t is None for _, t in texts)


def test_passages_go_from_the_later_document(spark):
    rng = random.Random(2)
    passage = " ".join(words(rng, 55))
    short = "see also"
    df = documents(spark, [f"one of its own\n{passage}\n{short}", f"{short}\nanother opening\n{passage}\nits end", "nothing shared here at all"])
    got = {r["doc_id"]: (r["text"], r["gone"]) for r in linededup.dedup(df, n_deleted="gone").collect()}
    assert got[0] == (f"one of its own\n{passage}\n{short}", 0)
    assert got[1] == (f"{short}\nanother opening\nits end", 1)
    assert got[2] == ("nothing shared here at all", 0)


def test_empty_table(spark):
    assert linededup.dedup(documents(spark, ["a"]).where("false")).count() == 0


def plain_patience(x, y):
    """Matched places by the definition, recursively, one anchor sequence a call."""
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    if k:
        return [(i, i) for i in range(k)] + [(i + k, j + k) for i, j in plain_patience(x[k:], y[k:])]
    while k < min(len(x), len(y)) and x[-1 - k] == y[-1 - k]:
        k += 1
    if k:
        return plain_patience(x[: len(x) - k], y[: len(y) - k]) + [(len(x) - k + i, len(y) - k + i) for i in range(k)]
    both = sorted((y.index(v), x.index(v)) for v in set(x) & set(y) if x.count(v) == 1 == y.count(v))
    longest = []
    for j, i in both:
        longest.append(max((s for s in longest if s[-1][0] < i), key=len, default=[]) + [(i, j)])
    anchors = max(longest, key=len, default=[])
    out, a, c = [], 0, 0
    for i, j in [*anchors, (len(x), len(y))] if anchors else []:
        out += [(a + p, c + q) for p, q in plain_patience(x[a:i], y[c:j])] + ([(i, j)] if i < len(x) else [])
        a, c = i + 1, j + 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=12), st.lists(st.integers(0, 9), max_size=12))
def test_patience_against_the_definition(x, y):
    """Of several longest sequences of anchors any may be taken; without a choice both match the same lines."""
    once = [y.index(v) for v in x if x.count(v) == 1 == y.count(v)]
    picks = [[once[k] for k in range(len(once)) if m >> k & 1] for m in range(1 << len(once))]
    rising = [len(p) for p in picks if all(a < b for a, b in zip(p, p[1:]))]
    assert len(linededup.increasing(once)) == max(rising)
    if rising.count(max(rising)) == 1 and len(once) == len(set(x) & set(y)):
        assert linededup.patience(x, y) == sorted(plain_patience(x, y))


def all_pairs(rows, min_words):
    """Lines by (doc_id, text) that go if every earlier document is aligned with every later one, by the plain form."""
    docs = sorted(set(rows))
    lines = {d: [(p, canonical(x)) for p, x in enumerate(d[1].split("\n")) if canonical(x)] for d in docs}
    out = {}
    for k, d in enumerate(docs):
        gone, y = set(), [v for _, v in lines[d]]
        for e in docs[:k]:
            before, block = (-9, -9), []
            for i, j in [*plain_patience([v for _, v in lines[e]], y), (-5, -5)]:
                if (i, j) != (before[0] + 1, before[1] + 1):
                    gone |= {lines[d][q][0] for q in block} if sum(len(y[q]) for q in block) >= min_words else set()
                    block = []
                block.append(j)
                before = (i, j)
        out[d] = gone
    return out


def test_blocks_that_the_earliest_holder_has_in_another_order(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(words(rng, 12)) for _ in range(3))
    texts = [f"{b}\nx\n{c}\ny\n{a}", f"one\n{a}", "nothing", f"two\n{b}", f"three\n{c}", f"{a}\nof its own\n{b}\nagain\n{c}"]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(documents(spark, texts)).collect()}
    assert got[5] == "of its own\nagain"


def test_what_any_alignment_deletes_goes(spark):
    rng = random.Random(12)
    pool = [" ".join(words(rng, rng.choice([1, 2, 4, 9, 12]))) for _ in range(14)]
    texts = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(90)]
    for _, t in texts:
        _versions.setdefault(t, 0)
    found = linededup.dedup(documents(spark, texts), n_deleted="n", n_checked="n_left").collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == brute(texts, 10)
    for d, gone in all_pairs(texts, 10).items():
        kept = next(r["text"] for r in found if (r["doc_id"],) == d[:1])
        assert len(gone) <= next(r["n"] for r in found if r["doc_id"] == d[0])
        assert not gone or len(kept.split("\n")) <= len(d[1].split("\n")) - len(gone) or kept == ""
    # most lines go by alignment
    assert 0 < sum(r["n_left"] for r in found) < 0.5 * sum(r["n"] for r in found)


def test_single_words_and_short_lines(spark):
    texts = ["a b\nc", "c\n\na b\nd", "d\nc", "C"]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(documents(spark, texts), min_words=1).collect()}
    assert got == {0: "a b\nc", 1: "\nd", 2: "", 3: ""}


def test_a_line_that_all_documents_hold(spark):
    """One page is the partner of all: its lines are sent to several tasks."""
    rng = random.Random(5)
    banner = " ".join(words(rng, 15))
    texts = [f"{banner}\nfirst"] + [f"own {i}\n{banner}\nend {i}" for i in range(3000)]
    found = linededup.dedup(documents(spark, texts), n_deleted="n").orderBy("doc_id").collect()
    assert [r["n"] for r in found] == [0] + [1] * 3000 and found[9]["text"] == "own 8\nend 8"


def test_columns_of_clashing_names(spark):
    rng = random.Random(3)
    passage = " ".join(words(rng, 30))
    own = ["id", "version", "gone", "checked", "_gone", "_d", "_v", "_n_deleted", "n_deleted", "own", "cut", "key", "ID_"]
    df = spark.createDataFrame([(i, passage, *own) for i in ("b", "a", None)], "doc_id string, text string, " + ", ".join(f"`{c}` string" for c in own))
    out = linededup.dedup(df, n_deleted="lost")
    assert out.columns == [*df.columns, "lost"]
    rows = out.collect()
    assert {r["doc_id"]: (r["text"], r["lost"]) for r in rows} == {"a": (passage, 0), "b": ("", 1), None: (passage, 0)}
    assert all(tuple(r)[2:-1] == tuple(own) for r in rows)
    with pytest.raises(ValueError):
        linededup.dedup(df, n_deleted="N_DELETED")
