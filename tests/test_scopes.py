import random

import pytest

from tessera.catalogue import QUERIES
from tessera.operators import facts
from tests.joins import all_shuffled, most_joined


def _points(spark, rows):
    return spark.createDataFrame(rows, "point_id long, file string, pos long")


def _scopes(spark, rows):
    return spark.createDataFrame(rows, "scope_id long, file string, start long, end long")


@pytest.mark.parametrize("seed", [1, 2])
def test_innermost_matches_a_plain_search(spark, seed):
    rng = random.Random(seed)
    points = [(i, rng.choice("fg"), rng.randrange(-40, 300)) for i in range(300)] + [(300, None, 5), (301, "f", None), (302, "f", 1 << 40), (303, "f", 7), (303, "g", 9)]
    scopes = []
    for i in range(200):
        start = rng.randrange(-50, 300)
        scopes.append((rng.randrange(1000) * 200 + i, rng.choice("fg"), start, start + rng.choice([-3, 0, 0, 1, 2, 7, 8, 63, 64, 300])))
    scopes += [(5, "f", -(1 << 41), 1 << 41), (6, None, 0, 9), (7, "f", None, 9), (8, "f", 3, None)]
    expected = {}
    for p, file, pos in points:
        if file is None or pos is None:
            continue
        held = [(e - s, -s, i) for i, f, s, e in scopes if f == file and s is not None and e is not None and s <= pos <= e]
        if held:
            expected[p] = min([*held, *([expected[p]] if p in expected else [])])
    found = facts.innermost(_points(spark, points), _scopes(spark, scopes)).collect()
    assert sorted(map(tuple, found)) == sorted((p, best[2]) for p, best in expected.items())


def test_innermost_makes_no_pairs_of_points_and_scopes(spark):
    """300 scopes around 300 points make no 90,000 rows."""
    found = facts.innermost(_points(spark, [(i, "f", 500 + i % 3) for i in range(300)]), _scopes(spark, [(i, "f", i, 1000 - i) for i in range(300)]))
    assert most_joined(found) <= 600
    assert {r["scope_id"] for r in found.collect()} == {299}


def test_return_edges_make_no_pairs_of_returns_and_scopes(spark):
    """300 returns meet ten levels, not 300 scopes; the innermost scope is their method, also where that has no return node."""
    returns = spark.createDataFrame([(i, "f", 500 + i, f"e{i}") for i in range(300)], "point_id long, file string, pos long, expression_node string")
    scopes = [(i, "f", i, 1000 - i, f"r{i}") for i in range(300)] + [(900, "f", 500, 501, None), (901, "f", 510, 512, "inner")]
    found = facts.return_edges(returns, spark.createDataFrame(scopes, "scope_id long, file string, start long, end long, return_node string"))
    assert most_joined(found) <= 3000
    parent = lambda i: None if i < 2 else "inner" if 10 <= i <= 12 else f"r{min(299, 500 - i)}"
    assert sorted(map(tuple, found.collect())) == sorted((parent(i), f"e{i}") for i in range(300) if parent(i))


@pytest.fixture
def shuffled_joins(spark):
    """No join broadcasts a side that the code doesn't name."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_return_edges_move_returns_twice(spark, shuffled_joins):
    """3,000 returns at three places: once to their places, once to their ids, and few rows besides."""
    returns = spark.createDataFrame([(i, "f", 500 + i % 3, f"e{i}") for i in range(3000)], "point_id long, file string, pos long, expression_node string")
    scopes = spark.createDataFrame([(1, "f", 0, 501, "a"), (2, "f", 502, 900, "b")], "scope_id long, file string, start long, end long, return_node string")
    found = facts.return_edges(returns, scopes)
    assert all_shuffled(found) <= 6300
    assert sorted(map(tuple, found.collect())) == sorted(("b" if i % 3 == 2 else "a", f"e{i}") for i in range(3000))


def test_return_edges_are_distinct(spark):
    """A return read twice gives one edge, with two expressions two, at two places one of its innermost scope there; without expression or return node none."""
    rows = [(1, "f", 5, "x"), (1, "f", 5, "x"), (2, "f", 5, "x"), (2, "f", 5, "y"), (3, "f", 5, "z"), (3, "g", 5, "z"), (4, "f", 5, None), (5, "h", 5, "x"), (None, "f", 5, "n")]
    scopes = [(1, "f", 0, 9, "a"), (1, "f", 0, 9, "a"), (2, "g", 4, 6, "b"), (3, "h", 4, 6, None), (4, "h", 0, 9, "c")]
    found = facts.return_edges(spark.createDataFrame(rows, "point_id long, file string, pos long, expression_node string"), spark.createDataFrame(scopes, "scope_id long, file string, start long, end long, return_node string"))
    assert sorted(map(tuple, found.collect())) == [("a", "x"), ("a", "x"), ("a", "y"), ("b", "z")]


@pytest.mark.parametrize("seed", [3, 4])
def test_in_scope_matches_a_plain_search(spark, seed):
    rng = random.Random(seed)
    uses = [(i, rng.choice("fg"), rng.randrange(-20, 200), f"u{i}", rng.choice("st")) for i in range(200)] + [(200, "f", 5, "u", None), (201, None, 5, "u", "s"), (202, "f", None, None, "s")]
    scopes, symbols = [], []
    for i in range(150):
        start = rng.randrange(-30, 200)
        scopes.append((i, rng.choice("fg"), start, start + rng.choice([-2, 0, 1, 5, 31, 64])))
        symbols += [(rng.choice("abcdefgh"), rng.choice("st"), i) for _ in range(rng.randrange(3))]
    symbols += [(None, "s", 0), ("a", None, 1), ("z", "s", 999)]
    at = {i: (f, s, e) for i, f, s, e in scopes}
    expected = []
    for i, file, pos, symbol, kind in uses:
        held = {n for n, t, k in symbols if n is not None and t == kind and k in at and at[k][0] == file and pos is not None and at[k][1] <= pos <= at[k][2]}
        expected.append((i, symbol, sorted(held)))
    found = facts.in_scope(
        spark.createDataFrame(uses, "use_id long, file string, pos long, symbol string, type string"), _scopes(spark, scopes), spark.createDataFrame(symbols, "name string, type string, scope_id long")
    )
    assert sorted((r["use_id"], r["symbol"], r["in_scope"]) for r in found.collect()) == sorted(expected, key=lambda x: x[0])


def test_in_scope_makes_no_pairs_of_uses_and_scopes(spark):
    """300 scopes of two names around 300 uses of three places make no 90,000 rows."""
    uses = spark.createDataFrame([(i, "f", 500 + i % 3, "u", "t") for i in range(300)], "use_id long, file string, pos long, symbol string, type string")
    symbols = spark.createDataFrame([("ab"[i % 2], "t", i) for i in range(300)], "name string, type string, scope_id long")
    found = facts.in_scope(uses, _scopes(spark, [(i, "f", i, 1000 - i) for i in range(300)]), symbols)
    assert most_joined(found) <= 300
    assert {tuple(r["in_scope"]) for r in found.collect()} == {("a", "b")}


def test_scope_entries_make_no_pairs_of_events_and_parts(spark, tmp_path):
    """Of 300 parts around 300 events, entries with both names in order; the event outside has none."""
    spark.createDataFrame([(4000 * i, "TYPE", 50, f"{'ab'[i % 2]}\"x") for i in range(300)], "p_partkey long, p_type string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    events = [(20000 * i + i % 3, 5, "click") for i in range(300)] + [(1500, 5, "view")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["scope_entries"](spark, str(tmp_path))
    assert most_joined(found) <= 300
    assert sorted(map(tuple, found.collect())) == sorted((f"src/f{e}:click", f'"src/f{e}:click":["a\\"x","b\\"x"]') for e, _, kind in events if kind == "click")


def test_scope_entries_leave_events_in_their_tasks(spark, shuffled_joins, tmp_path):
    """3,000 events at two places: their texts come to them, and entries of one text stand together in a task."""
    spark.createDataFrame([(0, "TYPE", 50, "a"), (4000, "TYPE", 1, "b")], "p_partkey long, p_type string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    events = [(20000 * i + i % 2 * 500, 5, "click") for i in range(3000)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["scope_entries"](spark, str(tmp_path))
    assert all_shuffled(found) <= 100
    rows = [(r["key"], r["entry"].split(":", 2)[2]) for r in found.collect()]
    assert sorted(rows) == sorted((f"src/f{e}:click", '["a"]' if e % 20000 else '["a","b"]') for e, _, _ in events)
    assert sum(a[1] != b[1] for a, b in zip(rows, rows[1:], strict=False)) <= 3


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_looked_up_shuffles_what_is_large(spark, shuffled_joins, most):
    rows = [(i, "fg"[i % 2], i % 7) for i in range(300)] + [(300, None, 1), (301, "f", None), (302, "h", 1)]
    texts = [(file, pos, f"t{pos % 3}") for file in "fg" for pos in range(6)]
    found = facts.looked_up(spark.createDataFrame(rows, "id long, file string, pos long"), spark.createDataFrame(texts, "file string, pos long, text string"), ["file", "pos"], "text", most)
    assert (all_shuffled(found) == 0) == (most > 0)
    assert sorted((r["id"], r["text"]) for r in found.collect()) == [(i, f"t{i % 7 % 3}") for i in range(300) if i % 7 < 6]
    none = facts.looked_up(spark.createDataFrame(rows, "id long, file string, pos long"), spark.createDataFrame([], "file string, pos long, text string"), ["file", "pos"], "text", most)
    assert none.collect() == []
