import random
from collections import defaultdict

import pytest

from tessera.llm import jaccard
from tests.llm.conftest import documents, words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(text, k):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and None not in (sets[a][0], sets[b][0]) and 100 * len(x & y) >= percent * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for a in range(len(rows)):
        least[find(a)].append(rows[a][0])
    return sorted((rows[a][0] if rows[a][0] is not None else -1, len(sets[a][1]), min((x for x in least[find(a)] if x is not None), default=-1)) for a in range(len(rows)))


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + rng.randrange(2)] = words(rng, rng.randrange(1, 2))
    return w


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_against_brute_force(spark, awkward, k, percent, seed):
    rng = random.Random(seed)
    texts = list(awkward)
    shared = " ".join(words(rng, 60))
    for g in range(12):
        base = words(rng, rng.choice([6, 40, 150, 400]))
        for c in range(rng.choice([1, 2, 12])):
            copy = edited(rng, base, rng.choice([0, 1, 2, len(base) // 40, len(base) // 25]))
            text = " ".join(copy)
            texts.append((1000 + len(texts), text.upper() if c % 4 == 3 else text + (" " + shared if g % 3 == 0 else "")))
    rng.shuffle(texts)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in jaccard.similarity_classes(documents(spark, texts), k, percent).collect())
    assert got == brute(texts, k, percent)


def test_copies_of_copies_and_one_of_each(spark):
    rng = random.Random(5)
    base = words(rng, 300)
    texts = [" ".join(edited(rng, base, 5)) for _ in range(40)] + [" ".join(base)] * 30 + [" ".join(words(rng, 50))]
    df = documents(spark, texts)
    expected = brute(list(enumerate(texts)), 5, 80)
    left = jaccard.one_of_each(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, _, c in expected})


def test_rows_of_one_id_with_several_texts(spark):
    rng = random.Random(6)
    base = words(rng, 200)
    near, other = " ".join(edited(rng, base, 2)), " ".join(words(rng, 80))
    rows = [(1, " ".join(base)), (5, near), (5, other), (5, near), (None, near), (7, " ".join(base))]
    df = documents(spark, rows).withColumnsRenamed({"node": "id", "key": "version"})
    left = jaccard.one_of_each(df)
    assert left.columns == df.columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in left.collect())) == sorted([(0, near), (1, " ".join(base)), (5, other)])


def test_bitmaps_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (10, 900, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(n * 0.8)], rng.integers(0, 1 << 63, n // 9).astype(np.uint64)]))
        a, b = jaccard.bitmap(x), jaccard.bitmap(y)
        size = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (a, b))
        assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(np.setxor1d(x, y))


def test_empty_table(spark):
    none = documents(spark, ["a"]).where("false")
    assert jaccard.similarity_classes(none).count() == 0 and jaccard.one_of_each(none).count() == 0
