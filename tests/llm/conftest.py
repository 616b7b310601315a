"""Small awkward tables for the training-data operators."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, component string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n)]


def documents(spark, texts):
    """texts: list of text, or of (doc_id, text); further columns clash with names that operators use."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "k", "c") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def awkward():
    """Null, empty and blank texts, non-ASCII text, a long text, repeats, a null id and a repeated id."""
    rng = random.Random(1)
    long = " ".join(words(rng, 30_000))
    return [(0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, "Ünï çødé x"), (5, long), (6, long), (6, "other text under one id"), (None, "text without id"), (None, None), (9, "b c d\ne f"), (9, "b c d\ne f")]
