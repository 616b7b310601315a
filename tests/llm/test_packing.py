import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing
from tests.llm.conftest import documents, words


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_tokenizers_file(text):
    full, ranks, pattern = packing.public_paths()
    expected = Tokenizer.from_file(full).encode(text, add_special_tokens=False).ids if "<|" in text else _tokenizer().encode(text, add_special_tokens=False).ids
    assert packing.encoder(full, ranks, pattern)(text).tolist() == expected


_held = []


def _tokenizer():
    if not _held:
        _held.append(Tokenizer.from_file(packing.public_paths()[0]))
    return _held[0]


def test_special_strings():
    full, ranks, pattern = packing.public_paths()
    text = "a<|endoftext|>b"
    assert packing.encoder(full, ranks, pattern)(text).tolist() == _tokenizer().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("documents_", "attention"), [(None, None), (4, None), (None, 300_000), (3, 400_000)])
def test_plan_holds_every_capacity(rule, documents_, attention):
    rng = random.Random(7)
    histogram = Counter(rng.choice([rng.randrange(1, 500), rng.randrange(1, 30)]) for _ in range(3000))
    placed = packing.plan(histogram, 1024, documents_, attention, rule)
    bins = defaultdict(list)
    for length, n in histogram.items():
        rows = placed[length]
        for rank in range(n):
            r = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
            over = rank - r[0]
            bins[int(r[2] + over // r[1])].append((int(r[3] + over % r[1] * length), length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024 and len(held) <= (documents_ or 1024) and sum(x * x for _, x in held) <= (attention or 1 << 20)
    if documents_ is None and attention is None:
        assert len(bins) <= -(-sum(k * n for k, n in histogram.items()) // 1024) + 2


def test_plan_rejects_what_fits_nowhere():
    with pytest.raises(ValueError):
        packing.plan({600: 1}, attention=1000)


def test_pack_against_the_tokenizer(spark, awkward):
    rng = random.Random(3)
    texts = awkward + [(100 + i, " ".join(words(rng, rng.choice([5, 60, 700, 2500])))) for i in range(30)]
    rows = packing.pack(documents(spark, texts)).collect()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    expected = defaultdict(list)
    for i, t in texts:
        ids = np.array([*_tokenizer().encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        expected[i] += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= -(-sum(r["length"] for r in rows) // 1024) + 3


def test_pack_empty_table(spark):
    assert packing.pack(documents(spark, ["a"]).where("false")).count() == 0
