"""Each stage of the pipeline against brute force, on what its predecessor kept of the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import common, toxicity
from tests.llm import test_jaccard, test_lines
from tests.llm.test_others import brute_leaks, plain_words
from tests.llm.test_packing import _tokenizer

SF = "/root/testdata/sf0.01"


def _rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are missing")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]

    kept = common.materialise(stages["toxicity"](spark, docs, SF))
    scores = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert {i for i, _ in _rows(kept)} == {r["doc_id"] for r in scores if r["score"] < 0.3}

    before = _rows(kept)
    for r in kept.selectExpr("text", "xxhash64(text) v").distinct().collect():
        test_lines._versions[r["text"]] = r["v"]
    own = dict(before)
    expected = [(i, t) for i, t in test_lines.brute(before, 10) if t == own[i] or t.strip()] + [(i, t) for i, t in before if t is None]
    lines = common.materialise(stages["line dedup"](spark, kept, SF))
    assert _rows(lines) == sorted(expected)

    before = _rows(lines)
    single = common.materialise(stages["n-gram Jaccard join"](spark, lines, SF))
    components = {i: c for i, _, c in test_jaccard.brute(before, 5, 80)}
    assert [i for i, _ in _rows(single)] == sorted(i for i, c in components.items() if i == c)

    before = _rows(single)
    items = [(r["item_id"], plain_words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clear = common.materialise(stages["benchmark decontamination"](spark, single, SF))
    held = {d for d, _ in brute_leaks(before, items)}
    assert held and _rows(clear) == [(i, t) for i, t in before if i not in held]

    packed = Counter(r["doc_id"] for r in stages["best-fit packing"](spark, clear, SF).collect() for _ in range(r["length"]))
    assert packed == {i: len(_tokenizer().encode(t or "", add_special_tokens=False).ids) + 1 for i, t in _rows(clear)}
