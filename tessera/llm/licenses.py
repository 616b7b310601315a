"""Operator 1: license scans by patience alignment with notice and license templates.

Words are runs of ASCII letters and digits or other bytes above 127, lower-cased. A document is a
candidate for a template if it holds enough of the template's distinct words to reach the coverage (a
bound that loses nothing). For each place where the template may lie, the words unique to both text and
template anchor the alignment, the longest increasing subsequence of anchors stays and gaps are aligned in
the same way, those without unique words by their longest common subsequence; coverage is the share of the template's words that are matched.

A place is a window of the document around an occurrence of one of the template's rarest words there, as the
word's place in the template says; it has the template's length, then `slack` words more on either side. So many words are
taken, rarest first, that a copy with the coverage can't lack them all, and all their occurrences are tried. A
window in which the alignment falls short, as many words are put in between (comment leaders), is tried with a quarter
and a half of the template's length more on either side; one in which it is reached is widened in the same way as long
as it matches more words, one in three of what it takes in at least (else they are another copy's). Of overlapping copies of one template that with most matched words stays.

Defined results: null and empty texts match nothing and give a row without licenses; every document gives one
row, repeated rows each; of overlapping matches those contained in one with more matched words are left
out (ties: the template with the greater coverage, then the first); texts are scanned whole, however long; other columns are
not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ALPHANUMERIC, map_arrow, table, text_chunks, word_hashes
from tessera.llm.linededup import patience, subsequence

COVERAGE, SLACK = 0.85, 8

#: Public license notices and texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
}


def words_of(text: str) -> np.ndarray:
    raw = text.encode()
    return word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALPHANUMERIC)[0]


@dataclass
class Scanner:
    names: list[str]
    words: list[list[int]]  # of templates: places in the vocabulary
    vocabulary: np.ndarray  # sorted hashes
    incidence: np.ndarray  # (vocabulary, templates)
    needed: np.ndarray  # distinct words that a text must hold to reach the coverage

    @classmethod
    def of(cls, templates: dict[str, str], coverage: float) -> Scanner:
        hashed = {n: words_of(t) for n, t in templates.items()}
        vocabulary = np.unique(np.concatenate([*hashed.values(), np.empty(0, np.uint64)]))
        words = [np.searchsorted(vocabulary, h).tolist() for h in hashed.values()]
        incidence = np.zeros((len(vocabulary), len(words)), np.int64)
        needed = []
        for k, w in enumerate(words):
            incidence[w, k] = 1
            # the fewest distinct words whose occurrences in the template add up to the coverage
            most = np.cumsum(np.sort(np.unique(w, return_counts=True)[1])[::-1])
            needed.append(int(np.searchsorted(most, np.ceil(coverage * len(w) - 1e-9)) + 1))
        return cls(list(templates), words, vocabulary, incidence, np.array(needed))


def align(template: list[int], text: list[int]) -> tuple[int, int, int]:
    """(matched words, first and last matched place in the text) of the patience alignment."""
    matched = patience(template, text, subsequence)
    return (len(matched), matched[0][1], matched[-1][1]) if matched else (0, 0, 0)


def scan(words: list[int], counts: np.ndarray, template: list[int], coverage: float, slack: int) -> list[tuple[int, int, int]]:
    """(matched, first, last place) of a template in a document; words are vocabulary places or -1, counts theirs in the document."""
    least = int(np.ceil(coverage * len(template) - 1e-9))
    offsets: dict[int, list[int]] = {}
    for i, w in enumerate(template):
        offsets.setdefault(w, []).append(i)
    anchors: set[int] = set()
    spare = len(template) - least
    for w in sorted(offsets, key=lambda w: (counts[w], w)):
        if spare < 0:
            break
        anchors.add(w)
        spare -= len(offsets[w])
    text = np.asarray(words)
    inside = np.concatenate([[0], np.cumsum(np.isin(text, template))])
    tried: set[tuple[int, int]] = set()
    hits: list[tuple[int, int, int]] = []
    whole = (0, -1)  # first and last place of the latest complete copy

    wider = [0, slack, slack + len(template) // 4, slack + len(template) // 2, slack + len(template)]

    def attempt(a: int, z: int) -> bool:
        """Whether the copy at words a to z (estimated) is there."""
        nonlocal whole
        best = (0, 0, 0)
        for k, more in enumerate(wider):
            p, q = max(0, a - more), min(len(words), z + more)
            if best[0] == 0 and k == len(wider) - 1 or (p, q) in tried or inside[q] - inside[p] < least:
                continue
            tried.add((p, q))
            n, first, last = align(template, words[p:q])
            if best[0] and (n <= best[0] or 3 * (n - best[0]) < last - first - (best[2] - best[1])):
                break
            if n >= least:
                best = (n, p + first, p + last)
                if n == len(template):
                    break
        if not best[0]:
            return False
        hits.append(best)
        if best[0] == len(template) == best[2] - best[1] + 1:
            whole = best[1:]
        return True

    for at in np.flatnonzero(np.isin(text, list(anchors))).tolist():
        if whole[0] <= at <= whole[1]:
            continue
        own = offsets[words[at]]
        found = [attempt(at - o, at - o + len(template)) for o in own]
        if len(own) > 1 and not any(found):
            attempt(at - own[-1], at - own[0] + len(template))
    out: list[tuple[int, int, int]] = []
    for h in sorted(hits, key=lambda h: (-h[0], h[2] - h[1], h[1])):
        if all(h[2] < o[1] or o[2] < h[1] for o in out):
            out.append(h)
    return sorted(out, key=lambda h: h[1])


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, slack: int = SLACK) -> DataFrame:
    """(doc_id, n_licenses, licenses, best_coverage, matches) of each document; matches are (license, coverage, first and last word)."""
    scanner = Scanner.of(templates or TEMPLATES, coverage)
    match = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def found(words: np.ndarray, held: np.ndarray) -> list[dict]:
        hits: list[tuple] = []
        counts = np.bincount(held[held >= 0], minlength=len(scanner.vocabulary))
        present = (counts > 0).astype(np.int64)
        own = held.tolist()
        for k in np.flatnonzero(present @ scanner.incidence >= scanner.needed):
            t = scanner.words[k]
            hits += [(n, a, z, k, n / len(t)) for n, a, z in scan(own, counts, t, coverage, slack)]
        hits.sort(key=lambda h: (-h[0], -h[4], h[1], h[3]))
        kept: list[tuple] = []
        for h in hits:
            if not any(o[1] <= h[1] and h[2] <= o[2] for o in kept):
                kept.append(h)
        kept.sort(key=lambda h: (h[1], h[3]))
        return [{"license": scanner.names[k], "coverage": c, "first_word": a, "last_word": z} for _, a, z, k, c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for at, to, data, offsets in text_chunks(b.column(1)):
                words, _, bounds = word_hashes(data, offsets, ALPHANUMERIC)
                place = np.minimum(np.searchsorted(scanner.vocabulary, words), len(scanner.vocabulary) - 1)
                held = np.where(scanner.vocabulary[place] == words, place, -1)
                text = np.repeat(np.arange(to - at), np.diff(bounds))
                present = np.zeros((to - at, len(scanner.vocabulary)), np.int64)
                present[text[held >= 0], held[held >= 0]] = 1
                for i in np.flatnonzero((present @ scanner.incidence >= scanner.needed).any(1)).tolist():
                    rows[at + i] = found(words[bounds[i] : bounds[i + 1]], held[bounds[i] : bounds[i + 1]])
            names = [",".join(sorted({m["license"] for m in r})) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array(names), pa.array([max((m["coverage"] for m in r), default=0.0) for r in rows]), pa.array(rows, pa.list_(match))],
                ["doc_id", "n_licenses", "licenses", "best_coverage", "matches"],
            )

    return map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, n_licenses long, licenses string, best_coverage double, matches array<struct<license: string, coverage: double, first_word: long, last_word: long>>")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
