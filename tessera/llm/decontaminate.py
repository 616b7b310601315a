"""Operator 9: benchmark decontamination by latent semantic retrieval.

1. Inverse document frequencies of hashed terms over all documents. A term that no item has weighs at most
   FOREIGN times what the items' terms do on the whole: else rare words around a copy of an item, whose weights grow with
   the corpus, would hide it.
2. The index: TF-IDF passages of the benchmark (PASSAGE words each, by half steps) and a randomised SVD of
   them. Range finder and power steps are distributed: each task adds up A^T (A Q) of its passages, the sums are added by
   term in Spark, and only the factor, terms of the benchmark by rank, is orthonormalised on the driver.
3. Search: every document's passages are folded into the latent space; their cosine with each benchmark
   passage gives candidates. All documents and passages are searched. A passage is left out only where its terms
   that some item has make up less than the cosine's share of its length: a bound on its cosine with any item.
4. Checks: a candidate item is confirmed on the words around the passage by the share of the item in the
   longest common subsequence, and by its answer, the item's last ANSWER words (or the column `answer`):
   either the subsequence covers `sure` of the item, or `likely` of it with half of the answer's words. Each
   passage is checked; of those that pass, the one of greatest share is told.

Items of fewer than SHORT words have no passage to compare: they match where a document holds all of their words as one
run (and, with a column `answer`, half of the answer's words).

The latent index and the benchmark's words are broadcast in slices of SLICE_WORDS words (about 40 bytes a word), one pass over
the documents each; the benchmark is held to MAX_ITEM_WORDS words in all (an error beyond it). Both are of the
benchmark's size, not of the corpus's.

Defined results: null and empty texts and items match nothing; repeated rows are each judged; items of equal text are
each told; ties between passages go to the greater answer, then cosine; null doc_ids are carried; ids of items may have any type; texts
are read whole, however long; other columns pass through whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tessera.llm.common import ALPHANUMERIC, map_arrow, shingle_hashes, table, text_chunks, word_hashes

TERM_BITS, RANK, STEP, POWER, SLICES = 18, 128, 16, 2, 16
PASSAGE = 2 * STEP
COSINE, SURE, LIKELY, ANSWER, SHORT, SLICE_WORDS, MAX_ITEM_WORDS = 0.45, 0.75, 0.5, 6, 8, 2_000_000, 20_000_000
FOREIGN = 0.5
#: Document passages, and benchmark passages, of one product.
ROWS, COLUMNS = 1024, 16_384
_U = np.uint64


@dataclass
class Index:
    """A slice of the benchmark."""

    places: np.ndarray  # of hashed terms: row of the projection, -1 for those of no item
    projection: np.ndarray  # of the items' terms, weighted by idf, and a last row of zeros: float32
    squares: np.ndarray  # of terms: weight squared
    vectors: np.ndarray  # of benchmark passages, scaled so that a passage's product with itself is its length
    items: np.ndarray  # of those passages: place of the item
    ids: list  # of items
    words: list[np.ndarray]  # of items: word hashes
    answers: list[np.ndarray]
    stated: list[bool]  # of items: whether the answer is a column's
    short: dict[int, dict[int, list[int]]] = field(default_factory=dict)  # number of words -> hash of the run -> places of items


def _terms(words: np.ndarray) -> np.ndarray:
    return (words >> _U(64 - TERM_BITS)).astype(np.int64)


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << TERM_BITS) // SLICES + 1, np.int64)
    for b in batches:
        for c in b.column(b.schema.get_field_index("counts")):
            total += np.frombuffer(c.as_py(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with each hashed term, documents), over all texts; vectors of fixed size (2 MB) are added up in two steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << TERM_BITS, np.int64), 0
        for b in batches:
            for at, to, data, offsets in text_chunks(b.column(0)):
                words, _, bounds = word_hashes(data, offsets, ALPHANUMERIC)
                n += to - at
                held = np.sort(np.repeat(np.arange(to - at), np.diff(bounds)) << TERM_BITS | _terms(words))
                first = np.append(True, held[1:] != held[:-1]) if len(held) else np.zeros(0, bool)
                total += np.bincount(held[first] & ((1 << TERM_BITS) - 1), minlength=1 << TERM_BITS)
        parts = [np.append(p, n if k == 0 else 0).astype("<i8").tobytes() for k, p in enumerate(total.reshape(SLICES, -1))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts, pa.binary())], ["slice", "counts"])

    slices = map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "slice int, counts binary").withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(16)))
    first = slices.groupBy("slice", "salt").applyInArrow(_added, "slice int, counts binary")
    out, n = np.zeros((SLICES, (1 << TERM_BITS) // SLICES), np.int64), 0
    for r in first.groupBy("slice").applyInArrow(_added, "slice int, counts binary").collect():
        counts = np.frombuffer(r["counts"], "<i8")
        out[r["slice"]], n = counts[:-1], n + int(counts[-1])
    return out.ravel(), n


def _passages(n: int) -> list[tuple[int, int]]:
    """Word ranges of a text's passages: PASSAGE words by half steps; the last one is whole as well."""
    if n <= PASSAGE:
        return [(0, n)] if n else []
    return [(a, a + PASSAGE) for a in range(0, n - PASSAGE, STEP)] + [(n - PASSAGE, n)]


def range_finder(items: DataFrame, places: np.ndarray, idf: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Orthonormal (item terms, rank): the leading right singular vectors of the items' TF-IDF passages, by randomised power steps."""
    size = int(places.max(initial=-1)) + 1
    rank = max(1, min(rank, size))
    q = np.random.default_rng(seed).standard_normal((size, rank)).astype(np.float32)
    for _ in range(POWER + 1):

        def run(batches: Iterator[pa.RecordBatch], q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, rank), np.float32)
            for b in batches:
                for _, _, data, offsets in text_chunks(b.column(0)):
                    words, _, bounds = word_hashes(data, offsets, ALPHANUMERIC)
                    terms = _terms(words)
                    for a, z in zip(bounds, bounds[1:], strict=False):
                        for x, y in _passages(z - a):
                            t, tf = np.unique(terms[a + x : a + y], return_counts=True)
                            row = tf * idf[t]
                            row = row / (np.linalg.norm(row) or 1)
                            at = places[t]
                            row, at = row[at >= 0], at[at >= 0]
                            total[at] += np.outer(row, row @ q[at]).astype(np.float32)
            some = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.FixedSizeListArray.from_arrays(pa.array(total[some].ravel()), rank).cast(pa.list_(pa.float32()))], ["term", "row"])

        sums = map_arrow(items.select("text"), run, "term long, row array<float>")
        sums = sums.withColumn("part", F.pmod("term", F.lit(SLICES))).groupBy("part").applyInArrow(_summed, "term long, row array<float>").toArrow()
        total = np.zeros((size, rank))
        if len(sums):
            total[sums["term"].to_numpy()] = np.stack(sums["row"].to_numpy(zero_copy_only=False))
        factor, _ = np.linalg.qr(total)
        q = factor.astype(np.float32)
    return q


def _summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal term added up."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for t, row in zip(b.column("term").to_pylist(), b.column("row"), strict=True):
            own = row.values.to_numpy()
            total[t] = total[t] + own if t in total else own.astype(np.float64)
    terms = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array([total[t].astype(np.float32) for t in terms], pa.list_(pa.float32()))], ["term", "row"])


def build(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, slice_words: int = SLICE_WORDS) -> list[Index]:
    """Fit weights on all documents and the latent space on all items: an index for each slice of the benchmark."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None)
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"), answer.cast("string").alias("answer")).where("text is not null")
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    if size > MAX_ITEM_WORDS:
        raise ValueError(f"the benchmark has {size} words; {MAX_ITEM_WORDS} are the most")
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32)
    rows = []
    for row in items.orderBy("item_id", "text").toLocalIterator():
        hashed = []
        for text in (row["text"], row["answer"] or ""):
            raw = text.encode()
            hashed.append(word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALPHANUMERIC)[0])
        if len(hashed[0]):
            rows.append((row["item_id"], *hashed))
    known = np.unique(_terms(np.concatenate([np.empty(0, _U), *[r[1] for r in rows]])))
    every = np.full(1 << TERM_BITS, -1, np.int32)
    every[known] = np.arange(len(known))
    if len(known):
        foreign = every < 0
        idf[foreign] = np.minimum(idf[foreign], FOREIGN * np.sqrt((idf[known] ** 2).mean()))
    factor = range_finder(items, every, idf, rank)
    out: list[Index] = []
    at = 0
    while at < len(rows):
        to, held = at + 1, len(rows[at][1])
        while to < len(rows) and held + len(rows[to][1]) <= slice_words:
            held += len(rows[to][1])
            to += 1
        out.append(_slice(rows[at:to], every, factor, idf))
        at = to
    return out


def _slice(rows: list[tuple], every: np.ndarray, factor: np.ndarray, idf: np.ndarray) -> Index:
    squares = idf**2
    places = np.full(1 << TERM_BITS, -1, np.int32)
    known = np.unique(_terms(np.concatenate([r[1] for r in rows])))
    places[known] = np.arange(len(known))
    projection = np.vstack([factor[every[known]] * idf[known][:, None], np.zeros((1, factor.shape[1]))]).astype(np.float32)
    vectors, owners, ids, held, answers, given = [], [], [], [], [], []
    short: dict[int, dict[int, list[int]]] = {}
    for item, words, stated in rows:
        if len(words) < SHORT:
            run = shingle_hashes(words, np.array([0, len(words)]), len(words))[0]
            short.setdefault(len(words), {}).setdefault(int(run[0]), []).append(len(ids))
        else:
            for x, y in _passages(len(words)):
                terms, times = np.unique(_terms(words[x:y]), return_counts=True)
                v = (times[:, None] * projection[places[terms]]).sum(0)
                # the latent space keeps a part of the vector; dividing by that part makes products estimates of cosines
                if (kept := float(v @ v)) > 1e-9:
                    vectors.append(v * np.sqrt((times * times * squares[terms]).sum()) / kept)
                    owners.append(len(ids))
        ids.append(item)
        held.append(words)
        given.append(len(stated) > 0)
        answers.append(np.unique(stated if len(stated) else words[-ANSWER:]))
    matrix = np.array(vectors, np.float32).reshape(len(vectors), projection.shape[1])
    return Index(places, projection, squares, matrix, np.array(owners, np.int64), ids, held, answers, given, short)


def common_subsequence(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit vectors over x."""
    masks: dict[int, int] = {}
    for i, w in enumerate(x.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for w in y.tolist():
        if m := masks.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(x) - row.bit_count()


def short_matches(words: np.ndarray, bounds: np.ndarray, index: Index) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, 1, 1, share of the answer) of the items that a text holds as one run of words."""
    for size, known in index.short.items():
        runs, to = shingle_hashes(words, bounds, size)
        keys = np.array(sorted(known), _U)
        hits = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, runs), len(keys) - 1)] == runs)
        text = np.searchsorted(to, hits, "right") - 1
        hits, text = hits[np.diff(bounds)[text] >= size], text[np.diff(bounds)[text] >= size]
        for t, run in sorted(set(zip(text.tolist(), runs[hits].tolist(), strict=True))):
            for item in known[run]:
                yield t, item, 1.0, 1.0, float(np.isin(index.answers[item], words[bounds[t] : bounds[t + 1]]).mean()) if index.stated[item] else 1.0


def matches(words: np.ndarray, bounds: np.ndarray, index: Index, cosine: float, sure: float, likely: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, cosine, share of the item in the subsequence, share of the answer) of the confirmed matches of a run of texts."""
    if not len(words) or not len(index.ids):
        return
    for text, item, cos, share, answer in short_matches(words, bounds, index):
        if not index.stated[item] or answer >= 0.5:
            yield text, item, cos, share, answer
    if not len(index.vectors):
        return
    counts = np.diff(bounds)
    blocks = -(-counts // STEP)
    edges = np.concatenate([[0], np.cumsum(blocks)])
    owner = np.repeat(np.arange(len(counts)), blocks)
    starts = bounds[owner] + (np.arange(edges[-1]) - edges[owner]) * STEP
    ends = np.minimum(starts + PASSAGE, bounds[owner + 1])
    terms = _terms(words).astype(np.int32)
    place = index.places[terms]
    # only passages with a word of an item
    some = np.flatnonzero(np.logical_or.reduceat(place >= 0, starts))
    some = np.union1d(some, (some - 1)[(some > 0) & (owner[some] == owner[some - 1])]) if len(some) else some
    zero = len(index.projection) - 1
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    done: set[tuple[int, int]] = set()
    for at in range(0, len(some), ROWS):
        cut = some[at : at + ROWS]
        spot = starts[cut, None] + np.arange(PASSAGE)
        inner = spot < ends[cut, None]
        spot = np.minimum(spot, len(place) - 1)
        term, row = np.where(inner, terms[spot], -1), np.where(inner, place[spot], -1)
        # squared lengths: each word's weight times the occurrences of its term
        weight = np.where(inner, index.squares[term], 0) * (term[:, :, None] == term[:, None, :]).sum(2, dtype=np.uint8)
        length = weight.sum(1)
        own = np.where(row >= 0, weight, 0).sum(1)
        keep = np.flatnonzero((own > 0) & (own >= cosine * cosine * length * (1 - 1e-6)))
        if not len(keep):
            continue
        cut, row = cut[keep], row[keep]
        latent = index.projection[np.where(row < 0, zero, row)].sum(1) / np.sqrt(length[keep])[:, None]
        for left in range(0, len(index.vectors), COLUMNS):
            near = latent @ index.vectors[left : left + COLUMNS].T
            rows, columns = np.nonzero(near >= cosine)
            for r, c in zip(rows.tolist(), columns.tolist(), strict=True):
                block, item = int(cut[r]), int(index.items[left + c])
                text = int(owner[block])
                x = index.words[item]
                if (block, item) in done:
                    continue
                done.add((block, item))
                a = max(int(bounds[text]), int(starts[block]) - len(x))
                z = min(int(bounds[text + 1]), int(starts[block]) + PASSAGE + len(x))
                y = words[a:z]
                # the subsequence is at most the words that both have
                if np.isin(x, y).sum() < min(likely, sure) * len(x):
                    continue
                share, answer = common_subsequence(x, y) / len(x), float(np.isin(index.answers[item], y).mean())
                if share >= sure or share >= likely and answer >= 0.5:
                    best[text, item] = max(best.get((text, item), (0.0, 0.0, 0.0)), (share, answer, float(near[r, c])))
        done.clear()
    for (text, item), (share, answer, cos) in best.items():
        yield text, item, cos, share, answer


def search(docs: DataFrame, index: list[Index], cosine: float = COSINE, sure: float = SURE, likely: float = LIKELY) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer) of each confirmed match of a document with an item."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = pa.array([i for part in index for i in part.ids])
    item_type = pa.int64() if pa.types.is_null(ids.type) else ids.type
    item_kind = from_arrow_type(item_type).simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {kind}, item_id {item_kind}, cosine double, lcs double, answer double"

    def found(part: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows: list[tuple] = []
                for at, _, data, offsets in text_chunks(b.column(1)):
                    words, _, bounds = word_hashes(data, offsets, ALPHANUMERIC)
                    rows += sorted((at + text, item, cos, share, answer) for text, item, cos, share, answer in matches(words, bounds, part, cosine, sure, likely))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([part.ids[r[1]] for r in rows], item_type), *[pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3, 4)]],
                    ["doc_id", "item_id", "cosine", "lcs", "answer"],
                )

        return map_arrow(texts, run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    parts = [found(p) for p in index]
    for p in parts:
        out = p if len(parts) == 1 else out.unionByName(p)
    return out


def keep_uncontaminated(docs: DataFrame, index: list[Index], cosine: float = COSINE, sure: float = SURE, likely: float = LIKELY) -> DataFrame:
    """The rows of docs, with all their columns, that match no item."""
    place = docs.columns.index("text")

    def kept(part: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for at, _, data, offsets in text_chunks(b.column(place).cast(pa.string())):
                    words, _, bounds = word_hashes(data, offsets, ALPHANUMERIC)
                    for text, *_ in matches(words, bounds, part, cosine, sure, likely):
                        keep[at + text] = False
                yield b.filter(pa.array(keep))

        return run

    for part in index:
        docs = map_arrow(docs, kept(part), docs.schema)
    return docs


def op9_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, build(docs, table(spark, sf_dir, "benchmark")))
