"""Operator 6: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts, whatever their labels, is unlabelled.
With the class prior p the risk of a scorer g is
    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)]),   l the logistic loss,
whose second term, an unbiased estimate of the negatives' risk, is kept from going below zero; where
it does, its gradient is reversed. A linear model in numpy over presence of hashed 5-byte grams and word beginnings of the
lower-cased text; the features are those most over-represented among positives.

Bounds: the training sample has at most `positives` and `unlabelled` rows, those of least
hash of the id (parameters below); the prior is the share of toxic rows among all usable labels.
Scoring covers every whole text in one pass.

Defined results: null and empty texts score as a text without features; a null id is never held out
and has no label; repeated ids in labels count as toxic if any is; without a positive the score is 0;
texts are scored whole, however long; ties in the sample go by id, ties between features by bucket; rows and other
columns pass through unchanged, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, materialise, table, text_chunks

POSITIVES, UNLABELLED, FEATURES, BITS, GRAM, PREFIXES = 3000, 9000, 4096, 22, 5, (6, 8)
THRESHOLD, LEAST = 0.3, 25.0
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[9, 10, 11, 12, 13]] = 32


@dataclass
class Model:
    buckets: np.ndarray  # of the features
    weights: np.ndarray
    bias: float

    def lookup(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int16)
        out[self.buckets] = np.arange(len(self.buckets))
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, byte where it starts) of the grams of GRAM bytes that lie in one text, and of the first bytes of each word."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    plain = _PLAIN[data]
    b = np.concatenate([plain, np.zeros(max(PREFIXES), np.uint8)]).astype(np.uint64)
    factor, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    code = np.zeros(n, np.uint64)
    for j in range(GRAM):
        code = code << np.uint64(8) | b[j : j + n]
    inside = np.ones(n, bool)
    for edge in offsets[1:]:
        inside[max(edge - GRAM + 1, 0) : edge] = False
    place = np.flatnonzero(inside)
    found, places = [(code[place] * factor) >> shift], [place]
    # words: from a byte after a space or a text's start to the next space or the text's end
    blank = plain == 32
    start = ~blank
    start[1:] &= blank[:-1]
    start[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(start & ~blank)
    stops = np.sort(np.concatenate([np.flatnonzero(blank), offsets[1:]]))
    length = stops[np.searchsorted(stops, starts, "right")] - starts if len(starts) else starts
    for salt, size in enumerate(PREFIXES, 1):
        code = np.zeros(len(starts), np.uint64)
        for j in range(size):
            code = code << np.uint64(8) | np.where(j < length, b[starts + j], np.uint64(0))
        found.append(((code + np.uint64(salt)) * (factor ^ np.uint64(salt << 20))) >> shift)
        places.append(starts)
    return np.concatenate(found).astype(np.int64), np.concatenate(places)


def document_features(texts: pa.Array, lookup: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row within, feature): distinct features of runs of texts; buckets if lookup is None."""
    for at, to, data, offsets in text_chunks(pc.utf8_lower(texts.fill_null(""))):
        feature, place = grams(data, offsets)
        if lookup is not None:
            found = lookup[feature]
            own = found >= 0
            feature, place = found[own].astype(np.int64), place[own]
        row = np.searchsorted(offsets, place, "right") - 1
        pairs = np.unique(row << BITS | feature)
        yield at, to, pairs >> BITS, pairs & ((1 << BITS) - 1)


def _sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """(positive, text) of the bounded training sample."""
    order = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id")
    confirmed = order(labels.where(F.col("toxic") == 1).where(~held_out()).select("doc_id").where("doc_id is not null").distinct()).limit(positives)
    usable = order(docs.select("doc_id").where("doc_id is not null").where(~held_out()).distinct()).limit(unlabelled)
    picked = confirmed.select("doc_id", F.lit(True).alias("positive")).unionByName(usable.select("doc_id", F.lit(False).alias("positive")))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("positive", "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int32)
    for b in batches:
        positive = b.column(0).to_numpy(zero_copy_only=False)
        for at, to, row, bucket in document_features(b.column(1), None):
            own = positive[at:to][row]
            for side in (0, 1):
                np.add.at(counts[side], bucket[own == bool(side)], 1)
    some = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[1][some]), pa.array(counts[0][some])], ["bucket", "p", "u"])


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model:
    """Train on the bounded sample; labels of held-out ids are not read."""
    usable = labels.where("toxic is not null").where(~held_out())
    prior = usable.agg(F.avg("toxic")).first()[0] or 0.0
    sample = materialise(_sample(docs, labels, positives, unlabelled).repartition(8))
    total = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_pos, n_unl = total.get(True, 0), total.get(False, 0)
    if not n_pos or not n_unl or not 0 < prior < 1:
        return Model(np.empty(0, np.int64), np.empty(0), -50.0)
    counted = map_arrow(sample, _counted, "bucket long, p int, u int").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate_p, rate_u = (F.col("p") + 0.5) / (n_pos + 1.0), (F.col("u") + 0.5) / (n_unl + 1.0)
    # likelihood ratio of one rate for both samples against two: what chance gives among so many grams stays below LEAST
    rate = (F.col("p") + F.col("u") + 1.0) / (n_pos + n_unl + 2.0)
    ratio = 2 * (F.col("p") * F.log(rate_p / rate) + F.col("u") * F.log(rate_u / rate))
    best = counted.where((F.col("p") >= 3) & (rate_p > 2 * rate_u) & (ratio >= LEAST)).orderBy(ratio.desc(), "bucket").limit(features)
    buckets = np.array([r["bucket"] for r in best.select("bucket").collect()], np.int64)
    model = Model(buckets, np.zeros(len(buckets)), 0.0)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = model.lookup()
        for b in batches:
            for at, to, row, feature in document_features(b.column(1), lookup):
                edges = np.searchsorted(row, np.arange(to - at + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(feature, pa.int32()))], ["positive", "features"])

    rows = map_arrow(sample, gathered, "positive boolean, features array<int>").toArrow()
    held = rows["features"].combine_chunks()
    lengths = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
    weights, bias = train(held.flatten().to_numpy(), lengths, rows["positive"].to_numpy(), float(prior))
    return Model(buckets, weights, bias)


def train(feature: np.ndarray, lengths: np.ndarray, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of least non-negative PU risk, by Adam on the whole sample, and the bias that fits the prior. feature: of row after row."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    size = int(feature.max()) + 1 if len(feature) else 0
    w = np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    pos, unl = positive.astype(bool), ~positive.astype(bool)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[feature], minlength=len(lengths)) + w[size]
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        negative = np.logaddexp(0, z[unl]).mean() - prior * np.logaddexp(0, z[pos]).mean()
        # d l(g) = s - 1, d l(-g) = s
        gradient = np.zeros(len(z))
        sign = 1.0 if negative >= 0 else -1.0
        if sign > 0:
            gradient[pos] += prior * (s[pos] - 1) / pos.sum()
        gradient[unl] += sign * s[unl] / unl.sum()
        gradient[pos] -= sign * prior * s[pos] / pos.sum()
        g = np.append(np.bincount(feature, weights=gradient[row], minlength=size)[:size], gradient.sum()) + decay * w * (np.arange(size + 1) < size)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    # the bias that makes the mean score of the unlabelled sample the prior; where the risk was held at zero, the fitted
    # one is too high and this one, as weights are held back as well, too low: the mean of both is taken
    z = np.bincount(row, weights=w[feature], minlength=len(lengths))[unl]
    low, high = -50.0, 50.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (1 / (1 + np.exp(-np.clip(z + middle, -50, 50)))).mean() < prior else (low, middle)
    return w[:size], (min(low, float(w[size])) + float(w[size])) / 2


def scores(texts: pa.Array, model: Model, lookup: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    weights = np.append(model.weights, np.zeros(len(model.buckets) - len(model.weights)))
    for at, to, row, feature in document_features(texts, lookup):
        out[at:to] = np.bincount(row, weights=weights[feature], minlength=to - at) if len(row) else 0.0
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -50, 50)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = model.lookup()
        for b in batches:
            s = scores(b.column(2), model, lookup)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = model.lookup()
        for b in batches:
            yield b.filter(pa.array(scores(b.column(place), model, lookup) < threshold))

    return map_arrow(docs, run, docs.schema)


def op6_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
