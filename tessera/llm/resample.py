"""Operator 10: data selection by importance resampling with hashed n-gram models.

Two bags of hashed one- and two-word grams (BUCKETS buckets) are fitted: the target's from texts
labelled good, the raw one's from all texts. A text's log importance weight is the sum over its grams of the
difference of log probabilities; adding Gumbel noise and taking the k greatest keys samples k texts without
replacement in proportion to their weights (Gumbel top-k).

The target model is fitted on at most `target_rows` labelled rows, those of least hash of the id (a parameter);
the raw counts and the weights cover every whole text. k is the share of good rows among all labels times
the number of texts, unless it is given. The k-th key is found by ranks: keys are range-partitioned, partitions
counted, and only the offsets summed, so no task orders all rows.

Noise depends on the seed, the id and the text alone: a rerun samples the same rows. Defined results: null
and empty texts have weight 0 (and no grams); repeated rows draw the same noise and are taken or left by their order in
the partition, k rows in all; null ids are carried and can't be targets; without a target row all weights are 0; texts
are read whole, however long; further columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, materialise, shingle_hashes, table, text_chunks, word_hashes

BUCKETS, TARGET_ROWS, SEED, SMOOTHING = 10_000, 20_000, 11, 1.0
_U = np.uint64


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each one- and two-word gram of a run of texts."""
    words, _, bounds = word_hashes(data, offsets)
    texts = np.arange(len(offsets) - 1)
    pairs, to = shingle_hashes(words, bounds, 2)
    alone = np.diff(bounds) == 1  # a single word has no pair
    row2 = np.repeat(texts, np.diff(to))
    keep = ~alone[row2]
    buckets = np.concatenate([words, pairs[keep]]) % _U(BUCKETS)
    return np.concatenate([np.repeat(texts, np.diff(bounds)), row2[keep]]), buckets.astype(np.int64)


def counted(docs: DataFrame, targets: set) -> np.ndarray:
    """Gram counts (2, BUCKETS): of all texts, and of the targets' (a bounded set of ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            good = np.array([i in targets for i in b.column(0).to_pylist()])
            for at, to, data, offsets in text_chunks(b.column(1)):
                row, bucket = gram_buckets(data, offsets)
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[good[at:to][row]] if len(row) else bucket, minlength=BUCKETS)
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "target"])

    rows = map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, "bucket long, raw long, target long")
    out = np.zeros((2, BUCKETS), np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        out[:, r["bucket"]] = r["raw"], r["target"]
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Smoothed log of target over raw probability of each bucket; 0 without a target."""
    if not counts[1].any():
        return np.zeros(BUCKETS)
    p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, key) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights = np.zeros(b.num_rows)
            for at, to, data, offsets in text_chunks(b.column(1)):
                row, bucket = gram_buckets(data, offsets)
                if len(row):
                    weights[at:to] = np.bincount(row, weights=ratio[bucket], minlength=to - at)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weights), b.column(2)], ["doc_id", "log_weight", "noise"])

    noise = F.xxhash64(F.lit(seed), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text"), noise.alias("noise")), run, f"doc_id {kind}, log_weight double, noise long")
    uniform = (F.shiftrightunsigned("noise", 11).cast("double") + 0.5) / float(1 << 53)
    return rows.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("key"))


def greatest(keyed: DataFrame, k: int) -> DataFrame:
    """keyed with its rank (1 the greatest key), for the k first rows, whatever k."""
    dealt = materialise(keyed.repartitionByRange(F.desc("key"), F.col("doc_id")).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("top"))
    # ranges are in descending order of keys: one row per partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy(F.desc("top"), "part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("part").orderBy(F.desc("key"), "doc_id")
    return dealt.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.row_number().over(order)).where(F.col("rank") <= k).drop("part", "before")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, target_rows: int = TARGET_ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, key, rank) of the k sampled texts."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    targets = {r["doc_id"] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).collect()}
    keyed = materialise(weigh(docs, log_ratio(counted(docs, targets)), seed))
    if k is None:
        share = labels.where("quality is not null").agg(F.avg("quality")).first()[0]
        k = round((1.0 if share is None else share) * keyed.count())
    return greatest(keyed, k)


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
