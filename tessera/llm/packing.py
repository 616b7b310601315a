"""Operator 2: vector best-fit packing of tokenised documents into sequences.

A document costs a sequence three capacities: tokens, documents and attention (length squared).
Best fit decreasing takes the longest pieces first and puts each into the open sequence with the
least weighted residual norm (or the greatest weighted dot product) among those where every
capacity suffices.

The search runs over the histogram of lengths, which has at most `capacity` entries whatever the
corpus holds: equal pieces and equal sequences are handled as groups with a multiplicity. The plan is
a bounded table of (length, rank range) -> (sequence range, offset); pieces look up their rank. Ranks
come from counters in each task plus offsets summed by (task, length), so no length is a hot key.

Defined results: a null text is empty (one piece, the end token alone); every row is packed, repeated
rows each for itself; null ids stay null; texts are tokenised whole, however long, and only those of more ids than the
capacity are cut; of equally good sequences the one opened first is taken, and of equally long pieces that of the
first task and row; further columns are not read, whatever their names; an empty table gives no rows.

With the default limits (as many documents as tokens, and the square of the tokens) only tokens can exclude a
sequence: no more pieces fit than tokens, and a sum of squares is at most the square of the sum.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, materialise, table

END_TOKEN = 2


def public_paths() -> tuple[str, str, str]:
    """(tokenizers file, the same vocabulary as ranks, split pattern) of the 50k byte-level BPE."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


@lru_cache(maxsize=1)
def encoder(full: str, ranks: str, pattern: str):
    """text -> uint32 ids, those of the tokenizers file `full`; one per worker process.

    The ranks file holds the same merges and ids and is encoded 3.5 times faster; texts that hold
    the string of a special token go through the tokenizers library itself.
    """
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    with open(full, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    whole = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(full))

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(whole().encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(quick._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)

    return encode


def pieces(docs: DataFrame, capacity: int = 1024, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, task_rank): the pieces of every document.

    Only documents of more than `capacity` ids are cut; their first piece takes the remainder.
    task_rank counts the pieces of one length in one task.
    """
    paths = paths or public_paths()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = encoder(*paths), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            owner, rows = [], []
            for i, text in enumerate(b.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_TOKEN)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k in range(len(edges) - 1):
                    length = edges[k + 1] - edges[k]
                    owner.append(i)
                    rows.append((k, edges[k], length, zlib.crc32(ids[edges[k] : edges[k + 1]]), task, int(seen[length])))
                    seen[length] += 1
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), *columns], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"])

    return map_arrow(docs.selectExpr("doc_id", "cast(text as string) text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, task_rank long")


def plan(histogram: dict[int, int], capacity: int = 1024, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> dict[int, np.ndarray]:
    """length -> rows (first rank, stacked pieces, first sequence, offset) in the order of ranks.

    Pieces of one length and of ranks from the first on are stacked `stacked` to a sequence, one
    behind the other. An open group of sequences is (residual tokens, documents, attention,
    number, content); placing a length in part of a group splits it.
    """
    documents, attention = documents or capacity, attention or capacity * capacity
    full = np.array([capacity, documents, attention], float)
    w = np.array(weights)
    open_ = np.zeros((0, 3))
    number: list[int] = []
    content: list[tuple] = []
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        if length > capacity or length * length > attention:
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        need = np.array([length, 1, length * length], float)
        left = histogram[length]
        most = int(min(capacity // length, documents, attention // (length * length)))
        while left:
            fits = np.flatnonzero((open_ >= need).all(1)) if len(open_) else ()
            if len(fits):
                share = open_[fits] / full
                score = (w * ((open_[fits] - need) / full) ** 2).sum(1) if rule == "norm" else -(w * share * (need / full)).sum(1)
                g = int(fits[int(np.argmin(score))])
                room = int((open_[g] // need).min())
                # best fit goes on with the sequence it has just filled: stack as many as fit
                used, stack = (min(number[g], left // room), room) if left >= room else (1, left)
            else:
                g, room = len(open_), most
                used, stack = (left // most, most) if left >= most else (1, left)
                open_ = np.vstack([open_, full])
                number.append(used)
                content.append(())
            if used < number[g]:
                open_ = np.vstack([open_, open_[g]])
                number.append(number[g] - used)
                content.append(content[g])
                number[g] = used
            offset = int(capacity - open_[g][0])
            content[g] = (*content[g], (length, stack, offset))
            open_[g] = open_[g] - stack * need
            left -= used * stack
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for n, held in zip(number, content, strict=True):
        for length, stack, offset in held:
            out.setdefault(length, []).append((ranks.get(length, 0), stack, sequence, offset))
            ranks[length] = ranks.get(length, 0) + n * stack
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, capacity: int = 1024, documents: int | None = None, attention: int | None = None, rule: str = "norm", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Pieces of all documents with sequence_id and offset, gapless from 0 in each sequence."""
    cut = materialise(pieces(docs, capacity, paths))
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").count().withColumnRenamed("count", "n").collect()}
    placed = plan(histogram, capacity, documents, attention, rule)
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("task_rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                rows = placed[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                over = rank[own] - row[:, 0]
                sequence[own], offset[own] = row[:, 2] + over // row[:, 1], row[:, 3] + over % row[:, 1] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_arrow(ranked, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
