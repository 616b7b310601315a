"""Shared pieces of the training-data operators: components, word hashing, Arrow stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import closure
from tessera.plans.scratch import materialise, release  # noqa: F401
from tessera.session import ship, table  # noqa: F401

#: Bytes of text that one numpy step handles; bounds a worker's memory whatever the batch holds.
CHUNK = 1 << 19
#: Rows of an Arrow batch: long texts make 10,000 rows too large for a small executor.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def free_name(name: str, taken) -> str:
    """name, or the first of name_, name__, ... that isn't taken (Spark's names don't differ by case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges(a, b): component is the smallest node reachable.

    Null ends and loops are ignored; empty edges give an empty table.
    """
    found = closure.components(edges.where("a <> b").select(F.col("a").alias("parent_id"), F.col("b").alias("child_id")))
    return found.select(F.col("node_id").alias("node"), F.col("component_id").alias("component"))


# ---------------------------------------------------------------- words and hashes in numpy

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240601))
#: A 64-bit value per byte; A-Z have those of a-z; separators (space, \x09-\x0D) have none.
SEPARATORS = (0x20, *range(0x09, 0x0E))
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) | _U(1)
_VALUES[65:91] = _VALUES[97:123]
_VALUES[list(SEPARATORS)] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_COMBINE = (_rng.integers(1, 1 << 63, 16, dtype=np.int64).astype(_U) << _U(1)) | _U(1)
#: The same with every ASCII byte but a-z, A-Z and 0-9 as a separator.
ALPHANUMERIC = _VALUES.copy()
ALPHANUMERIC[[b for b in range(128) if not chr(b).isalnum()]] = 0
_powers: list[np.ndarray] = []


def _powered(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n places at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + CHUNK // 4)
        made = []
        for base in (_BASE, _BASE_INVERSE):
            with np.errstate(over="ignore"):
                out = np.empty(size, _U)
                out[0], filled = _U(1), 1
                while filled < size:
                    more = min(filled, size - filled)
                    out[filled : filled + more] = out[:more] * _U(pow(base, filled, 1 << 64))
                    filled += more
            made.append(out)
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(33))
        x = x * _U(0xFF51AFD7ED558CCD)
        x ^= x >> _U(33)
        x *= _U(0xC4CEB9FE1A85EC53)
        x ^= x >> _U(33)
    return x


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of about CHUNK bytes.

    Null texts are empty. A text above CHUNK is a run of its own; texts are never cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        to = min(to, len(texts))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, values: np.ndarray = _VALUES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte) of each word of a run of texts, and the first word of each text (one more at the end).

    Words are runs of bytes that have a value: others than space and \\x09-\\x0D, with A-Z as a-z.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, _U), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = (values != 0)[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.empty(0, _U), starts, bounds
    up, down = _powered(n)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(values[data] * up[:n], starts)
        hashes = mix(sums * down[starts])
    return hashes, starts, bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and the first shingle of each text.

    A text of 1 to k-1 words has one shingle, the whole sequence; an empty one has none.
    """
    counts = np.diff(bounds)
    shingles = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(shingles)])
    if to[-1] == 0:
        return np.empty(0, _U), to
    with np.errstate(over="ignore"):
        n = len(words)
        rolled = np.zeros(n, _U)
        for j in range(k):
            rolled[: max(n - j, 0)] += words[j:] * _COMBINE[j]
        own = np.repeat(bounds[:-1] - to[:-1], shingles) + np.arange(to[-1])
        out = rolled[own]
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            whole = words[bounds[i] : bounds[i + 1]]
            out[to[i]] = (whole * _COMBINE[: len(whole)]).sum(dtype=_U) + _U(len(whole)) * _COMBINE[15]
    return mix(out), to


def trim() -> None:
    """Give freed memory back to the system: workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def map_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow in small batches; the worker's memory is trimmed at the end of each task."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)
