"""Operator 8: line dedup by pairwise patience alignment.

A line is its sequence of words, lower-cased (A-Z); blank lines don't count and stay. A block is a run of
consecutive lines; `min_words` is the least size of a block that is deleted.

1. Partners. A document's keys are, for each line, the shortest run of lines from it on, and the shortest run up to it,
   that has min_words words (a long line is its own key): the keys of a common block that is large enough cover it.
   For each of its shared keys a document is paired with the key's earliest holder, so the pairs are no more than the
   keys and a frequent line makes no group of pairs.
2. Alignment. Each pair is aligned by patience diff on line hashes alone (texts don't travel): the lines that are
   unique on both sides, in longest increasing order, divide the documents; common ends are matched and
   gaps are aligned in the same way. Of the aligned common blocks those of min_words words at least are
   deleted from the later document.
3. Check. An alignment is in order and one to one, so of blocks that the partner holds in another order, or that a
   document repeats, some are left. Keys that an earlier document holds and of which lines are left are found by
   comparison with what the alignments deleted, and their lines go as well (about 1 % of all that go on the tables).

So a line goes if and only if a run of lines around it, of min_words words at least, stands in an earlier document.
Lines are compared by 64-bit hashes.

Order is by (doc_id, hash of the text); a doc_id may have any type that can be ordered. Defined results: rows that
repeat both are one document and keep or lose the same lines; rows with a null id or text, and empty texts, pass
unchanged and are no partners; a text that loses all its lines is empty; texts are read whole, however long; all columns
pass through, whatever their names, and a name for a further column that docs has is an error; an empty table gives
no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import _COMBINE, _powered, free_name, map_arrow, materialise, mix, release, table, text_chunks, word_hashes

MIN_WORDS = 10
_U = np.uint64


def line_table(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Of the non-blank lines of a run of texts: place in the text, hash, words, and each text's first line; of the keys, in order of texts: hash, first and last line, and each text's first key."""
    words, starts, bounds = word_hashes(data, offsets)
    breaks = np.flatnonzero(data == 10)
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[texts]
    if len(words) == 0:
        none = np.empty(0, np.int64)
        empty = np.zeros(len(offsets), np.int64)
        return none, none.astype(_U), none, empty, none.astype(_U), none, none, empty
    first = np.flatnonzero(np.append(True, (texts[1:] != texts[:-1]) | (line[1:] != line[:-1])))
    up, down = _powered(len(words) + 1)
    with np.errstate(over="ignore"):
        hashes = mix(np.add.reduceat(words * up[: len(words)], first) * down[first])
        counts = np.diff(np.append(first, len(words)))
        owner = texts[first]
        edges = np.searchsorted(owner, np.arange(len(offsets)))
        to = np.cumsum(counts)
        n = len(hashes)
        onward = np.searchsorted(to, to - counts + min_words)
        back = np.searchsorted(to - counts, to - min_words, "right") - 1
        runs = np.concatenate([
            np.stack([np.arange(n), onward], 1)[onward < edges[owner + 1]],
            np.stack([back, np.arange(n)], 1)[back >= edges[owner]],
        ])
        runs = np.unique(runs[:, 0] * n + runs[:, 1])
        start, end = runs // n, runs % n
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(hashes * up[:n], dtype=_U)])
        keys = mix((sums[end + 1] - sums[start]) * down[start] + _COMBINE[9])
    return line[first], hashes, counts, edges, keys, start, end, np.searchsorted(start, edges)


def version_of(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, version, places, hashes, words, keys, starts, ends) of each document with lines; version hashes the text.

    starts and ends are the keys' first and last lines, counted without the blank ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offsets in text_chunks(b.column(2)):
                place, hashes, counts, edges, keys, start, end, held = line_table(data, offsets, min_words)
                lists = lambda v, e: pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(v))
                base = np.repeat(edges[:-1], np.diff(held))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), lists(place.astype(np.int32), edges), lists(hashes.astype(np.int64), edges), lists(counts.astype(np.int32), edges), lists(keys.astype(np.int64), held), lists((start - base).astype(np.int32), held), lists((end - base).astype(np.int32), held)],
                    ["doc_id", "version", "places", "hashes", "words", "keys", "starts", "ends"],
                )

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", version_of(docs).alias("version"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, version long, places array<int>, hashes array<long>, words array<int>, keys array<long>, starts array<int>, ends array<int>")


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def subsequence(x: list, y: list) -> list[tuple[int, int]]:
    """Matched places of a longest common subsequence."""
    shared = set(x) & set(y)
    xs, ys = [i for i, v in enumerate(x) if v in shared], [j for j, v in enumerate(y) if v in shared]
    rows = [[0] * (len(ys) + 1)]
    for i in xs:
        above, row = rows[-1], [0]
        for k, j in enumerate(ys):
            row.append(above[k] + 1 if x[i] == y[j] else max(above[k + 1], row[k]))
        rows.append(row)
    out, i, j = [], len(xs), len(ys)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((xs[i], ys[j]))
    return out[::-1]


def patience(x: list, y: list, rest: Callable | None = None) -> list[tuple[int, int]]:
    """Matched places (i, j) of two sequences, in order; rest aligns gaps without unique words or lines, else they stay unmatched."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once: dict = {}
        for i in range(a, b):
            once[x[i]] = -1 if x[i] in once else i
        other: dict = {}
        for j in range(c, d):
            if once.get(y[j], -1) >= 0:
                other[y[j]] = -1 if y[j] in other else j
        both = [(once[v], j) for v, j in other.items() if j >= 0]
        both.sort(key=lambda p: p[1])
        anchors = [both[k] for k in increasing([p[0] for p in both])]
        if not anchors:
            out += [(a + i, c + j) for i, j in rest(x[a:b], y[c:d])] if rest else []
            continue
        for i, j in anchors:
            out.append((i, j))
        ends = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(ends, ends[1:], strict=False) if p + 1 < q and r + 1 < s]
    return sorted(out)


def common_blocks(x: list, y: list, words: list, min_words: int) -> list[int]:
    """Places in y of the aligned common blocks of min_words words at least; words are those of y's lines."""
    shared = set(x) & set(y)
    xs, ys = [i for i, v in enumerate(x) if v in shared], [j for j, v in enumerate(y) if v in shared]
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for i, j in [(xs[p], ys[q]) for p, q in patience([x[i] for i in xs], [y[j] for j in ys])] + [(-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(words[q] for q in block) >= min_words:
                out += block
            block = []
        block.append(j)
        before = (i, j)
    return out


def _share(df: DataFrame, n: int) -> int:
    """The 4P-th part of n rows (P shuffle partitions): keys, or earlier documents, with more rows are handled apart."""
    return max(n // (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 256)


def earlier_keys(lines: DataFrame) -> DataFrame:
    """(own, start, end, first) of the keys that an earlier document holds; first is the earliest."""
    keyed = lines.select(F.struct("doc_id", "version").alias("own"), F.explode(F.arrays_zip("keys", "starts", "ends")).alias("k")).select("own", F.col("k.keys").alias("key"), F.col("k.starts").alias("start"), F.col("k.ends").alias("end"))
    first = materialise(keyed.groupBy("key").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    least = _share(lines, first.agg(F.sum("n")).first()[0] or 0)
    # at most 4P keys are that frequent: they are broadcast
    hot = F.broadcast(first.where(F.col("n") > least).select("key", "first"))
    cold = first.where(F.col("n") <= least).select("key", "first")
    found = keyed.join(hot, "key").unionByName(keyed.join(hot, "key", "left_anti").join(cold, "key"))
    out = materialise(found.where("first < own").select("own", "start", "end", "first"))
    release(first)
    return out


def aligned(pairs: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """(own, cut) of pairs(first, own): the lines, counted without blank ones, that own loses to first."""
    kind = lines.schema["doc_id"].dataType.simpleString()
    held = lines.select(F.struct("doc_id", "version").alias("own"), "hashes", "words")
    least = _share(pairs, pairs.count())
    # at most 4P documents have so many partners; as many copies of one are sent as its partners need tasks, 8P in all at most
    busy = F.broadcast(materialise(pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("first", F.ceil(F.col("n") / least).cast("int").alias("salts"))))
    salts = F.coalesce("salts", F.lit(1))
    many = pairs.join(busy, "first", "left").select("first", "own", F.pmod(F.xxhash64("own"), salts).cast("int").alias("salt"))
    early = held.select(F.col("own").alias("first"), F.col("hashes").alias("early")).join(busy, "first", "left").select("first", "early", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    both = many.join(held, "own").join(early, ["first", "salt"]).select("own.doc_id", "own.version", "hashes", "words", "early")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [common_blocks(x, y, words, min_words) for y, words, x in zip(*[c.to_pylist() for c in b.columns[2:]], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cut, pa.list_(pa.int32()))], ["doc_id", "version", "cut"])

    out = map_arrow(both, run, f"doc_id {kind}, version long, cut array<int>").where(F.size("cut") > 0)
    return out.select(F.struct("doc_id", "version").alias("own"), "cut")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(own, gone, checked): places of the lines that each document (own: doc_id, version) loses; checked counts those that no alignment had."""
    lines = materialise(lines_of(docs, min_words).dropDuplicates(["doc_id", "version"]))
    shared = earlier_keys(lines)
    found = aligned(shared.select("first", "own").distinct(), lines, min_words).groupBy("own").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))
    cover = shared.groupBy("own").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["end"]))))
    cut = F.coalesce("cut", F.array().cast("array<int>"))
    whole = cover.join(found, "own", "left").select("own", cut.alias("cut"), F.array_except(covered, cut).alias("left"))
    places = lines.select(F.struct("doc_id", "version").alias("own"), "places")
    out = materialise(whole.join(places, "own").select("own", F.transform(F.concat("cut", "left"), lambda i: F.get("places", i)).alias("gone"), F.size("left").alias("checked")))
    release(shared)
    release(lines)
    return out


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, n_deleted: str | None = None, n_checked: str | None = None) -> DataFrame:
    """docs, all columns, with the text of later documents without the lines that earlier ones hold.

    n_deleted and n_checked name further columns: the lines deleted, and those of them that the check had to add.
    """
    for name in (n_deleted, n_checked):
        if name and name.lower() in map(str.lower, docs.columns):
            raise ValueError(f"docs has a column {name}")
    found = deletions(docs, min_words)
    names = dict.fromkeys(("id", "version", "gone", "checked"))
    for name in names:
        names[name] = free_name(name, [*docs.columns, *filter(None, names.values()), *filter(None, (n_deleted, n_checked))])
    gone = found.select(*[F.col(c).alias(names[k]) for k, c in (("id", "own.doc_id"), ("version", "own.version"), ("gone", "gone"), ("checked", "checked"))])
    places = F.col(names["gone"])
    lines = F.split(docs["text"], "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places), lambda i: F.get(lines, i))
    text = F.when(places.isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    joined = docs.join(gone, (docs["doc_id"] == gone[names["id"]]) & (version_of(docs) == gone[names["version"]]), "left")
    out = [text.alias(c) if c == "text" else docs[c] for c in docs.columns]
    if n_deleted:
        out.append(F.coalesce(F.size(places), F.lit(0)).cast("long").alias(n_deleted))
    if n_checked:
        out.append(F.coalesce(names["checked"], F.lit(0)).cast("long").alias(n_checked))
    return joined.select(*out)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), n_deleted="n_deleted", n_checked="n_checked")
