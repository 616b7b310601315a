"""Operator 3: exact n-gram Jaccard join by size-banded tiles, bitmap signatures and sorted intersections.

A document's set holds the 64-bit hashes of its distinct k-word shingles. Documents of equal sets are one
class and only classes are joined. The rest is exact in every step:

1. Anchors. Sets of similarity t share an element among the first n - ceil(t n) + 1 of each in any common
   order. The order puts frequent elements last (a sketch of bounded size counts all elements of all
   texts), then goes by hash, so a passage in thousands of documents anchors only those that hold little else.
2. Tiles. Classes that share an anchor meet in its tile, and there only within size bands: bands are a
   factor 1/t wide, so partners lie in one's own band or the next.
3. Stars. Each class is first compared with one hub alone. The links that hold give components; tiles
   within one component are done, so a group of copies costs as many comparisons as it has members, not
   pairs.
4. Rest. In the tiles that still hold several components, classes of different components are paired when
   the bitmaps allow it, once at their first common anchor.

Bitmaps keep the parity of the number of elements per bit: two of them differ in at most as many bits as the
sets do in elements, so bit counts bound the overlap from above. Pairs under the bound are compared by
sorted-array intersection.

Defined results: null and empty texts, and texts of separators only, have an empty set and are linked with
nothing (component: the own id); texts of fewer than k words have their whole sequence as one shingle;
repeated rows are linked with each other; rows with a null id have an empty set's result, with their own n_shingles; ids are
whole numbers; texts are read whole, however long; other columns don't matter, whatever their names; an empty table gives no rows. Hash collisions between distinct sets or
shingles are the only source of error (about n^2 / 2^65 for n distinct ones).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, free_name, map_arrow, materialise, mix, release, shingle_hashes, table, text_chunks, word_hashes
from tessera.operators import closure

SKETCH_BITS, SLICES, MAP_BITS = 20, 16, 1024
_U = np.uint64


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def version_of(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def _named(docs: DataFrame) -> DataFrame:
    return _texts(docs).where("doc_id is not null")


def sets_of(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for at, _, data, offsets in text_chunks(texts):
        words, _, bounds = word_hashes(data, offsets)
        shingles, to = shingle_hashes(words, bounds, k)
        for i in range(len(to) - 1):
            yield at + i, np.unique(shingles[to[i] : to[i + 1]])


def identity(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        both = np.array([s.sum(dtype=_U) + _U(len(s)) * _U(0x9E3779B97F4A7C15), np.bitwise_xor.reduce(s)], _U)
        return int(mix(mix(both)[:1] * _U(3) + mix(both[1:] + _U(1)))[0].astype(np.int64))


def bitmap(s: np.ndarray, size: int = MAP_BITS) -> np.ndarray:
    """Parities as int64 words: `size` of them, doubled until there is a bit for each element."""
    while size < len(s):
        size *= 2
    bits = np.bincount((s >> _U(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def measured(docs: DataFrame, k: int) -> DataFrame:
    """Rows of kind 0: doc_id, set identity, size and bitmap of each document; of kind 1: slices of each task's sketch."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("version", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("small", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            nodes, sizes, bits, small = [], [], [], []
            for _, s in sets_of(b.column(1), k):
                nodes.append(identity(s) if len(s) else None)
                sizes.append(len(s))
                bits.append(bitmap(s))
                small.append(bits[-1].reshape(-1, MAP_BITS // 64) if len(s) > MAP_BITS else bits[-1][None])
                counts[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)] += 1
            n, ends = len(nodes), np.cumsum([0, *map(len, bits)])
            held = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(bits) if bits else np.empty(0, np.int64)))
            # a long bitmap is cut to MAP_BITS by xor of its parts
            short = [np.bitwise_xor.reduce(x, axis=0) for x in small]
            cut = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (MAP_BITS // 64)), pa.array(np.concatenate(short) if short else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), b.column(0), b.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), cut, held, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        parts = np.minimum(counts, (1 << 32) - 1).astype("<u4").reshape(SLICES, -1)
        none = [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(SLICES, np.int32)), *none, pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), version_of(docs).alias("version"))
    return map_arrow(rows, run, "kind int, doc_id long, version long, node long, n long, small array<long>, bits array<long>, slice int, counts binary")


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint64)
    for b in batches:
        for c in b.column(b.schema.get_field_index("counts")):
            total += np.frombuffer(c.as_py(), "<u4" if len(c.as_py()) == 4 * len(total) else "<u8").astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype("<u8").tobytes()], pa.binary())], ["slice", "counts"])


def frequency_classes(measures: DataFrame) -> np.ndarray:
    """A class 0..63 for each counter of the sketch: the binary logarithm of what exceeds the mean, in units of four
    deviations; 0 below one unit.

    Its size is fixed (1 MB). Slices of all tasks are added in two steps, so no task reads those of all.
    """
    slices = measures.where("kind = 1").select("slice", F.pmod(F.xxhash64("counts"), F.lit(32)).cast("int").alias("salt"), "counts")
    schema = "slice int, counts binary"
    first = slices.groupBy("slice", "salt").applyInArrow(_added, schema)
    rows = first.groupBy("slice").applyInArrow(_added, schema).collect()
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES))
    for r in rows:
        counts[r["slice"]] = np.frombuffer(r["counts"], "<u8")
    counts = counts.ravel()
    # elements that occur once spread evenly: what exceeds the mean by several deviations is frequent
    unit = 4 * np.sqrt(max(counts.mean(), 1.0))
    return np.clip(np.floor(np.log2(np.maximum((counts - counts.mean()) / unit, 0.5))) + 1, 0, 63).astype(np.uint8)


RECORD = np.dtype([("key", "<u8"), ("node", "<i8"), ("n", "<u4"), ("at", "<u4")])
#: Records that a task groups at once.
RECORDS = 1_500_000
#: First anchors of a class by which a pair is told to have met before.
HEAD = 8


def tiles(docs: DataFrame, k: int, percent: int, classes: np.ndarray) -> DataFrame:
    """(key, node, n, at): anchors that two classes share at least, with their place in the class's order.

    A task groups its records, at most RECORDS at once, and sends each tile one record per key in one packed row,
    marked where it holds more members; those are passed through. What a tile must hold at once is one record per key
    and group of records, however large a group of copies is.
    """
    count = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        records = np.concatenate(held)
        records = records[np.lexsort((records["key"], records["key"] % _U(count)))]
        lead = np.append(True, records["key"][1:] != records["key"][:-1])
        first = np.flatnonzero(lead)
        alone = np.append(np.diff(first) == 1, len(records) - first[-1] == 1)
        rank = np.cumsum(lead) - 1
        edges = np.searchsorted(records["key"] % _U(count), np.arange(count + 1, dtype=np.uint64))
        for tile in np.flatnonzero(np.diff(edges)):
            cut = slice(edges[tile], edges[tile + 1])
            leads, own = lead[cut], records[cut]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([tile], np.int64)), *[pa.array([x.tobytes()], pa.binary()) for x in (own[leads], alone[rank[cut][leads]], own[~leads])]],
                ["tile", "leads", "alone", "members"],
            )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for b in batches:
            for _, s in sets_of(b.column(1), k):
                n = len(s)
                if not n or (own := identity(s)) in seen:
                    continue
                seen.add(own)
                take = n - (percent * n + 99) // 100 + 1
                order = np.argsort(classes[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:take]
                record = np.empty(take, RECORD)
                record["key"], record["node"], record["n"], record["at"] = s[order], own, n, np.arange(take)
                held.append(record)
                size += take
                if size >= RECORDS:
                    yield from packed(held)
                    held, size = [], 0
        if held:
            yield from packed(held)

    def table_of(records: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(records["key"].astype(np.int64)), pa.array(records["node"]), pa.array(records["n"].astype(np.int64)), pa.array(records["at"].astype(np.int32))], ["key", "node", "n", "at"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads, alone = [], []
        for b in batches:
            for x in zip(*b.columns[1:], strict=True):
                leads.append(np.frombuffer(x[0].as_py(), RECORD))
                alone.append(np.frombuffer(x[1].as_py(), bool))
                if len(members := np.frombuffer(x[2].as_py(), RECORD)):
                    yield table_of(members)
        if not leads:
            return
        records, single = np.concatenate(leads), np.concatenate(alone)
        order = np.argsort(records["key"], kind="stable")
        records, single = records[order], single[order]
        first = np.flatnonzero(np.append(True, records["key"][1:] != records["key"][:-1]))
        sizes = np.diff(np.append(first, len(records)))
        nodes = records["node"]
        # a class in several tasks is one member
        several = np.logical_or.reduceat(nodes != np.repeat(nodes[first], sizes), first)
        local = np.logical_or.reduceat(~single, first)
        records = records[np.repeat(several | local, sizes)]
        for at in range(0, len(records), 1 << 16):
            yield table_of(records[at : at + (1 << 16)])

    sent = map_arrow(_named(docs), send, "tile long, leads binary, alone binary, members binary")
    return map_arrow(sent.repartition(count, "tile"), meet, "key long, node long, n long, at int")


def band_of(n: Column, percent: int) -> Column:
    # a little wider than the factor, so that rounding puts no partners two bands apart
    return F.floor(F.log(n) / float(1.0001 * np.log(100 / percent)))


def _allowed(n: Column, m: Column, bits: Column, other: Column, percent: int) -> Column:
    """Whether sizes n, m and bitmaps of equal length let two sets reach the similarity, in whole numbers."""
    differ = F.aggregate(F.zip_with(bits, other, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    # |A & B| <= (|A| + |B| - differ) / 2 =: most, and 100 most >= percent (|A| + |B| - most)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & ((n + m - differ) * (100 + percent) >= 2 * percent * (n + m))


def _linkable(percent: int) -> Column:
    """_allowed by the long bitmaps of a and b."""

    def cut(x: str, y: str) -> Column:
        """The bitmap of x, folded to half its length (parities add up) where that of y is shorter."""
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))

    return _allowed(F.col("a_n"), F.col("b_n"), cut("a_bits", "b_bits"), cut("b_bits", "a_bits"), percent)


#: Binary logarithms of the bits of a filter: 16 bits an id, 1 MB at least and 16 MB at most.
FILTER_BITS, MOST_FILTER_BITS = 23, 27


def id_filter(ids: DataFrame, size: int) -> np.ndarray:
    """A bit array of 2 ** size bits in which the bits of all ids are set; others' bits may be as well."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << size, bool)
        for b in batches:
            bits[(mix(b.column(0).to_numpy().astype(np.int64).view(_U)) >> _U(64 - size)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << (size - 3), np.uint8)
        for b in batches:
            for x in b.column(0):
                total |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["bits"])

    parts = map_arrow(map_arrow(ids.repartition(8), part, "bits binary").coalesce(1), joined, "bits binary")
    total = np.zeros(1 << (size - 3), np.uint8)
    for row in parts.collect():
        total |= np.frombuffer(row["bits"], np.uint8)
    return total


def shingle_arrays(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, doc_id): sorted hashes as bytes.

    Texts are not shuffled: each task passes over its documents and takes up those whose id the filter lets through. With
    more ids than the greatest filter tells apart, documents are joined with the ids before.
    """
    wanted = materialise(wanted)
    n = wanted.count()
    size = min(max(FILTER_BITS, (16 * n).bit_length()), MOST_FILTER_BITS)
    known = id_filter(wanted.select("doc_id"), size)
    read = _named(docs)
    if 4 * n > 1 << MOST_FILTER_BITS:
        read = read.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            place = (mix(ids.astype(np.int64).view(_U)) >> _U(64 - size)).astype(np.int64)
            some = b.filter(pa.array((known[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)))
            found = [(identity(s), s.tobytes()) for _, s in sets_of(some.column(1), k) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["node", "shingles"])

    found = map_arrow(read, run, "node long, shingles binary")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, by intersection of their sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                place = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[place] == p).sum())
                good.append(100 * common >= percent * (len(p) + len(q) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    side = lambda name: arrays.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_s"))
    return map_arrow(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_s", "b_s"), run, "a long, b long")


def similarity_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    component_id is the smallest doc_id reachable over links of 100 * intersection >= percent * union.
    """
    return labelled_rows(docs, k, percent).drop("version")


def labelled_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """similarity_classes with the hash of each row's text as version.

    component_id is the smallest doc_id reachable over links of 100 * intersection >= percent * union.
    """
    measures = materialise(measured(docs, k))
    rows = measures.where("kind = 0").select("doc_id", "version", "node", "n", "small", "bits")
    # doc_id: whose text is read again for a class
    classes = materialise(rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("small").alias("small"), F.first("bits").alias("bits"), F.min("doc_id").alias("doc_id")))
    band = band_of(F.col("n"), percent)
    tiled = materialise(tiles(docs, k, percent, frequency_classes(measures)).withColumn("band", band))

    def bounded(pairs: DataFrame) -> DataFrame:
        side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(_linkable(percent)).select("a", "b")

    def arrays_of(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return shingle_arrays(docs, nodes.join(classes, "node").select("node", "doc_id"), k)

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # hubs: in each tile the class that shares most of its anchors, as an original does among its copies; each class is
    # compared with the hub that it meets most often
    shares = tiled.groupBy("node").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    hubs = tiled.join(shares, "node").groupBy("key").agg(F.max_by("node", F.struct("share", "node")).alias("hub"))
    met = tiled.join(hubs, "key").where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times"))
    best = met.groupBy("node").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub"))
    stars = materialise(bounded(best.select(*ordered("node", "hub")).distinct()))
    arrays = materialise(arrays_of(stars))
    links = materialise(verified(stars, arrays, percent))
    release(arrays)
    near = components(links)

    labelled = tiled.join(near, "node", "left").select("key", "node", "n", "at", "band", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("key").agg((F.min("component") < F.max("component")).alias("open")).where("open").select("key")
    left = materialise(labelled.join(mixed, "key"))
    release(tiled)
    heads = left.groupBy("node").agg(F.transform(F.slice(F.array_sort(F.collect_set(F.struct("at", "key"))), 1, HEAD), lambda x: x["key"]).alias("head"))
    rest = materialise(left.join(heads.join(classes.select("node", "small"), "node"), "node"))
    release(left)
    other = rest.select(F.col("key").alias("key_2"), *[F.col(c).alias(f"{c}_2") for c in ("node", "n", "at", "band", "component", "small", "head")])
    # sets of the two sizes share one of their first n - least + 1 elements, where least is the overlap that they need
    least = F.floor((F.lit(percent) * (F.col("n") + F.col("n_2")) + 99 + percent) / (100 + percent))
    # a pair meets at its first common anchor alone; heads hold it unless it comes late
    before = F.array_intersect("head", "head_2")
    meets = (
        (F.col("key") == F.col("key_2")) & (F.col("node") < F.col("node_2")) & (F.col("component") != F.col("component_2")) & (F.abs(F.col("band") - F.col("band_2")) <= 1)
        & (F.col("at") <= F.col("n") - least) & (F.col("at_2") <= F.col("n_2") - least)
        & ((F.size(before) == 0) | (F.get(before, F.lit(0)) == F.col("key")))
        & _allowed(F.col("n"), F.col("n_2"), F.col("small"), F.col("small_2"), percent)
    )
    paired = rest.join(other, meets)
    more = materialise(bounded(paired.select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct()).join(stars, ["a", "b"], "left_anti"))
    release(rest)
    arrays = materialise(arrays_of(more))
    late = materialise(verified(more, arrays, percent))
    release(arrays)
    whole = components(links.union(late))
    # smallest ids are found over classes, so that a group of exact copies is one row; those of large components are
    # broadcast, and rows of one class meet in one join, which Spark can split
    labels = materialise(classes.join(whole, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("label")))
    for held in (classes, stars, links, more, late):
        release(held)
    least_ids = labels.groupBy("label").agg(F.min("doc_id").alias("least"))
    named = closure.looked_up(labels, least_ids, "label", closure.frequent_keys(labels, "label", labels.count())[0]).select("node", "least")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return rows.join(named, "node", "left").select("doc_id", "version", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component that of smallest doc_id.

    Rows of null id stay. Rows are told apart by id and text: of an id with several texts each is judged by its own
    component; rows that repeat both stay or go together.
    """
    found = labelled_rows(docs, k, percent)
    names = [free_name("id", docs.columns), free_name("version", docs.columns)]
    gone = found.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias(names[0]), F.col("version").alias(names[1])).distinct()
    return docs.join(gone, (docs["doc_id"] == gone[names[0]]) & (version_of(docs) == gone[names[1]]), "left_anti")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)] END) AS s FROM w),
c AS (SELECT row_number() OVER () AS c, s, len(s) AS n, min(doc_id) AS least FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
e AS (SELECT c, n, unnest(s) AS g FROM c),
i AS (SELECT a.c AS x, b.c AS y, a.n AS m, b.n AS n, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.c < b.c GROUP BY ALL),
l AS (SELECT x, y FROM i WHERE 100 * k >= 85 * (m + n - k)),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT c, c FROM c UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
k AS (SELECT r.x AS c, min(c.least) AS least FROM r JOIN c ON r.y = c.c GROUP BY r.x)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.least, doc_id) AS component_id
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN k ON c.c = k.c
"""
