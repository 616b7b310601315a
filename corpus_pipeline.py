"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept and is written as
Parquet before the next one reads it. All but the last return the columns of documents. Rows that a stage
rejects are gone: documents that score as toxic; texts that are nothing but lines of earlier documents; all but
one document of each near-duplicate group; documents that hold a benchmark item.

Defined results of every stage but the last: rows with a null doc_id or text and empty texts are judged like any other
and stay where they match nothing; repeated rows stay or go together; texts are read whole, however long; all columns
pass through, whatever their names; an empty table gives no rows. Ties are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, linededup, packing, toxicity
from tessera.llm.common import free_name, materialise, release, table

#: Learned models, alignments and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of earlier documents; those that lose all of their text go."""
    lost = free_name("n_deleted", docs.columns)
    left = linededup.dedup(docs, n_deleted=lost)
    out = left.where((F.col(lost) == 0) | F.col("text").rlike(r"\S")).drop(lost)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_uncontaminated(docs, decontaminate.build(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
