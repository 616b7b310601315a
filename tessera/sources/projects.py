"""Catalogues of projects and files, and their filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.tokens import subtokens
from tessera.schema import EDGES, NODES


def open_facts(spark: SparkSession, path: str, kind: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a folder of extracted facts, with fixed schemas.

    Rows of JSON that can't be read are kept: their text is in the column _corrupt_record, the other columns are null.
    """
    if kind != "json":
        return spark.read.schema(NODES).format(kind).load(f"{path}/nodes"), spark.read.schema(EDGES).format(kind).load(f"{path}/edges")
    reader = lambda schema: spark.read.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader(NODES).json(f"{path}/nodes"), reader(EDGES).json(f"{path}/edges")


def _with_corrupt(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("_corrupt_record", StringType())])


def is_test(path: Column | str) -> Column:
    return F.lower(path).contains("test")


def projects(catalogue: DataFrame, suffix: str | None = None) -> DataFrame:
    """Projects whose path doesn't contain 'test', in any case; with a suffix only those that end with it; without those that failed to compile."""
    kept = catalogue.where(~is_test("path"))
    if suffix is not None:
        kept = kept.where(F.lower("path").endswith(suffix.lower()))
    return kept.where("compiled") if "compiled" in catalogue.columns else kept


def first_visits(files: DataFrame) -> DataFrame:
    """Each file path once across projects: of the first project (least order) that holds it."""
    return files.groupBy("path").agg(F.min_by("project", F.struct("order", "project")).alias("project"))


def source_types(types: DataFrame) -> DataFrame:
    return types.where(~F.col("namespace").startswith("System"))


def with_tokens(nodes: DataFrame, tokenizer=subtokens) -> DataFrame:
    return nodes.withColumn("tokens", tokenizer("name"))


def corpora(spark: SparkSession, entries: list[tuple[str, str, str]]) -> DataFrame:
    """A static catalogue (solution, repository, clustering)."""
    return spark.createDataFrame(entries, "solution string, repository string, clustering string")
