"""Scratch tables that cut the lineage of iterative plans.

They are written once as Parquet to the folder that all executors share, so a lost executor costs a read
and not the iteration, and are deleted when they are released or the process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """df, written and read back."""
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    _held[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a scratch table that no later plan reads; other frames are left alone."""
    path = getattr(df, "_scratch_path", None)
    if path in _held:
        _delete(_held.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_held.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone
            return
