"""Tables that a plan reads more than once, derived once and written to the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir; where it is unset, a folder under /tmp for a local master, and None on a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}" if spark.sparkContext.master.startswith("local[") else None


def once(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back, so that a plan that uses it twice derives it once. Lost executors lose nothing.

    Without a shared folder it is df itself, derived for each use. The files go when this Python process ends.
    """
    spark = df.sparkSession
    if (folder := shared_folder(spark)) is None:
        return df
    path = f"{folder}/derived/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_all() -> None:
    sc = SparkContext._active_spark_context
    while sc is not None and sc._jsc is not None and _written:
        path = sc._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
