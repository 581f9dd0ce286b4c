"""Shared helpers of the training-data operators: texts as columns and tables kept between jobs."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word, line and token rule here: blank and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
STRIPPED = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_written: list[str] = []
_within: ContextVar[list[str] | None] = ContextVar("within", default=None)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Unset, a local master gets one under /tmp; a cluster gets an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    spark.sparkContext.setCheckpointDir(found)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Spark removes the shuffle files of a statement when it ends: nothing reads them once its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys with over one in so many rows are joined by broadcast: there are fewer of them than this, whatever the input.
HOT_KEYS = 10_000


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends, and lost executors lose nothing.

    Its shuffle files go when it is written. The files go when this Python process ends; drop() frees them earlier.
    """
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/kept/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append(path)
    if (within := _within.get()) is not None:
        within.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that make() returns, written by keep(). The tables that make() kept on the way to it go then."""
    within: list[str] = []
    token = _within.set(within)
    try:
        out = keep(make(), name)
    finally:
        _within.reset(token)
    for path in within[:-1]:
        if path in _written:
            _delete(out.sparkSession.sparkContext, path)
            _written.remove(path)
    return out


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with table, which has one row a key and in count how many of the total rows have that key.

    A key of over total / HOT_KEYS rows never meets in one task: those keys, fewer than HOT_KEYS, are broadcast. Both
    are read twice: give written tables.
    """
    most = max(1, total // HOT_KEYS)
    hot = F.broadcast(table.where(F.col(count) > most))
    cold = rows.join(F.broadcast(table.where(F.col(count) > most).select(*on)), on, "left_anti").join(table.where(F.col(count) <= most), on)
    return rows.join(hot, on).unionByName(cold)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that keep() wrote. Nothing may read it afterwards."""
    for file in df.inputFiles()[:1]:
        path = file.rsplit("/", 1)[0]
        if (own := next((x for x in _written if path.rpartition("/")[2] == x.rpartition("/")[2]), None)) is not None:
            _delete(df.sparkSession.sparkContext, own)
            _written.remove(own)


def _delete(sc: SparkContext, path: str) -> None:
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_all() -> None:
    sc = SparkContext._active_spark_context
    while sc is not None and sc._jsc is not None and _written:
        _delete(sc, _written.pop())
