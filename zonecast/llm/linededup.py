"""Line deduplication that returns a keep bitmap for each document, and no text.

Lines become (key hash, document, position), written once. They are range-partitioned by hash and a salt taken from the
document, and sorted within partitions by document and position. Streaming through that order, a row is a first
occurrence if the row before it is of another document or key. First occurrences are summed a salt, then a key:
a line that a third of all documents share is spread over the salts, only counts of it meet, and what is decided of it
comes back to its lines by broadcast (join_hot).

A key is a line with white space stripped at both ends and A-Z lower-cased, held as its 16-byte MD5. Keys under
min_chars code points are never dropped. With keep_first the first occurrence (lowest document, then position)
stays.

Null and empty texts are one empty line. Documents without dropped lines get a null bitmap. Rows that repeat a
doc_id count as one document of a line, but each text has its own bitmap: it is named by doc_id and copy, the 64-bit
hash of the text, so rows of equal texts share theirs. Rows with a null doc_id keep all lines. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import STRIPPED, documents, join_hot, keep, lower_ascii

SALTS = 32


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(STRIPPED)))


def keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(key, salt, doc_id, copy, pos) of each line that may be dropped."""
    return (
        docs.where("doc_id IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode(F.transform(lines_of(F.col("text")), key_of)).alias("pos", "line"))
        .where(F.length("line") >= max(min_chars, 1))
        .select(F.unhex(F.md5("line")).alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), "doc_id", "copy", "pos")
    )


def first_occurrences(lines: DataFrame) -> DataFrame:
    """lines (keys(), written) with first: no earlier line of its document has the key."""
    dealt = lines.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt", "doc_id", "pos")
    stream = Window.partitionBy("key", "salt").orderBy("doc_id", "pos")
    return dealt.withColumn("first", F.coalesce(F.lag("doc_id").over(stream) != F.col("doc_id"), F.lit(True)))


def bitmaps(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """(doc_id, copy, n_dropped, dropped) for each document that loses lines.

    dropped: its dropped lines as a compressed bitmap, an array of (word, bits): bit b of word w stands for line
    64 * w + b, counted from 0; words without a dropped line are left out.
    """
    lines = keep(keys(docs, min_chars), "lines")
    common = keep(
        first_occurrences(lines).groupBy("key", "salt").agg(F.sum(F.col("first").cast("long")).alias("n"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "copy", "pos")).alias("at"))
        .groupBy("key").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.min("at").alias("at")).where(F.col("n") >= min_docs).select("key", "at", "rows"),
        "common",
    )
    lost = join_hot(lines.select("key", "doc_id", "copy", "pos"), common, ["key"], "rows", max(1, lines.count()))
    if keep_first:
        lost = lost.where(F.struct("doc_id", "copy", "pos") != F.col("at"))
    # dealt by document once: both sums and a later join by doc_id and copy stay where the rows are
    words = lost.select("doc_id", "copy", F.shiftright("pos", 6).alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit")).repartition("doc_id", "copy")
    return (
        words.groupBy("doc_id", "copy", "word").agg(F.bit_or("bit").alias("bits"))
        .groupBy("doc_id", "copy").agg(F.sum(F.bit_count("bits").cast("long")).alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))
    )


def kept_text(text: Column, dropped: Column) -> Column:
    """The text without the lines that the bitmap drops."""
    marks = F.map_from_entries(F.transform(dropped, lambda w: F.struct(w["word"], w["bits"])))
    bits = lambda m, i: F.try_element_at(m, F.shiftright(i, 6))
    stays = lambda m: F.filter(lines_of(text), lambda _, i: F.coalesce(F.getbit(bits(m, i), i % 64) == 0, F.lit(True)))
    # the map is bound to a variable of a one-element array, so that it is built once a row and not once a line
    kept = F.get(F.transform(F.array(marks), lambda m: F.array_join(stays(m), "\n")), 0)
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(kept)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    maps = bitmaps(docs, min_docs=10, min_chars=1, keep_first=False)
    return docs.withColumn("copy", F.xxhash64("text")).join(maps, ["doc_id", "copy"], "left").select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("dropped")), 256).alias("kept_sha256"),
    )
