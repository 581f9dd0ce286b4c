"""Exact deduplication by recipes of content-defined chunks.

A text is cut where a hash of its last WINDOW bytes has MASK bits clear, so equal passages are cut alike wherever
they stand. Equal chunks get one identifier, the SHA-256 of the chunk, verified by comparing the bytes of all
chunks that share it; where chunks of differing bytes share a digest, their bytes are the identifier. A document's recipe is its
ordered list of identifiers, and only recipes are compared: a long document is never moved as a whole. What is found
of a group of equal recipes goes back to its rows by the digest of the text, or by the recipe if any two differing ones
share a digest.

Skew: a chunk or recipe that a third of all rows share is first combined on the map side (one row a task), and its
group comes back to the rows by broadcast (join_hot): fewer than 10,000 rows of 64 characters and a few numbers.

Equality is of texts with A-Z lower-cased and null as empty: null and empty texts form one group. Of a group the
largest doc_id stays (ties: one id). Rows with a null doc_id get kept = null as they name no row; their group
counts them. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_hot, keep, lower_ascii

#: A cut needs 11 clear bits, about one byte in 2,048, and 256 bytes at least; the hash is of the last 16 bytes.
WINDOW, MASK, SHORTEST, LONGEST = 16, (1 << 11) - 1, 256, 65_536
MOST_CLASHES = 1000
_GEAR = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
_GEAR ^= _GEAR >> np.uint64(29)
_GEAR *= np.uint64(0xBF58476D1CE4E5B9)
_GEAR ^= _GEAR >> np.uint64(32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data, the last one its length; [] if it has no bytes."""
    if len(data) <= SHORTEST:
        return [len(data)] if data else []
    gear = _GEAR[np.frombuffer(data, np.uint8)]
    # the sum over the window of each byte's number, shifted by its distance from the window's end, by doubling
    size = 1
    while size < WINDOW:
        more = gear.copy()
        more[size:] += gear[:-size] << np.uint64(size)
        gear, size = more, 2 * size
    marks = np.flatnonzero(((gear >> np.uint64(20)) & np.uint64(MASK)) == 0) + 1
    ends, last = [], 0
    for at in marks.tolist():
        while at - last > LONGEST:
            ends.append(last := last + LONGEST)
        if at - last >= SHORTEST and at < len(data):
            ends.append(last := at)
    while len(data) - last > LONGEST:
        ends.append(last := last + LONGEST)
    return [*ends, len(data)]


def _cut(apart: frozenset[bytes] | None, whole: bool):
    """Batches of (row, text) to (row, text_sha256, recipe), or with whole to (digest, chunk). apart: digests that identify no chunk; None for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                names, out, digests, chunks = [], [], [], []
                for text in part.column(1).to_pylist():
                    data, last, recipe = text.encode(), 0, []
                    for end in cuts(data):
                        chunk, last = data[last:end], end
                        digest = hashlib.sha256(chunk).digest()
                        if whole:
                            digests.append(digest)
                            chunks.append(chunk)
                        recipe.append(digest if apart is not None and digest not in apart else len(chunk).to_bytes(8, "big") + chunk)
                    names.append(hashlib.sha256(data).hexdigest())
                    out.append(b"".join(recipe))
                if whole:
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], ["digest", "chunk"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(out, pa.binary())], ["doc_id", "text_sha256", "recipe"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("text"))


def clashes(docs: DataFrame) -> frozenset[bytes] | None:
    """Digests under which chunks of differing bytes were found: none is known for SHA-256. Over MOST_CLASHES, None: no digest is trusted."""
    chunks = _texts(docs).mapInArrow(_cut(frozenset(), True), "digest binary, chunk binary")
    differ = chunks.groupBy("digest").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low <> high")
    found = differ.select("digest").limit(MOST_CLASHES + 1).collect()
    return frozenset(bytes(x.digest) for x in found) if len(found) <= MOST_CLASHES else None


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, recipe) of each row; recipe: the verified identifiers of its chunks, in order, as one binary."""
    kind = dict(docs.dtypes)["doc_id"]
    return _texts(docs).mapInArrow(_cut(clashes(docs), False), f"doc_id {kind}, text_sha256 string, recipe binary")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row."""
    rows = keep(recipes(docs), "recipes")
    same = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("text_sha256").alias("text_sha256"))
    named = keep(same.groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("recipes")), "groups")
    if named.where("recipes > 1").isEmpty():
        joined = join_hot(rows.drop("recipe"), named.drop("recipes"), ["text_sha256"], "group_size", max(1, rows.count()))
    else:
        joined = join_hot(rows, keep(same.drop("text_sha256"), "groups"), ["recipe"], "group_size", max(1, rows.count()))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir).select("doc_id", "text"))
