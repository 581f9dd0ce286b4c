"""Ranked lexical search by a two-level index.

build() stores the postings of every segment of the documents (inverted.py). The first level has, for each term and
document, the part of the term's score that does not depend on how rare it is, rounded up to one byte; the second has
the exact counts. search() takes items in blocks. In a segment an item's first-level sums give each document an upper
and a lower bound of its score; a document is scored again, exactly in whole numbers, if its upper bound reaches the
kth highest of the lower bounds and of the exact scores that the task has so far. A task holds k documents an item and
gives them once, at its end; the tasks' documents meet by item and a salt, then by item.

A term's weight falls with the number of documents that hold it, which the index tells: each task sums over its
segments, and the sums of a block's terms (a block is bounded) go to the tasks with the block.

Null texts and those without terms are never found; they count in no average. Items without terms find nothing. Rows that share an
item_id are one item of all their terms. Documents of equal score rank by doc_id, those without one last; rows that
repeat a doc_id are documents of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, keep
from .inverted import DOCUMENTS, blocks, gathered, ints, slices, terms_of, texts_of

#: Fixed values of the scoring rule: the exact part of a score is TOP * tf div (1000 * tf + 12 * m), below TOP / 1000, m the document's length in percent of the mean, a quarter of it counted.
TOP, HALF, FLAT = 1_000_000_000, 12, 25
#: One step of a first-level byte.
STEP = -(-TOP // 1000 // 255)
SALTS = 64


def sizes(docs: DataFrame) -> tuple[int, int]:
    """N, L: documents with a term, and terms of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            for text in batch.column(0):
                own = len(terms_of(text.as_py()))
                n, total = n + (own > 0), total + own
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]}, pa.schema([("n", pa.int64()), ("total", pa.int64())]))

    return tuple(texts_of(docs).select("text").mapInArrow(run, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first())


def lengths_rule(terms: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents with so many terms."""
    return 100 - FLAT + (FLAT * terms.astype(np.int64) * n) // max(total, 1)


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (TOP * tf) // (1000 * tf + HALF * m)


def build(docs: DataFrame, n: int, total: int, most: int = DOCUMENTS) -> DataFrame:
    """The index, written: (segment, ids, terms, ends, docs, bytes, counts, m), one row a segment of at most so many documents.

    terms: the distinct terms, parted by blanks; ends: where each one's postings end. Level one: docs, places among ids,
    and bytes; level two: counts, and m of each document. Numbers are 32 bits each, m 64.
    """
    kind, of = dict(docs.dtypes)["doc_id"], to_arrow_type(docs.schema["doc_id"].dataType)
    names = ("terms", "ends", "docs", "bytes", "counts", "m")
    schema = pa.schema([("segment", pa.int64()), ("ids", pa.list_(of)), *((x, pa.binary()) for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, ids, lengths, terms, found in gathered(batches, most):
            document = np.repeat(np.arange(len(lengths)), lengths)
            pairs, counts = np.unique(found.astype(np.int64) * len(lengths) + document, return_counts=True)
            holder, m = pairs % len(lengths), lengths_rule(lengths, n, total)
            ends = np.cumsum(np.bincount(pairs // len(lengths), minlength=len(terms)))
            up = -(-part(counts.astype(np.int64), m[holder]) // STEP)
            row = (b" ".join(terms), ends.astype(np.int32), holder.astype(np.int32), up.astype(np.uint8), counts.astype(np.int32), m)
            yield pa.RecordBatch.from_pylist([{"segment": segment, "ids": ids} | {x: y if isinstance(y, bytes) else y.tobytes() for x, y in zip(names, row, strict=True)}], schema)

    return keep(texts_of(docs).mapInArrow(run, f"segment long, ids array<{kind}>, " + ", ".join(f"{x} binary" for x in names)), "impacts")


def _slots(row: dict, slot: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the postings of each of the block's terms in a segment; equal where it has none."""
    terms, ends = row["terms"].split(b" ") if row["terms"] else [], ints(row["ends"]).astype(np.int64)
    own = np.fromiter((slot.get(x, -1) for x in terms), np.int64, len(terms))
    known = np.flatnonzero(own >= 0)
    begin, end = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
    begin[own[known]], end[own[known]] = np.concatenate([[0], ends])[known], ends[known]
    return begin, end


def holders(index: DataFrame, slot: dict[bytes, int]) -> np.ndarray:
    """How many documents hold each of the block's terms."""
    shared = index.sparkSession.sparkContext.broadcast(slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1), strict=True):
                begin, end = _slots({"terms": terms.as_py(), "ends": ends.as_py()}, shared.value)
                held += end - begin
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], ["slot", "n"])

    out = np.zeros(len(slot), np.int64)
    for x in index.select("terms", "ends").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[x.slot] = x.n
    return out


def weight(n: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * held + 1)))


class Best:
    """The k best documents so far of one item: exact scores and doc_ids, best first."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self, lower: np.ndarray) -> int:
        """The kth highest of the scores so far and of lower; 1 if there are fewer."""
        every = np.concatenate([np.array([x[0] for x in self.rows], np.int64), lower])
        return max(1, int(np.partition(every, len(every) - self.k)[len(every) - self.k])) if len(every) >= self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.rows += [(x, i) for x, i in zip(scores.tolist(), ids, strict=True) if x > 0]
        self.rows.sort(key=lambda x: (-x[0], x[1] is None, x[1]) if x[1] is not None else (-x[0], True))
        del self.rows[self.k :]


def _search_segment(row: dict, slot: dict[bytes, int], queries: list[tuple[np.ndarray, np.ndarray]], best: list[Best]) -> None:
    """Add a segment's documents to the best. queries: slots and weights of each item's terms, times their repeats."""
    begin, end = _slots(row, slot)
    docs, up = ints(row["docs"]), np.frombuffer(row["bytes"], np.uint8)
    down, tf, m = np.maximum(up, 1) - 1, ints(row["counts"]), np.frombuffer(row["m"], np.int64)
    for (slots, weights), own in zip(queries, best, strict=True):
        count = end[slots] - begin[slots]
        if not count.any():
            continue
        at = slices(begin[slots], count)
        by = np.repeat(weights, count)
        holder = docs[at]
        # both are sums of whole numbers; they bound a score if rounding up where doubles end is allowed for
        upper = np.bincount(holder, by * up[at], len(m)) * (STEP * (1 + 1e-12))
        lower = np.bincount(holder, by * down[at], len(m)) * (STEP * (1 - 1e-12))
        floor = own.floor(np.floor(lower[upper > 0]).astype(np.int64))
        chosen = upper >= floor
        if not chosen.any():
            continue
        kept = chosen[holder]
        holder, by = holder[kept], by[kept]
        score = np.zeros(len(m), np.int64)
        np.add.at(score, holder, by * part(tf[at[kept]].astype(np.int64), m[holder]))
        found = np.flatnonzero(chosen)
        own.add(score[found], [row["ids"][i].as_py() for i in found])


def search(index: DataFrame, items: DataFrame, n: int, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item. n: documents with a term."""
    spark, kind, of = index.sparkSession, dict(items.dtypes)["item_id"], next(x.dataType.elementType for x in index.schema if x.name == "ids")
    items, found = items.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text")), []
    for block in blocks(items):
        counted: dict[str | None, Counter] = {}
        for name, terms in block:
            counted.setdefault(name, Counter()).update(terms)
        slot = {x: i for i, x in enumerate(sorted({x for c in counted.values() for x in c}))}
        weights = [weight(n, int(x)) for x in holders(index, slot)]
        asked = spark.sparkContext.broadcast((slot, list(counted), [(np.array([slot[x] for x in c], np.int64), np.array([weights[slot[x]] * y for x, y in c.items()], np.int64)) for c in counted.values()]))

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            slot, names, queries = asked.value
            best = [Best(k) for _ in names]
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in ("terms", "ends", "docs", "bytes", "counts", "m")}
                    _search_segment(row | {"ids": batch.column("ids")[i].values}, slot, queries, best)
            rows = [(x, y, s) for x, b in zip(names, best, strict=True) for s, y in b.rows]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], to_arrow_type(of)), pa.array([x[2] for x in rows], pa.int64())], ["item", "doc_id", "score"])

        found.append(index.mapInArrow(run, f"item string, doc_id {of.simpleString()}, score long"))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {of.simpleString()}, score long")
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    first = Window.partitionBy("item", "salt").orderBy(*order)
    last = Window.partitionBy("item").orderBy(*order)
    salted = every.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    out = salted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return out.select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    n, total = sizes(docs)
    return search(build(docs, n, total), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), n)
