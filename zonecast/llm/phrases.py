"""Benchmark decontamination by a positional inverted index.

build() stores, for each segment of the documents (inverted.py), the postings of every term: the places at which it
stands, in order. search() takes items in blocks; an item's windows are its runs of width terms (an item of fewer, but
not none, is one window), and each distinct window is looked up once. In a segment a window starts with the postings
of its rarest term there, less the term's offset in the window; these are the possible beginnings. The lists of the
other terms follow from rare to common, each less its own offset, and a beginning stays while it is in all lists. With
slop, every beginning within slop of these is looked up, and stays while each list has a place within slop of it: slop
0 gives exact phrases, more gives proximity, so that terms may be moved, swapped or parted by others. A window that lacks a term in the segment ends at once.

Documents are parted by gaps wider than a window and its slop, so no match runs from one into the next. Beginnings are
looked up CANDIDATES at a time, and a window with more is cut. What is moved is one row a document.

Null and empty texts have no words and no hits; items with none have no windows. Items count by item_id: those that
share one are one item, and hits of an item without one count, but no item is named. Repeated doc_ids are documents of
their own, as are those without. Without items nothing is contaminated; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, keep
from .inverted import DOCUMENTS, blocks, gathered, ints, slices, texts_of

CANDIDATES = 1 << 20


def build(docs: DataFrame, most: int = DOCUMENTS) -> DataFrame:
    """The index, written: (segment, ids, lengths, terms, ends, places), one row a segment of at most so many documents.

    ids: the documents; lengths: their numbers of terms. terms: the distinct terms, parted by blanks; ends: where each
    one's places end; places: counted over the segment's terms. Numbers are 32 bits each.
    """
    kind, of = dict(docs.dtypes)["doc_id"], to_arrow_type(docs.schema["doc_id"].dataType)
    schema = pa.schema([("segment", pa.int64()), ("ids", pa.list_(of)), *((x, pa.binary()) for x in ("lengths", "terms", "ends", "places"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, names, lengths, terms, found in gathered(batches, most):
            places = np.argsort(found, kind="stable").astype(np.int32)
            ends = np.cumsum(np.bincount(found, minlength=len(terms))).astype(np.int32)
            row = {"segment": segment, "ids": names, "lengths": lengths.tobytes(), "terms": b" ".join(terms), "ends": ends.tobytes(), "places": places.tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema)

    return keep(texts_of(docs).mapInArrow(run, f"segment long, ids array<{kind}>, lengths binary, terms binary, ends binary, places binary"), "postings")


class Windows:
    """The distinct windows of a block of items, by their number of terms, with the items each belongs to."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        self.names = sorted({x for x, _ in items if x is not None})
        place, self.slot, rows = {x: i for i, x in enumerate(self.names)}, {}, {}
        for name, terms in items:
            own = [self.slot.setdefault(x, len(self.slot)) for x in terms]
            size = min(width, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                rows.setdefault(size, []).append((own[i : i + size], place.get(name, -1)))
        self.tables = []
        for size, found in rows.items():
            distinct, of = np.unique(np.array([x for x, _ in found], np.int64), axis=0, return_inverse=True)
            order = np.argsort(of.ravel(), kind="stable")
            owners = np.array([x for _, x in found], np.int64)[order]
            self.tables.append((size, distinct, owners, np.bincount(of.ravel(), minlength=len(distinct))))


class Segment:
    """Postings of the block's terms in a segment: sorted numbers slot * span + place, where documents are gap places apart."""

    def __init__(self, row: dict, windows: Windows, gap: int):
        self.lengths, ends, places = ints(row["lengths"]).astype(np.int64), ints(row["ends"]).astype(np.int64), ints(row["places"])
        self.document = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths + gap * np.arange(1, len(self.lengths) + 1)
        self.span = int(self.lengths.sum()) + gap * (len(self.lengths) + 2)
        terms = row["terms"].split(b" ") if row["terms"] else []
        slots = np.fromiter((windows.slot.get(x, -1) for x in terms), np.int64, len(terms))
        known = np.flatnonzero(slots >= 0)
        known = known[np.argsort(slots[known])]
        begins = np.concatenate([[0], ends[:-1]])[known] if len(terms) else ends[known]
        counts = ends[known] - begins
        at = places[slices(begins, counts)].astype(np.int64)
        self.keys = np.repeat(slots[known], counts) * self.span + at + gap * (self.document[at] + 1)
        self.count = np.zeros(len(windows.slot), np.int64)
        self.count[slots[known]] = counts
        self.begin = np.cumsum(self.count) - self.count

    def has(self, low: np.ndarray, slop: int) -> np.ndarray:
        at = np.searchsorted(self.keys, low - slop)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= low + slop)

    def matches(self, table: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, beginning) of all matches of a table of windows, in parts."""
        counts = self.count[table]
        live = np.flatnonzero(counts.min(axis=1) > 0)
        order = np.argsort(counts[live], axis=1, kind="stable")
        rare = table[live, order[:, 0]]
        # a window of more than CANDIDATES postings is cut into several entries
        cuts = -(-self.count[rare] // CANDIDATES)
        entry = np.repeat(np.arange(len(live)), cuts)
        cut = slices(np.zeros(len(live), np.int64), cuts)
        begin = self.begin[rare][entry] + cut * CANDIDATES
        number = np.minimum(self.count[rare][entry] - cut * CANDIDATES, CANDIDATES)
        part = np.cumsum(number) // CANDIDATES
        for own in np.split(np.arange(len(entry)), np.flatnonzero(np.diff(part)) + 1) if len(entry) else []:
            window = np.repeat(entry[own], number[own])
            start = self.keys[slices(begin[own], number[own])] % self.span - order[window, 0]
            if slop:  # the rarest term may be off its place, too
                start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
                window = np.repeat(window, 2 * slop + 1)
            for j in range(1, table.shape[1]):
                offset = order[window, j]
                stays = self.has(table[live[window], offset] * self.span + start + offset, slop)
                window, start = window[stays], start[stays]
            yield live[window], start


def search(index: DataFrame, items: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """(segment, number, doc_id, n_words, spans, items) of each document of the index.

    spans: (start, end) of the runs of words, counted from 0, that stand where a window was found; items: the item_ids,
    as strings, of the windows found. With slop a span is where the window's terms are looked for, less the slop.
    """
    spark = index.sparkSession
    of = next(x.dataType.elementType for x in index.schema if x.name == "ids")
    schema = f"segment long, number int, doc_id {of.simpleString()}, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    gap = width + 2 * slop + 1

    def searched(block, every: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(block.value, width)
            for batch in batches:
                for i in range(batch.num_rows):
                    part = batch.slice(i, 1)
                    row = {c: part.column(c)[0].as_py() for c in ("segment", "lengths", "terms", "ends", "places")}
                    segment = Segment(row, windows, gap)
                    yield from _told(segment, row["segment"], part.column("ids")[0].values, windows, slop, every)

        return index.mapInArrow(run, schema)

    found = [searched(spark.sparkContext.broadcast(x), i == 0) for i, x in enumerate(blocks(items))]
    if not found:
        found = [searched(spark.sparkContext.broadcast([]), True)]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    merged = every.groupBy("segment", "number").agg(F.first("doc_id", True).alias("doc_id"), F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    # spans of several blocks may overlap: each is cut at the end of those before it
    cut = F.aggregate("spans", F.expr("named_struct('last', 0, 'out', CAST(array() AS array<struct<start:int,end:int>>))"), lambda a, x: F.when(x["end"] <= a["last"], a).otherwise(F.struct(x["end"].alias("last"), F.concat(a["out"], F.array(F.struct(F.greatest(x["start"], a["last"]).alias("start"), x["end"].alias("end")))).alias("out"))), lambda a: a["out"])
    return merged.withColumn("spans", cut)


def _told(segment: Segment, number: int, names: pa.Array, windows: Windows, slop: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Rows of search() for a segment: all its documents, or those that have a match."""
    marks, pairs = np.zeros(segment.span + 1, np.int32), [np.empty(0, np.int64)]
    for size, table, owners, many in windows.tables:
        for window, start in segment.matches(table, slop):
            np.add.at(marks, start, 1)
            np.add.at(marks, start + size, -1)
            document = np.searchsorted(segment.starts, start + slop, "right") - 1
            of = owners[slices((np.cumsum(many) - many)[window], many[window])]
            own = np.repeat(document, many[window])
            pairs.append(np.unique((own * (len(windows.names) + 1) + of)[of >= 0]))
    inside = np.concatenate([[False], np.cumsum(marks[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    low, high = edges[::2], edges[1::2]
    document = np.searchsorted(segment.starts, high - 1 + slop, "right") - 1
    low, high = np.maximum(low - segment.starts[document], 0), np.minimum(high - segment.starts[document], segment.lengths[document])
    pair = np.unique(np.concatenate(pairs))
    owner, item = pair // (len(windows.names) + 1), pair % (len(windows.names) + 1)
    asked = np.arange(len(segment.lengths)) if every else np.unique(np.concatenate([document, owner]))
    lists = lambda of, values: pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(of, asked), np.searchsorted(of, asked[-1:], "right")), pa.int32()), values)
    if not len(asked):
        return
    stays = low < high
    spans = pa.StructArray.from_arrays([pa.array(low[stays], pa.int32()), pa.array(high[stays], pa.int32())], ["start", "end"])
    named = pa.array([windows.names[i] for i in item], pa.string())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(asked), number), pa.int64()), pa.array(asked, pa.int32()), names.take(pa.array(asked)), pa.array(segment.lengths[asked], pa.int64()), lists(document[stays], spans), lists(owner, named)],
        ["segment", "number", "doc_id", "n_words", "spans", "items"],
    )


def op11_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(documents(spark, sf_dir).select("doc_id", "text"))
    found = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), width=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    found = found.select("doc_id", "n_words", hit.alias("n_hit"), F.sort_array("items").alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
