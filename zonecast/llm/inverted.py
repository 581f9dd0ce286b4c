"""Segments of an inverted index over documents, for phrase search and for ranked search.

Documents stay where they are read: each task cuts its documents into segments of about TOKENS terms and at most
DOCUMENTS documents, and a segment holds the postings of all its own terms. So no term is shuffled, and one that every
document holds is one list in every segment. A segment is one row of a table that keep() writes.

Queries come in blocks of at most BLOCK bytes of text (or one longer text), each broadcast by itself; every block meets
every segment.

A term is a maximal run of bytes that are a letter or digit of ASCII, A-Z lower-cased, or no ASCII at all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS, DOCUMENTS, BLOCK = 1 << 20, 4096, 4 << 20
#: Each byte's place in a term: itself, its lower case, or a blank.
TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the text as bytes, as terms_of() takes it."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def gathered(batches: Iterator[pa.RecordBatch], most: int = DOCUMENTS) -> Iterator[tuple[int, list, np.ndarray, list[bytes], np.ndarray]]:
    """Segments of (doc_id, text as bytes), of at most so many documents: number, doc_ids, terms a document, distinct terms, and all terms in order as places among these."""
    first = TaskContext.get().partitionId() << 32
    names, parts, held, number = [], [], 0, defaultdict(count().__next__)
    segment = count(first)

    def closed():
        lengths = np.array([len(x) for x in parts], np.int32)
        return next(segment), names, lengths, list(number), np.concatenate([*parts, np.empty(0, np.int32)])

    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            for name, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                own = terms_of(text.as_py())
                names.append(name)
                parts.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
                held += len(own)
                if held >= TOKENS or len(names) >= most:
                    yield closed()
                    names, parts, held, number = [], [], 0, defaultdict(count().__next__)
    if names:
        yield closed()


def ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int32)


def slices(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of all elements of the slices that begin at starts and have counts elements."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def blocks(items: DataFrame) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """(item_id as a string, terms) of each item, in blocks of at most BLOCK bytes of text or one item."""
    block, size = [], 0
    for item, text in items.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        text = bytes(text or b"")
        if block and size + len(text) > BLOCK:
            yield block
            block, size = [], 0
        block.append((item, terms_of(text)))
        size += len(text)
    if block:
        yield block
