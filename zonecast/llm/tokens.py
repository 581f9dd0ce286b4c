"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of frequent pre-tokens and their token counts, broadcast once; tier two a cache of
each worker for what the table misses. A miss is encoded by the library. No pre-token is shuffled: the counts are
a narrow map over the documents.

The table only saves work and never changes a count, so it comes from a sample: TABLE_ROWS documents at most, of
at most SAMPLE_CHARS characters, drawn over the whole input, and TABLE_SIZE pre-tokens of at most LONGEST characters, which bounds the
broadcast at a few MB whatever the input. A worker's cache holds CACHE_SIZE pre-tokens and starts anew beyond.

Splitting before the lookup is exact only where this module's pattern and the library's agree and no special
string occurs; a text with a character outside SAFE or with a special string is encoded whole by the library.

Null and empty texts have 0 bytes and 0 tokens. An empty table gives no rows. Repeated rows each give a row.
Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Fixed value: the public pre-token pattern of this byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on which the two libraries' classes agree: ASCII without odd controls, Latin, Greek, Cyrillic, common punctuation.
SAFE = r"[\t\n\r\x20-\x7e¡-ɏΑ-ΡΣ-ϿЀ-ҁҊ-ԯ‐-‧‰-⁞€]*"
TABLE_ROWS, SAMPLE_CHARS, TABLE_SIZE, CACHE_SIZE, LONGEST = 5_000, 20_000, 50_000, 200_000, 40


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[str, ...]:
    return tuple(x.content for x in tokenizer(path).get_added_tokens_decoder().values())


class Lengths(dict):
    """Pre-token to number of tokens: tier two, filled on a miss, with tier one inside from the start."""

    def __init__(self, path: str, table: dict[str, int]):
        super().__init__(table)
        self.path, self.table = path, table

    def __missing__(self, piece: str) -> int:
        n = len(tokenizer(self.path).encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) > CACHE_SIZE + len(self.table):
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n


def count_text(text: str, lengths: Lengths, split=regex.compile(PATTERN).findall, safe=regex.compile(SAFE).fullmatch) -> int:
    if not text:
        return 0
    if safe(text) is None or any(x in text for x in specials(lengths.path)):
        return len(tokenizer(lengths.path).encode(text, add_special_tokens=False).ids)
    return sum(map(lengths.__getitem__, split(text)))


_held: dict[str, Lengths] = {}


def frequent(docs: DataFrame, path: str, seed: int = 7) -> dict[str, int]:
    """Tier one: token counts of the commonest pre-tokens of a bounded sample, found in one task and sent to the driver."""
    texts = docs.select("text").where(F.length("text").between(1, SAMPLE_CHARS))
    fraction = min(1.0, TABLE_ROWS / max(1, docs.count()))
    split = regex.compile(PATTERN).findall

    def commonest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(x for x in split(text.as_py()) if len(x) <= LONGEST)
        lengths = Lengths(path, {})
        top = [x for x, _ in seen.most_common(TABLE_SIZE)]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array([lengths[x] for x in top], pa.int32())], ["piece", "n"])

    rows = texts.sample(fraction, seed).limit(TABLE_ROWS).mapInArrow(commonest, "piece string, n int").collect()
    return {x.piece: x.n for x in rows}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path))
    kind = dict(docs.dtypes)["doc_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _held.get(path)
        if lengths is None or lengths.table is not table.value:
            lengths = _held[path] = Lengths(path, table.value)  # the worker's, kept from task to task
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                counts = [count_text(x.as_py() or "", lengths) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return sized.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
