"""Best-fit packing with certified bin counts.

Documents become token pieces of at most CAPACITY; only longer documents are cut. Full pieces are sequences of
their own. The others are dealt to partitions of about ITEMS pieces, each with short and long ones alike, and packed
by best-fit decreasing. Each partition gets a lower bound of its bin count from dual-feasible functions: if its bins
are as few, it is certified. Partitions with a gap give back the pieces of bins that are not nearly full, and every
partition gives back its least full bin; these pieces are exchanged, dealt anew to fewer partitions, and packed again,
until what is given back fits one partition, which keeps all. What counts as nearly full is wider in each round.

A partition holds ITEMS (piece, length) pairs whatever the input, so memory is bounded; what is exchanged shrinks
by each round. Tokens are counted and hashed where the text is read and never shuffled.

Null and empty texts are the end token alone. Rows that repeat a doc_id are packed as rows. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep

CAPACITY, ITEMS = 4096, 50_000
#: A cache of 400,000 pre-tokens of at most 40 characters takes about 80 MB of a worker.
CACHE_SIZE, LONGEST = 400_000, 40
#: The share of a bin that may stay free in a partition with a gap; twice as much in each further round.
SLACK = 0.0005
#: Fixed value: the public pre-token pattern of this vocabulary of word ends.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that composing leaves alone and on which the libraries' classes and lower case agree.
SAFE = r"[\t\n\r\x20-\x7e\u00a1-\u012f\u0131-\u024f\u2010-\u2027\u20ac]*"
#: Bytes by their characters in a byte-level vocabulary: printable Latin-1 stands for itself, the others for 256 and up.
BYTES = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
BYTES |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(BYTES.values())))}
#: Stands for the end of a pre-token; not in SAFE.
MARK = "\x7f"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on every core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class WordIds(dict):
    """Texts to ids, as little-endian unsigned 32-bit numbers. As a dict, a cache of pre-tokens, started anew when large.

    The same vocabulary is given to the faster tiktoken: a pre-token's bytes with MARK behind them are merged by lowest
    id first. That is the library's own order, since ids run in the order of merges, and comes to the same ids because
    every token of the vocabulary, encoded alone, is itself (tests go over all of them). A text with a character
    outside SAFE, or with a special string, is encoded by the library.
    """

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        self.found = tokenizer(path)
        self.specials = tuple(x.content for x in self.found.get_added_tokens_decoder().values())
        self.ranks = {self.bytes_of(x): i for x, i in self.found.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{MARK}]*{MARK}", mergeable_ranks=self.ranks, special_tokens={})
        self.ends = np.zeros(max(self.ranks.values()) + 1, bool)
        self.ends[[i for x, i in self.ranks.items() if x.endswith(MARK.encode()) and x != MARK.encode()]] = True
        self.safe, self.split = regex.compile(SAFE).fullmatch, regex.compile(PATTERN).findall

    @staticmethod
    def bytes_of(token: str) -> bytes:
        """A token of a byte-level vocabulary as bytes."""
        word = token.removesuffix("</w>") if token != "</w>" else token
        return bytes(map(BYTES.__getitem__, word)) + MARK.encode() * (word != token)

    def learn(self, words: set[str]) -> None:
        """Encode those of words that are new, all in one call; words over LONGEST are left to the lookup."""
        if len(self) + len(words) > CACHE_SIZE:
            self.clear()
        if new := [x for x in words if len(x) <= LONGEST and x not in self]:
            ids = self.fast.encode_to_numpy(MARK.join(new) + MARK)
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            data, low = ids.astype("<u4").tobytes(), 0
            for word, high in zip(new, ends.tolist(), strict=True):
                self[word] = data[low:high]
                low = high

    def __missing__(self, word: str) -> bytes:
        return self.fast.encode_to_numpy(word + MARK).astype("<u4").tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        words = [None if self.safe(x) is None or any(s in x for s in self.specials) else self.split(x.lower()) for x in texts]
        self.learn(set().union(*(x for x in words if x is not None)))
        whole = lambda text: np.array(self.found.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(text) if own is None else b"".join(map(self.__getitem__, own)) for text, own in zip(texts, words, strict=True)]


_held: dict[str, WordIds] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece."""
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _held:
            _held[path] = WordIds(path)
        words, stop, step = _held[path], np.array([end], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                rows, out = [], []
                for i, own in enumerate(words.of([x or "" for x in part.column(1).to_pylist()])):
                    ids = own + stop
                    for k, at in enumerate(range(0, len(ids), step)):
                        piece = ids[at : at + step]
                        rows.append(i)
                        out.append((k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                k, start, length, crc = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each length: longest first, each into the fullest bin with room."""
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left: bins
    rooms: list[int] = []  # the rooms that have bins, ascending
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            own = free[room].pop()
            if not free[room]:
                rooms.pop(at)
        else:
            room, own, n = capacity, n, n + 1
        bins[i] = own
        if left := room - size:
            if not free[left]:
                bisect.insort(rooms, left)
            free[left].append(own)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins by dual-feasible functions: total size, the k-step rounding and the halves with a cut-off, each for many parameters."""
    if not len(lengths):
        return 0
    size, n = np.unique(lengths, return_counts=True)
    best = -(-int((size * n).sum()) // capacity)
    # cut-off e: over capacity - e counts as a whole bin, under e as nothing
    cuts = np.unique(np.concatenate([size[size <= capacity // 2], capacity - size[size > capacity // 2]]))
    total, number = np.append(0, np.cumsum(size * n)), np.append(0, np.cumsum(n))
    low, high = np.searchsorted(size, cuts), np.searchsorted(size, capacity - cuts, "right")
    whole = (number[-1] - number[high]) * capacity + total[high] - total[np.minimum(low, high)]
    best = max(best, -(-int(whole.max(initial=0)) // capacity))
    # rounding k: x counts as floor((k + 1) x / capacity) / k of a bin, or as x where that is whole
    for k in range(1, 33):
        y = (k + 1) * size
        f = np.where(y % capacity == 0, size * k, (y // capacity) * capacity)
        best = max(best, -(-int((f * n).sum()) // (k * capacity)))
    return best


def _packer(capacity: int, slack: float, last: bool):
    """Packs one partition; slack: the room a bin that is kept may have if the partition has a gap; last: all are kept."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy()
        bins = best_fit(lengths, capacity)
        fill = np.bincount(bins, lengths).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        given = (fill < capacity - slack) if len(fill) > bound else np.zeros(len(fill), bool)
        given[np.argmin(fill)] = True
        given &= not last
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        starts = ends - lengths[order]
        first = np.searchsorted(bins[order], bins[order], "left")
        offset = np.empty(len(bins), np.int64)
        offset[order] = starts - starts[first]
        return frame.assign(_bin=bins, _offset=offset, _again=given[bins], _bins=len(fill), _bound=bound, _given=int(given.sum()))

    return one


def packed(items: DataFrame, capacity: int = CAPACITY, per_part: int = ITEMS) -> tuple[DataFrame, DataFrame]:
    """items (length and any other columns) with sequence_id and offset, and the certificates.

    Lengths are 1 to capacity. items: a written table. A certificate (round, part, bins, bound, given) says how many bins
    a partition made of its pieces, how few they need at least, and how many of the bins were given back.
    """
    columns = [f"`{c}`" for c in items.columns]
    full = items.where(F.col("length") == capacity)
    left = items.where(F.col("length") < capacity)
    done, reports, counted, turn = [], [], left.count(), 0
    spread = [F.col(c) for c in columns]
    schema = ", ".join(f"{c} {t}" for c, t in zip(columns, (t for _, t in items.dtypes), strict=True)) + ", _part int, _bin long, _offset long, _again boolean, _bins long, _bound long, _given long"
    while counted:
        parts = -(-counted // per_part)
        last, slack = parts == 1, capacity * SLACK * 2**turn

        # dealt in order of length, so that each partition gets short and long pieces alike
        draw = F.xxhash64(*columns, F.lit(turn))
        dealt = left.withColumn("_draw", draw).repartitionByRange("length", "_draw").sortWithinPartitions("length", "_draw")
        part = F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")
        made = keep(dealt.select(*spread, part.alias("_part")).groupBy("_part").applyInPandas(_packer(capacity, slack, last), schema), f"pack{turn}")
        number = F.lit(turn).cast("long") * F.lit(1 << 58) + F.col("_part").cast("long") * F.lit(1 << 26) + F.col("_bin")
        done.append(made.where("NOT _again").select(*spread, number.alias("sequence_id"), F.col("_offset").alias("offset")))
        reports.append(made.groupBy("_part").agg(*[F.first(f"_{c}").alias(c) for c in ("bins", "bound", "given")]).select(F.lit(turn).alias("round"), F.col("_part").alias("part"), "bins", "bound", "given"))
        left, turn = made.where("_again").select(*spread), turn + 1
        counted = 0 if last else left.count()
    # each full piece is a sequence: numbers below 0, from its place among its partition's rows
    out = full.select(*spread, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    certificates = items.sparkSession.createDataFrame([], "round int, part int, bins long, bound long, given long")
    for more, report in zip(done, reports, strict=True):
        out, certificates = out.unionByName(more), certificates.union(report)
    return out, certificates


def pack(items: DataFrame, capacity: int = CAPACITY, per_part: int = ITEMS) -> DataFrame:
    """packed() without the certificates."""
    return packed(items, capacity, per_part)[0]


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    items = keep(pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return pack(items).select("doc_id", F.col("piece").cast("int"), "start", "length", "ids_crc32", "sequence_id", "offset")
