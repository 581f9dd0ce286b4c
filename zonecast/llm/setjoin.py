"""Exact Jaccard self-join of shingle sets by a token-group matrix.

1. Texts become sets of 64-bit shingle hashes. Equal sets are one node, named by the least doc_id.
2. Columns: two linked sets have a token in common among the first p of either in any one order of all tokens, where
   p - 1 is how many of its tokens a set's partner can lack. The order here: tokens of low hash (a share of all that
   makes about SPARE p a set) by how many rows hold them, then the others by hash, and last those that are frequent in
   a sample of about SAMPLE rows, by how often. So a passage that many documents share is only looked at by sets that
   hold little else. Only low tokens are counted and moved. Any order finds all links: the sample only saves work, and
   what is kept of it is bounded (FREQUENT tokens, those in LEAST rows and more).
3. Groups: a set belongs to the group of one of its looked-at tokens, the lowest of those that about as many sets
   share as share any of them; so most near copies of a text fall into one group. A group is held in blocks of about
   BLOCK sets and VOLUME tokens.
4. Opening a set's own block: its members are rows of the matrix over the tokens two of them share, and the product of
   the matrix with itself has the sizes of all intersections. Links in a block make classes.
5. Query and group: a set of another class that shares a looked-at token with a member asks that block. The block's
   token union bounds its overlap with any member; only if the bound reaches the threshold is the block opened, and
   the query compared with each member. First one set of each class asks, which joins the blocks of large groups, then
   all sets whose looked-at tokens are still in two classes. Components need one link, so sets in one class ask no more.

Skew: tokens and copies that very many rows share are joined by broadcast (join_hot); of two classes that share a
token, the sets of the smaller ask; queries of one block are dealt to chunks of CHUNK. Token sets are made and moved
only for sets with a possible partner.

Empty sets (null, empty or blank texts) link with nothing and are their own component. Texts under the shingle
length are one shingle. Rows with a null doc_id get a null component. Rows that repeat a doc_id are one node, so
their links join. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop, join_hot, keep
from .components import components

#: Sets and tokens a block, queries a chunk, words a worker's cache holds, columns of the matrix multiplied at once.
BLOCK, VOLUME, CHUNK, CACHE_SIZE, COLUMNS = 64, 1 << 18, 1000, 200_000, 1 << 15
SPARE = 1.5
SAMPLE, FREQUENT, LEAST, BUCKETS = 8_000, 1 << 18, 3, 1 << 20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_SIGN = np.uint64(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_SIZE:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


def shingles(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles; A-Z count as a-z, words part at ASCII white space."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(own))
    out = np.full(len(own) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * _A + own[i : len(own) - width + 1 + i])
    return np.unique(out)


def reach(n: int, percent: int) -> int:
    """p: how many of a set's first tokens are looked at; a partner lacks p - 1 of its n tokens at most."""
    return n + (-n * percent) // 100 + 1


def columns(tokens: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The tokens that may be looked at: those of low hash that are not frequent, or the first p where these are fewer. frequent: tokens, sorted, and how often each is seen."""
    known, times = frequent
    if len(known):
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        often = known[at] == tokens
        last, tokens = tokens[often], tokens[~often]
        last = last[np.lexsort((last, times[at[often]]))]
    else:
        last = tokens[:0]
    low = np.searchsorted(tokens, np.uint64(min(SPARE * (100 - percent) / 100, 0.999) * 2.0**64))
    return np.concatenate([tokens, last])[: max(int(low), reach(len(tokens) + len(last), percent))]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((flat ^ _SIGN).view(np.int64)))


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that are frequent in a sample, sorted, and in how many of its rows each is."""
    rows = docs.count()
    some = docs.select("text") if rows <= SAMPLE else docs.select("text").sample(SAMPLE / rows, seed=7)
    counts = _tokens(some, words).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") >= LEAST)
    found = counts.orderBy(F.col("n").desc(), "token").limit(FREQUENT).toPandas()
    tokens = found["token"].to_numpy(np.int64).view(np.uint64) ^ _SIGN
    order = np.argsort(tokens)
    return tokens[order], found["n"].to_numpy(np.int32)[order]


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, p, s1, s2, columns) of each row, s1 and s2 naming the set."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found = [shingles(x.as_py(), words, hashes) for x in part.column(1)]
                names = [(_mix(x + _A).sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(x * _A + _C), initial=np.uint64(0))) for x in found]
                s1, s2 = (pa.array(np.array([x[i] for x in names], np.uint64).view(np.int64)) for i in (0, 1))
                n, p = pa.array([len(x) for x in found], pa.int64()), pa.array([reach(len(x), percent) for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, p, s1, s2, _lists([columns(x, percent, frequent.value) for x in found])], ["doc_id", "n", "p", "s1", "s2", "columns"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, p long, s1 long, s2 long, columns array<long>")


def _tokens(docs: DataFrame, words: int) -> DataFrame:
    """docs (text and other columns) with the text's tokens in its place."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found = _lists([shingles(x.as_py(), words, hashes) for x in part.column("text")])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), found], [*others, "tokens"])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c != "text"), "tokens array<long>"]))


class Block:
    """Rows of the matrix: a block's sets, and all their tokens in order with the set that holds each."""

    def __init__(self, tokens: pa.ChunkedArray):
        sets = [x.values.to_numpy() for x in tokens]
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def within(self) -> np.ndarray:
        """Sizes of the intersections of all pairs of sets."""
        new = np.append(True, self.flat[1:] != self.flat[:-1])
        shared = ~(new & np.append(new[1:], True))
        column, owner = np.cumsum(new[shared]) - 1, self.owner[shared]
        out = np.zeros((len(self.sizes), len(self.sizes)), np.int64)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            own = slice(*np.searchsorted(column, (low, low + COLUMNS)))
            matrix = np.zeros((len(self.sizes), COLUMNS), np.float32)
            matrix[owner[own], column[own] - low] = 1
            out += (matrix @ matrix.T).astype(np.int64)
        return out

    def overlaps(self, query: np.ndarray, percent: int) -> np.ndarray:
        """The members over the threshold with query; none where the union's bound does not reach it."""
        left, right = np.searchsorted(self.flat, query), np.searchsorted(self.flat, query, "right")
        held = right > left
        if not reaches(held.sum(), len(query), self.sizes.min(), percent):
            return np.empty(0, np.int64)
        left, count = left[held], (right - left)[held]
        at = np.repeat(left - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.flatnonzero(reaches(np.bincount(self.owner[at], minlength=len(self.sizes)), len(query), self.sizes, percent))


def reaches(overlap, n, m, percent: int):
    return overlap * (100 + percent) >= percent * (n + m)


def classes(linked: np.ndarray) -> np.ndarray:
    """The least member reachable from each, from a symmetric matrix of links."""
    linked = linked | np.eye(len(linked), dtype=bool)
    label = np.arange(len(linked))
    while True:
        least = np.where(linked, label, len(label)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _within(members: DataFrame, percent: int) -> DataFrame:
    """(d, class) of each set: a set of its block that links reach from it."""
    kind = dict(members.dtypes)["d"]

    def run(rows: pa.Table) -> pa.Table:
        block = Block(rows.column("tokens"))
        links = reaches(block.within(), block.sizes[:, None], block.sizes[None], percent)
        return pa.table({"d": rows.column("d"), "class": rows.column("d").take(pa.array(classes(links)))})

    return members.select("home", "block", "d", "tokens").groupBy("home", "block").applyInArrow(run, f"d {kind}, class {kind}")


def _across(asked: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the queries asked (d, home, block) with members of those blocks."""
    kind = dict(members.dtypes)["d"]
    queries = members.select(F.col("d").alias("q"), F.col("tokens").alias("sought")).join(asked.select(F.col("d").alias("q"), "home", "block"), "q")
    chunks = asked.groupBy("home", "block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    held = members.join(chunks, ["home", "block"]).select("home", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "d", "tokens")
    queries = queries.join(chunks, ["home", "block"]).select("home", "block", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int").alias("chunk"), "q", "sought").toDF("to", "to_block", "to_chunk", "q", "sought")

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        a, b = [], []
        if rows.num_rows:
            block, names = Block(rows.column("tokens")), rows.column("d").to_pylist()
            for d, tokens in zip(queries.column("q").to_pylist(), queries.column("sought"), strict=True):
                found = block.overlaps(tokens.values.to_numpy(), percent)
                a += [d] * len(found)
                b += [names[i] for i in found]
        return pa.table({"a": pa.array(a, queries.schema.field("q").type), "b": pa.array(b, queries.schema.field("q").type)})

    return held.groupBy("home", "block", "chunk").cogroup(queries.groupBy("to", "to_block", "to_chunk")).applyInArrow(run, f"a {kind}, b {kind}")


def _ask(cells: DataFrame, rows: int, percent: int) -> DataFrame:
    """(d, home, block): the blocks each set asks. cells: (token, d, low, n, home, block, class, size), written.

    A set asks a block that holds one of its tokens in a larger class than its own, if their sizes can link; so of two
    classes that share a token, the sets of the smaller one ask. None is sent to its own block, which has compared it.
    """
    several = cells.groupBy("token").agg(F.min("class").alias("first"), F.max("class").alias("last"), F.count(F.lit(1)).alias("rows")).where("first <> last").select("token", "rows")
    apart = keep(join_hot(cells, several, ["token"], "rows", max(1, rows)), "apart")
    held = apart.groupBy("token", "home", "block").agg(F.max(F.struct("size", "class")).alias("to_rank"), F.min("low").alias("least"), F.max("n").alias("most"))
    held = held.select("token", "to_rank", F.col("home").alias("to_home"), F.col("block").alias("to_block"), "least", "most")
    met = apart.join(held, "token").where((F.struct("size", "class") < F.col("to_rank")) & ((F.col("home") != F.col("to_home")) | (F.col("block") != F.col("to_block"))))
    fits = (100 * F.col("n") >= percent * F.col("least")) & (percent * F.col("low") <= 100 * F.col("most"))
    return met.where(fits).select("d", F.col("to_home").alias("home"), F.col("to_block").alias("block")).distinct()


def join_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id: the least doc_id reachable over links of percent and more."""
    rows = keep(_sets(docs, words, percent), "sets")
    sets = rows.where("doc_id IS NOT NULL AND n > 0")
    total = sets.agg(F.coalesce(F.sum(F.size("columns")), F.lit(0))).first()[0]
    same = keep(sets.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "same")
    copies = keep(join_hot(sets.select("doc_id", "s1", "s2"), same, ["s1", "s2"], "rows", max(1, rows.count())).where("doc_id <> node").select("doc_id", "s1", "s2", "node").distinct(), "copies")

    # 2. the tokens that are looked at; all, where a doc_id has several sets
    spread = sets.select(F.explode("columns").alias("token"), F.col("doc_id").alias("d"))
    often = keep(spread.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "often")
    met = join_hot(spread, often, ["token"], "rows", max(1, total))
    named = sets.select(F.col("doc_id").alias("d"), "n", "p", "s1", "s2", F.size("columns").alias("k")).join(copies.select(F.col("doc_id").alias("d"), "s1", "s2"), ["d", "s1", "s2"], "left_anti").groupBy("d").agg(F.min("n").alias("low"), F.max("n").alias("n"), F.sum("k").alias("k"), F.when(F.count(F.lit(1)) == 1, F.max("p")).otherwise(F.sum("k")).alias("p"))
    of = Window.partitionBy("d")
    ranked = met.join(named, "d").withColumn("place", F.row_number().over(of.orderBy("rows", "token"))).withColumn("m", F.count(F.lit(1)).over(of))
    looked = keep(ranked.where("place <= p - (k - m)").select("token", "d", "low", "n"), "looked")
    drop(often)
    shared = keep(looked.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "shared")
    met = looked.count()
    many = keep(join_hot(looked, shared, ["token"], "rows", max(1, met)), "many")
    drop(looked)

    # 3. groups and their blocks
    owned = many.groupBy("d", "low", "n").agg(F.collect_list(F.struct("token", "rows")).alias("own"))  # p tokens at most
    homes = keep(owned.select("d", "n", F.array_min(F.transform(F.filter("own", lambda x: 2 * x["rows"] >= F.array_max("own.rows")), lambda x: x["token"])).alias("home")), "homes")
    room = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / VOLUME)).cast("int")
    groups = homes.groupBy("home").agg(room.alias("blocks"), F.count(F.lit(1)).alias("rows"))
    homes = keep(join_hot(homes, groups, ["home"], "rows", max(1, homes.count())).select("d", "n", "home", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int").alias("block")), "homes")
    # most texts have no home: a table of at most BUCKETS hashes, broadcast, keeps them from being moved
    bucket = F.pmod(F.xxhash64("d"), F.lit(BUCKETS)).alias("bucket")
    texts = docs.select(F.col("doc_id").alias("d"), "text").withColumn("bucket", bucket).join(F.broadcast(homes.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    texts = texts.join(homes.select("d", "home", "block"), "d")
    members = keep(_tokens(texts, words), "members")

    # 4. own blocks
    inner = keep(_within(members, percent), "classes")
    links = inner.select(F.col("d").alias("a"), F.col("class").alias("b"))
    # 5. other blocks: one set a class, then all that still meet another class
    named, rest = inner, inner.where("d = class").select("d").distinct()
    for turn in range(2):
        of = homes.join(named, "d", "left").groupBy("d", "home", "block").agg(F.coalesce(F.min("class"), F.col("d")).alias("class"))
        of = of.join(of.groupBy("class").agg(F.count(F.lit(1)).alias("size")), "class")
        cells = many.select("token", "d", "low", "n").join(of if turn else of.join(rest, "d", "left_semi"), "d")
        cells = keep(cells if turn else cells.where("token = home"), "cells")
        found = keep(_across(keep(_ask(cells, met, percent), "asked"), members, percent), "links")
        drop(cells)
        links = links.union(found)
        if turn == 0:
            named = components(links).select(F.col("id").alias("d"), F.col("component").alias("class"))
            links = named.select(F.col("d").alias("a"), F.col("class").alias("b"))  # stars join what the links join
    found = components(links.union(copies.select("doc_id", "node")))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(documents(spark, sf_dir), words=3, percent=90)
