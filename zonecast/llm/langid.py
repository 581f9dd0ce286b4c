"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language
is the sum over all ways to segment it into pieces, by the forward algorithm, whatever the word's length; a text's is
the product over its words, because pieces of this vocabulary never cross white space. A character that is no piece is
the product of its byte pieces. Words that are long or hold such characters are summed in log space, one position
after the other. Probabilities are learned by ROUNDS of expectation and maximisation from word counts a language:
expected piece counts are made where the words are, and summed by piece and language.

Data sizes: word counts are combined on the map side and shuffled by word; what is sent to the driver and broadcast
is one number a piece and learned language, bounded by the vocabulary times MOST_LANGUAGES. More languages are learned
and asked so many at a time, in code point order; a document keeps its likeliest language so far and the sum of all
likelihoods. Words are scored in blocks of arrays, each once a worker's cache; when the cache is large, only words met
again since it last was stay in it.

Null texts, and texts without a letter, are "und" with score 0. Rows with null text or lang are not learned from.
Where nothing can be learned every text is "und". Repeated rows are predicted alike; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, drop, keep

#: A cache holds CACHE_SIZE words, or fewer where many languages make it CACHE_CELLS numbers; arrays of words, BLOCK_CELLS numbers a position.
MOST_LANGUAGES, CACHE_SIZE, CACHE_CELLS, FLUSH, BLOCK_CELLS, LONGEST, SMOOTH, ROUNDS = 200, 600_000, 8_000_000, 200_000, 1 << 15, 24, 0.1, 2
#: Substrings are looked up by a polynomial hash modulo 2^64.
_P = np.uint64(0x9E3779B97F4A7C15)


def _spread(h: np.ndarray) -> np.ndarray:
    """Makes the top bits, by which the table is read, depend on all bits."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Vocabulary:
    """The pieces of a sentencepiece model, by the hash of their code points; unknown characters are byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        texts = [model.id_to_piece(i) for i in plain]
        self.size = size
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.longest = max(map(len, texts))
        self.letters = frozenset(x for x in texts if len(x) == 1)
        known = dict.fromkeys((x[:i] for x in texts for i in range(1, len(x))), -1) | dict(zip(texts, plain, strict=True))
        hashes = _spread(np.array([self.hash_one(x) for x in known], np.uint64))
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(known.values()))[order]
        self.slots = 1 << 20
        self.table = np.full(self.slots, -1, np.int32)  # first try of a lookup; others search
        top = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.table[top[::-1]] = np.arange(len(order))[::-1]
        self.runs = int(np.max(np.bincount(top, minlength=self.slots)))

    @staticmethod
    def hash_one(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids by hash; -1 for what only begins pieces, -2 for what begins none."""
        hashes = _spread(hashes)
        at = self.table[(hashes >> np.uint64(44)).astype(np.int64)]
        out = np.full(len(hashes), -2, np.int64)
        todo = np.flatnonzero(at >= 0)
        for step in range(self.runs):
            where = np.minimum(at[todo] + step, len(self.hashes) - 1)
            hit = self.hashes[where] == hashes[todo]
            out[todo[hit]] = self.ids[where[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def lattice(words: list[str], voc: Vocabulary) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Lengths of plain words with their start mark, and the edges (from, to, rows, piece ids) in order of their starts."""
    marked = ["▁" + w for w in words]
    lengths = np.array([len(w) for w in marked])
    width = int(lengths.max())
    points = np.frombuffer("".join(w.ljust(width, "\0") for w in marked).encode("utf-32-le"), np.uint32).reshape(len(words), width).astype(np.uint64)
    edges = []
    for start in range(width):
        live = np.flatnonzero(lengths > start)
        h = np.zeros(len(live), np.uint64)
        for end in range(start, min(width, start + voc.longest)):
            on = lengths[live] > end
            live, h = live[on], h[on]
            if not len(live):
                break
            h = h * _P + points[live, end] + np.uint64(1)
            ids = voc.find(h)
            hit = ids >= 0
            if hit.any():
                edges.append((start, end + 1, live[hit], ids[hit]))
            on = ids > -2
            live, h = live[on], h[on]
    return lengths, edges


def _block(langs: int) -> int:
    """How many words go through the arrays at once."""
    return max(64, BLOCK_CELLS // max(1, langs))


def plain(word: str, voc: Vocabulary) -> bool:
    """Whether no segmentation of the word can be too unlikely for a float: it is short, and all its characters are pieces."""
    return len(word) <= LONGEST and voc.letters.issuperset(word)


def forward(words: list[str], table: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """Natural log of the summed probability of all segmentations, a row a word and a column a language. Words of any length."""
    out = np.empty((len(words), table.shape[1]))
    short = [i for i, x in enumerate(words) if plain(x, voc)]
    size = _block(table.shape[1])
    for low in range(0, len(short), size):
        own = short[low : low + size]
        lengths, edges = lattice([words[i] for i in own], voc)
        alpha = np.zeros((int(lengths.max()) + 1, len(own), table.shape[1]))
        alpha[0] = 1
        for start, end, rows, ids in edges:  # all edges into a position come before those out of it
            alpha[end, rows] += alpha[start, rows] * table[ids]
        out[own] = np.log(alpha[lengths, np.arange(len(own))])
    if len(short) < len(words):
        logs = np.log(table)
        for i in set(range(len(words))).difference(short):
            out[i] = scan(*steps(words[i], voc), logs, voc)[-1]
    return out


def steps(word: str, voc: Vocabulary) -> tuple[int, list[list[tuple[int, int]]]]:
    """The length of a word with its start mark, and for each end the edges (start, piece id) into it; unknown characters as in lattice."""
    points = np.frombuffer(("▁" + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    into: list[list[tuple[int, int]]] = [[] for _ in range(len(points) + 1)]
    h = np.zeros(len(points), np.uint64)
    for size in range(1, min(voc.longest, len(points)) + 1):
        h = h[: len(points) - size + 1] * _P + points[size - 1 :] + np.uint64(1)
        ids = voc.find(h)
        for start in np.flatnonzero(ids >= 0).tolist():
            into[start + size].append((start, int(ids[start])))
        if size == 1:
            for start in np.flatnonzero(ids < 0).tolist():
                into[start + 1].append((start, -int(points[start]) - 2))
    return len(points), into


def _step(ids: list[int], logs: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """Log weights of edges, a row each."""
    out = logs[np.maximum(ids, 0)]
    for i, x in enumerate(ids):
        if x < 0:
            out[i] = logs[voc.bytes[list(chr(-x - 2).encode("utf-8", "surrogatepass"))]].sum(axis=0)
    return out


def scan(length: int, into: list[list[tuple[int, int]]], logs: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """Log of the summed probability of all segmentations up to each position, in log space."""
    alpha = np.zeros((length + 1, logs.shape[1]))
    for end in range(1, length + 1):
        start, ids = zip(*into[end], strict=True)
        alpha[end] = np.logaddexp.reduce(alpha[list(start)] + _step(ids, logs, voc), axis=0)
    return alpha


def scanned_uses(word: str, logs: np.ndarray, voc: Vocabulary, counts: np.ndarray, out: np.ndarray) -> None:
    """Adds to out the expected uses of each piece in counts sightings of the word, in log space."""
    length, into = steps(word, voc)
    alpha = scan(length, into, logs, voc)
    beta = np.full(alpha.shape, -np.inf)
    beta[length] = 0
    for end in range(length, 0, -1):
        start, ids = zip(*into[end], strict=True)
        ways = _step(ids, logs, voc) + beta[end]
        for k, (at, i) in enumerate(zip(start, ids, strict=True)):
            beta[at] = np.logaddexp(beta[at], ways[k])
            uses = np.exp(alpha[at] + ways[k] - alpha[length]) * counts
            for piece in [i] if i >= 0 else voc.bytes[list(chr(-i - 2).encode("utf-8", "surrogatepass"))]:
                out[piece] += uses


def expected(words: list[str], table: np.ndarray, voc: Vocabulary, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, a column a language, from counts (a row a word) under table. Words of any length.

    A table of one column stands for all languages.
    """
    out = np.zeros((voc.size, counts.shape[1]))
    short = [i for i, x in enumerate(words) if plain(x, voc)]
    if len(short) < len(words):
        logs = np.log(table)
        for i in set(range(len(words))).difference(short):
            scanned_uses(words[i], logs, voc, counts[i], out)
    if not short:
        return out
    lengths, edges = lattice([words[i] for i in short], voc)
    n, width = len(short), int(lengths.max())
    alpha, beta = np.zeros((width + 1, n, table.shape[1])), np.zeros((width + 1, n, table.shape[1]))
    alpha[0] = 1
    beta[lengths, np.arange(n)] = 1
    weights = [table[ids] for *_, ids in edges]
    for (start, end, rows, _), w in zip(edges, weights, strict=True):
        alpha[end, rows] += alpha[start, rows] * w
    for (start, end, rows, _), w in zip(reversed(edges), reversed(weights), strict=True):
        beta[start, rows] += beta[end, rows] * w
    scale = counts[short] / beta[0]
    used = np.concatenate([alpha[start, rows] * w * beta[end, rows] for (start, end, rows, _), w in zip(edges, weights, strict=True)])
    pieces, whose = np.concatenate([ids for *_, ids in edges]), np.concatenate([rows for *_, rows, _ in edges])
    for column in range(out.shape[1]):
        out[:, column] += np.bincount(pieces, used[:, column if used.shape[1] > 1 else 0] * scale[whose, column], voc.size)
    return out


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the place of each one's text; null has none."""
    lists = pc.utf8_split_whitespace(texts)
    words, of = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), of.filter(full).to_numpy()


def _word_counts(docs: DataFrame) -> DataFrame:
    """(word, lang, n) over all texts; combined on the map side."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            out = pa.concat_tables(held).group_by(["word", "lang"], use_threads=False).aggregate([("n", "sum")])
            return out.select(["word", "lang", "n_sum"]).rename_columns(["word", "lang", "n"])

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                words, of = _words(part.column(0))
                found = pa.table({"word": words, "lang": part.column(1).take(pa.array(of))}).group_by(["word", "lang"], use_threads=False).aggregate([([], "count_all")])
                held.append(found.select(["word", "lang", "count_all"]).rename_columns(["word", "lang", "n"]))
                if sum(map(len, held)) > 2 * FLUSH:
                    held = [summed()]
                    if len(held[0]) > FLUSH:
                        yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    return docs.select("text", "lang").mapInArrow(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table


def train(docs: DataFrame, path: str, rounds: int = ROUNDS) -> Model:
    """Learns from text and lang, in rounds of expectation and maximisation. The first starts from equal probabilities; SMOOTH is added to every expected count.

    Of more than MOST_LANGUAGES, the first in code point order are learned; identify() goes through all.
    """
    learned = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    langs = _languages(learned, None, MOST_LANGUAGES)
    return _trained(learned.where(F.col("lang") <= langs[-1]) if langs else learned, langs, path, rounds)


def _languages(learned: DataFrame, after: str | None, most: int) -> list[str]:
    """At most so many of the languages after the given one, in code point order."""
    left = learned if after is None else learned.where(F.col("lang") > after)
    return [x.lang for x in left.select("lang").distinct().orderBy("lang").limit(most).collect()]


def _trained(learned: DataFrame, langs: list[str], path: str, rounds: int) -> Model:
    """Of rows with a text and one of langs."""
    voc = vocabulary(path)
    table = np.full((voc.size, 1), 1 / voc.size)  # one column does for all languages, while they are equal
    if not langs:
        return Model([], table)
    counted = keep(_word_counts(learned), "words")
    for _ in range(rounds):
        held = learned.sparkSession.sparkContext.broadcast(table)

        def uses(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            voc, n, size = vocabulary(path), len(langs), _block(len(langs))
            total, names = np.zeros((voc.size, n)), pa.array(langs, pa.string())
            for batch in batches:
                found = batch.column("word").dictionary_encode()
                words = found.dictionary.to_pylist()
                cells = found.indices.to_numpy().astype(np.int64) * n + pc.index_in(batch.column("lang"), names).to_numpy()
                counts = np.bincount(cells, batch.column("n").to_numpy(), len(words) * n).reshape(-1, n)
                order = np.argsort(pc.utf8_length(found.dictionary).to_numpy(), kind="stable")
                for low in range(0, len(order), size):
                    own = order[low : low + size]
                    total += expected([words[i] for i in own], held.value, voc, counts[own])
            pieces, cols = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(pieces.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(total[pieces, cols])], ["piece", "lang", "uses"])

        found = counted.mapInArrow(uses, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        total = np.full((voc.size, len(langs)), SMOOTH)
        total[found["piece"].to_numpy(), found["lang"].to_numpy()] += found["uses"].to_numpy()
        table = total / total.sum(axis=0)
    drop(counted)
    return Model(langs, np.broadcast_to(table, (voc.size, len(langs))))


_caches: dict = {}


class Scores:
    """Words to their row of log probabilities; new words are scored in blocks.

    Two caches of half the size: when the younger is full, it takes the place of the older, and words found there come back.
    """

    def __init__(self, model: Model, path: str):
        self.model, self.voc = model, vocabulary(path)
        self.most = min(CACHE_SIZE, CACHE_CELLS // max(1, len(model.langs))) // 2
        self.at: dict[str, int] = {}
        self.rows = np.empty((0, len(model.langs)))
        self.older = self.at, self.rows

    def of(self, words: list[str]) -> np.ndarray:
        """A row for each of the words, which are distinct."""
        if self.at and len(self.at) + len(words) > self.most:
            self.older, self.at, self.rows = (self.at, self.rows), {}, np.empty((0, self.rows.shape[1]))
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            low, high = len(self.at), len(self.at) + len(new)
            if high > len(self.rows):
                self.rows = np.concatenate([self.rows[:low], np.empty((max(2 * low, high) - low, self.rows.shape[1]))])
            names = [words[i] for i in new]
            past = np.fromiter(map(self.older[0].get, names, repeat(-1)), np.int64, len(names))
            self.rows[low:high][past >= 0] = self.older[1][past[past >= 0]]
            todo = np.array(sorted(np.flatnonzero(past < 0).tolist(), key=lambda i: len(names[i])), np.int64)
            if len(todo):
                self.rows[low + todo] = forward([names[i] for i in todo], self.model.table, self.voc)
            self.at.update(zip(names, range(low, high), strict=True))
            at[new] = np.arange(low, high)
        return self.rows[at]


def _asked(rows: DataFrame, model: Model, path: str, last: bool) -> DataFrame:
    """rows (..., text, lang_pred, best, mass) after the model's languages: the likeliest one so far, the log of its likelihood and of the sum of all.

    A text without a letter is "und". The last model's rows come without the text.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if not last or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        if _caches.get("model") is not model:
            _caches.update(model=model, scores=Scores(model, path))
        scores = _caches["scores"]
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts, n = part.column("text"), part.num_rows
                words, of = _words(texts)
                found = words.dictionary_encode()
                logs, codes = scores.of(found.dictionary.to_pylist()), found.indices.to_numpy()
                total = np.stack([np.bincount(of, np.ascontiguousarray(x)[codes], n) for x in logs.T], axis=1)
                best = total.argmax(axis=1)
                top = total[np.arange(n), best]
                mass = top + np.log(np.exp(np.maximum(total - top[:, None], -700)).sum(axis=1))
                was, sum_was = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("best", "mass"))  # null: nan
                first = np.isnan(was)
                better = first | (top > was)
                pred = [("und" if not any(map(str.isalpha, t.as_py() or "")) else model.langs[k] if b else p.as_py()) for t, k, b, p in zip(texts, best, better, part.column("lang_pred"), strict=True)]
                new = {"lang_pred": pa.array(pred, pa.string()), "best": pa.array(np.where(better, top, was)), "mass": pa.array(np.where(first, mass, np.logaddexp(mass, np.where(first, mass, sum_was))))}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c) for c in names], names)

    return rows.mapInArrow(run, T.StructType([f for f in rows.schema.fields if f.name in names]))


def _begun(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"lang_pred": F.lit(None).cast("string"), "best": F.lit(None).cast("double"), "mass": F.lit(None).cast("double")})


def _ended(rows: DataFrame) -> DataFrame:
    sure = F.when(F.col("lang_pred") != "und", F.least(F.exp(F.col("best") - F.col("mass")), F.lit(1.0)))
    return rows.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce(sure, F.lit(0.0)).alias("score"))


def predict(docs: DataFrame, model: Model, path: str) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its posterior probability under equal priors."""
    rows = _begun(docs.select("doc_id", "text"))
    return _ended(_asked(rows, model, path, True) if model.langs else rows)


def identify(docs: DataFrame, taught: DataFrame, path: str, rounds: int = ROUNDS, most: int = MOST_LANGUAGES) -> DataFrame:
    """predict() of docs by all languages of taught (text, lang), of which most are learned and asked at a time."""
    rows, learned = _begun(docs.select("doc_id", "text")), taught.where("text IS NOT NULL AND lang IS NOT NULL")
    langs = _languages(learned, None, most + 1)
    while langs:
        own, last = langs[:most], len(langs) <= most
        model = _trained(learned.where((F.col("lang") >= own[0]) & (F.col("lang") <= own[-1])), own, path, rounds)
        asked = _asked(rows, model, path, last)
        rows = asked if last else keep(asked, "asked")
        langs = [] if last else _languages(learned, own[-1], most + 1)
    return _ended(rows)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return identify(docs, docs.where(~out), path).select("doc_id", out.alias("held_out"), "lang_pred", "score")
