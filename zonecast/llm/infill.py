"""Fill-in-the-middle: documents cut into prefix, middle and suffix at units, and put together anew around sentinels.

A unit is a run of ASCII letters or any other single code point. One scan runs a byte automaton over the text: a table
gives, for each state and byte, the next state and what the step emits. UTF-8 continuation bytes emit nothing, the
first byte of a unit emits a unit, and the last byte of <P>, <S> or <M> a sentinel. The scan counts what is emitted,
block by block; that is all that the choice of the cuts needs. A second pass finds the cuts: the blocks' counts tell
which block holds a unit, and only that block's units are looked at.

The table is applied to all bytes of a batch at once: states start from a guess and are stepped from each byte's
predecessor until no state changes, which is when they are the automaton's run; as its state depends on the last three
bytes only, that takes four turns, whatever the text. Texts are scanned a PIECE at a time with the state handed on.

Where and how a document is cut follows from the SHA-256 of "1:" and its doc_id alone. Null texts count as empty; a
null doc_id is an empty number. Empty texts, and those that hold a sentinel, stay plain. Repeated rows each give a row,
cut alike. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: States: after no letter, in letters, after "<", after "<" and a sentinel's letter. Emitted: unit, sentinel.
OTHER, LETTERS, OPENED, NAMED = range(4)
UNIT, SENTINEL = 1, 2
BLOCK, PIECE = 4096, 1 << 22


def _table() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emissions of state * 256 + byte."""
    following, emitted = np.zeros((4, 256), np.uint8), np.zeros((4, 256), np.uint8)
    for state in range(4):
        for byte in range(256):
            letter = chr(byte).isascii() and chr(byte).isalpha()
            if letter:
                following[state, byte] = NAMED if state == OPENED and chr(byte) in "PSM" else LETTERS
                emitted[state, byte] = 0 if state in (LETTERS, NAMED) else UNIT
            elif 0x80 <= byte < 0xC0:
                following[state, byte] = OTHER
            else:
                following[state, byte] = OPENED if byte == ord("<") else OTHER
                emitted[state, byte] = UNIT | (SENTINEL if state == NAMED and byte == ord(">") else 0)
    return following.ravel(), emitted.ravel()


FOLLOWING, EMITTED = _table()


def scan(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """What each byte of data emits; begins: where texts begin."""
    out, state, places = np.empty(len(data), np.uint8), OTHER, np.searchsorted(begins, np.arange(0, len(data) + PIECE, PIECE))
    for i, low in enumerate(range(0, len(data), PIECE)):
        piece = data[low : low + PIECE]
        own = begins[places[i] : places[i + 1]] - low
        before, states = np.empty(len(piece), np.uint16), np.full(len(piece), OTHER, np.uint8)
        while True:
            before[0], before[1:] = state, states[:-1]
            before[own] = OTHER
            before <<= 8
            before |= piece
            after = FOLLOWING[before]
            if (after == states).all():
                break
            states = after
        out[low : low + PIECE] = EMITTED[before]
        state = states[-1]
    return out


class Units:
    """Counts of the units of texts that lie one after another, and the places of units by number."""

    def __init__(self, emitted: np.ndarray, bounds: np.ndarray):
        self.units, self.bounds = emitted & UNIT, bounds
        whole = np.zeros(-(-len(emitted) // BLOCK) * BLOCK, np.uint8)
        whole[: len(emitted)] = self.units
        self.before = np.concatenate([[0], np.cumsum(whole.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))])
        self.sentinels = np.flatnonzero(emitted & SENTINEL)
        self.upto = np.array([self._upto(int(x)) for x in bounds], np.int64)
        self.n = np.diff(self.upto)

    def _upto(self, place: int) -> int:
        block = place // BLOCK
        return int(self.before[block]) + int(self.units[block * BLOCK : place].sum())

    def marked(self) -> np.ndarray:
        """Whether each text has a sentinel."""
        return np.diff(np.searchsorted(self.sentinels, self.bounds)) > 0

    def place(self, text: int, unit: int) -> int:
        """Where the text's unit of this number begins: its end for the number of its units."""
        if unit >= self.n[text]:
            return int(self.bounds[text + 1])
        number = int(self.upto[text]) + unit
        block = int(np.searchsorted(self.before, number, "right")) - 1
        own = np.flatnonzero(self.units[block * BLOCK : (block + 1) * BLOCK])
        return block * BLOCK + int(own[number - self.before[block]])


def drawn(doc_id: Column, seed: int = 1) -> list[Column]:
    """The first four groups of 8 hex digits of the SHA-256 of seed:doc_id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def infilled(docs: DataFrame, percent: int = 90, suffix_first: int = 20, seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row: percent of the rows are cut, and suffix_first percent of these have form spm.

    Forms: plain, the text; psm, prefix, suffix, middle; spm, suffix, prefix, middle, each after its sentinel.
    """
    kind = dict(docs.dtypes)["doc_id"]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def told(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        lengths = np.array([len(x) for x in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        units = Units(scan(np.frombuffer(b"".join(texts), np.uint8), bounds[:-1][lengths > 0]), bounds)
        n, marked = units.n.tolist(), units.marked()
        rows = {x: [] for x in ("form", "prefix_chars", "middle_chars", "output")}
        for i, (h1, h2, h3, h4) in enumerate(zip(*(part.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)), strict=True)):
            text = texts[i]
            if not text or marked[i] or h3 % 100 >= percent:
                told = ("plain", None, None, text)
            else:
                low, high = sorted((h1 % (n[i] + 1), h2 % (n[i] + 1)))
                low, high = units.place(i, low) - bounds[i], units.place(i, high) - bounds[i]
                prefix, middle, suffix = text[:low], text[low:high], text[high:]
                spm = h4 % 100 < suffix_first
                told = ("spm" if spm else "psm", len(prefix.decode()), len(middle.decode()), b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)))
            for column, value in zip(rows.values(), told, strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(rows["form"]), pa.array(rows["prefix_chars"], pa.int64()), pa.array(rows["middle_chars"], pa.int64()), pa.array(rows["output"], pa.binary()).cast(pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, low = pc.binary_length(batch.column("text")).to_numpy(), 0
            ends = np.cumsum(sizes)
            while low < batch.num_rows:  # rows of about a piece, or one longer text
                high = max(low + 1, int(np.searchsorted(ends, PIECE + (ends[low - 1] if low else 0), "right")))
                yield told(batch.slice(low, high - low))
                low = high

    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), *[x.alias(f"h{i}") for i, x in enumerate(drawn(F.col("doc_id"), seed), 1)])
    return hashed.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again. A text that is cut holds no sentinel, and sentinels can't arise at its seams, so the first of each kind is the one put in."""
    after = lambda x: F.locate(x, output)
    between = lambda a, b: F.substring(output, F.lit(4) if a is None else after(a) + 3, (F.length(output) + 1 if b is None else after(b)) - (F.lit(4) if a is None else after(a) + 3))
    psm = F.concat(between(None, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(None, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infilled(documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda x: F.sha2(x, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
