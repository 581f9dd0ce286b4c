"""Language-model scores by online logistic context mixing.

A text is its words, A-Z lower-cased, and an end. Each word is a path of bits in a Huffman tree over the TOP commonest
words and three more leaves: the end, a rarer known word (whose share of all rarer ones follows), and an unknown word
(whose bytes follow). Every bit is predicted in contexts that run over words: the node alone, the node
with the word before, with the two words before, and the node in this text so far; the bits of an unknown word with its
last one to three bytes, in a Huffman tree of bytes. A mixer weighs their stretched probabilities by a gate (kind, depth, and how often the text
and the word before have been here); an adaptive table then refines the mixed probability by gate and level.
bits_per_byte is the total over the bytes of the text.

Online: within a text, the counts of its own nodes grow bit by bit, and weights and refining table are learned after
each block of STEP words, from a start that all texts share. All texts of a group go through their blocks side by side.

From the corpus: exact counts of all words, which grow with it, and counts of the hashed contexts, from all learned
texts, in SLOTS cells. The tree, the cells, the mixer and the refining table are broadcast; no input changes their
size. Texts are read once and written as codes into the dictionary of their block (a run of documents in one task);
dictionaries, not words, are shuffled and joined to their counts, and go back to a row a block. The cells of blocks are summed in a tree of groups.
The mixer's start comes from all learned texts: each block goes through its own from the same numbers, a few thousand,
and what blocks end with is averaged, by their texts. A learner leaves one sighting of each bit out, and words seen once
are unknown to it, so that it is set for unseen text.

Null texts count as empty: the end alone. A null doc_id is not held out. Ids go through tasks as strings, so that they may be
of any type that can be cast to a string and back. Repeated rows are learned from and scored as
rows. With nothing to learn from, all words are unknown and all contexts even. Long texts go in slices of SLICE words
with what they have learned carried on. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep

TOP, SLOTS, STEP, SLICE = 1 << 13, 1 << 20, 64, 40_000
#: A block of documents ends at so many bytes; cells are shuffled in SLICES parts, FAN of which are summed at once.
BLOCK_BYTES, SLICES, FAN = 12_000_000, 16, 32
DELTA, RATE, LIMIT, LEVELS, APM_WEIGHT = 0.4, 0.02, 8.0, 17, 20.0
#: Gates of bits of words (depth, sightings in the text, sightings after the word before) and of bytes (depth, sightings after three bytes).
WORD_GATES, GATES, INPUTS = 6 * 3 * 3, 6 * 3 * 3 + 8 * 3, 5
_M, _N = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(64 - SLOTS.bit_length() + 1)


class Code:
    """A Huffman tree over leaves with weights: the path of each leaf, and the weight on both sides of each node."""

    def __init__(self, weights: list[int]):
        n = len(weights)
        parent, side, sums = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.int8), np.zeros((n - 1, 2))
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        for node in range(n - 1):
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            parent[left] = parent[right] = node
            side[right], sums[node] = 1, (a, b)
            heapq.heappush(heap, (a + b, n + node))
        self.stretched = np.clip(np.log((sums[:, 1] + DELTA) / (sums[:, 0] + DELTA)), -LIMIT, LIMIT).astype(np.float32)
        at, paths = np.arange(n), []
        while (parent[at] >= 0).any():
            paths.append((np.where(parent[at] >= 0, parent[at], -1), side[at]))
            at = np.where(parent[at] >= 0, n + parent[at], at)
        nodes, bits = (np.array([x[i] for x in reversed(paths)]).T for i in (0, 1))
        live = nodes >= 0
        self.nodes, self.bits, self.offsets = nodes[live], bits[live], np.append(0, np.cumsum(live.sum(axis=1)))
        self.spread = spread(np.arange(n - 1))
        self.steps = self.nodes << 8 | np.minimum(_runs(live.sum(axis=1))[1], 127) << 1 | self.bits  # read at once

    def path(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The length of each leaf's path; the depth (127 at most), node and bit of each step of the paths laid end to end."""
        lengths = self.offsets[leaves + 1] - self.offsets[leaves]
        at = np.repeat(self.offsets[leaves] - np.cumsum(lengths) + lengths, lengths)
        at += np.arange(len(at))
        steps = self.steps[at]
        return lengths, (steps >> 1) & 127, steps >> 8, steps & 1


class WordCode(Code):
    """The tree of words, and under its unknown leaf that of bytes."""

    def __init__(self, top: list[int], rare: int, unknown: int, ends: int, letters: list[int]):
        """Weights of the commonest words, the rarer ones, unknown ones, the end, and the 256 bytes."""
        super().__init__([*top, max(1, rare), max(1, unknown), max(1, ends)])
        self.rare, self.unknown, self.end = len(top), len(top) + 1, len(top) + 2
        self.letters = Code([x + 1 for x in letters])


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of these lengths laid end to end: each place's item, and its place in the item."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def spread(*values: np.ndarray | int) -> np.ndarray:
    """A hash of rows of values, below SLOTS."""
    h = np.zeros(1, np.uint64)
    for x in values:
        h = ((h ^ (h >> np.uint64(29))) + np.asarray(x).astype(np.uint64)) * _N
    h = (h ^ (h >> np.uint64(32))) * _M
    return ((h ^ (h >> np.uint64(29))) * _N >> _SHIFT).astype(np.int64)


def slot(kind: int, node: np.ndarray, *context: np.ndarray) -> np.ndarray:
    """The cell of each node in a hashed context: both are hashed apart, as a context has many nodes."""
    return spread(node) ^ spread(kind, *context)


class Events:
    """The bits of a group of texts: text, block, bit and cells, of the words and of the bytes of unknown words.

    Both are in order of blocks. They share no gate, so that they can be gone through one after the other.
    """

    def __init__(self, code: WordCode, leaves: np.ndarray, text: np.ndarray, place: np.ndarray, before: np.ndarray, words: list[bytes]):
        """leaves, text, place, before: of each word, before having the two leaves before it; words: the bytes of each unknown one."""
        by_block = np.argsort((place // STEP).astype(np.uint16) if place.max(initial=0) < STEP << 16 else place // STEP, kind="stable")
        unknown = leaves == code.unknown
        spelt = (np.cumsum(unknown) - 1)[by_block[unknown[by_block]]].tolist()
        leaves, text, place, before, words = leaves[by_block], text[by_block], place[by_block], before[by_block], [words[i] for i in spelt]
        lengths, self.depth, self.node, bit = code.path(leaves)
        self.words, at = len(bit), code.spread[self.node]
        last, second = before[:, 0], before[:, 1]
        self.cells = [at ^ np.repeat(x, lengths) for x in (spread(1, last), spread(2, last, second))]
        whose, letter_lengths, self.position, letter_bit, self.byte_cells = _spelt(code, words)
        spelt = np.flatnonzero(leaves == code.unknown)[whose]
        self.text = np.repeat(np.append(text, text[spelt]), np.append(lengths, letter_lengths))
        self.bit = np.concatenate([bit, letter_bit])
        #: (first, past the last, texts) of each block of bits, of the words and then of the bytes.
        self.blocks = [*_blocks(place, text, lengths, 0), *_blocks(place[spelt], text[spelt], letter_lengths, self.words)]

    def sightings(self) -> np.ndarray:
        """How often each cell saw a zero and a one."""
        bit, cut = self.bit, self.words
        at = np.concatenate([*(2 * x + bit[:cut] for x in self.cells), *(2 * x + bit[cut:] for x in self.byte_cells)])
        return np.bincount(at, minlength=2 * SLOTS)


def _spelt(code: WordCode, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The bytes of unknown words, their ends as 0: of each byte its word and its number of bits; depth, bit and cells of each bit."""
    data = np.frombuffer(b"".join(x + b"\0" for x in words), np.uint8)
    whose, k = _runs(np.array([len(x) + 1 for x in words], np.int64))
    one, two, three = (np.where(k >= i, np.roll(data, i), 0) for i in (1, 2, 3))
    lengths, depth, node, bit = code.letters.path(data.astype(np.int64))
    at = code.letters.spread[node]
    cells = [at ^ spread(3), *(at ^ np.repeat(x, lengths) for x in (spread(4, one), spread(5, one, two), spread(6, one, two, three)))]
    return whose, lengths, depth, bit, cells


def _blocks(place: np.ndarray, text: np.ndarray, lengths: np.ndarray, start: int) -> list[tuple[int, int, int]]:
    """Of items in order of blocks, each so many bits long: the bits of each block from start on, and how many texts have come so far."""
    if not len(place):
        return []
    block = place // STEP
    first = np.append(0, np.flatnonzero(block[1:] != block[:-1]) + 1)
    ends = start + np.append(0, np.cumsum(lengths))[np.append(first, len(place))]
    return list(zip(ends[:-1].tolist(), ends[1:].tolist(), (np.maximum.reduceat(text, first) + 1).tolist(), strict=True))


def _earlier(key: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many zeros and ones of the same key come before each place."""
    packed = key.astype(np.int64)  # a key's places in order, with their bits
    packed <<= 32
    packed |= np.arange(len(key)) << 1
    packed |= bit
    packed.sort()
    low, key = packed.astype("<i8", copy=False).view("<i4").reshape(-1, 2).T
    bit, place = low & 1, np.arange(len(low), dtype=np.int32)
    ones = np.cumsum(bit, dtype=np.int32)
    ones -= bit
    start = place.copy()
    start[1:] *= key[1:] != key[:-1]
    np.maximum.accumulate(start, out=start)
    ones -= ones[start]
    place -= start
    place -= ones
    order, both = low >> 1, np.empty((2, len(low)), np.int32)
    both[0, order], both[1, order] = place, ones
    return both[0], both[1]


class Mixer:
    """Weights by gate, and the refining table: counts of zeros and ones by (gate, level of the mixed probability)."""

    def __init__(self):
        self.weights = np.full((GATES, INPUTS), 0.3)
        self.weights[:, -1] = 0
        even = squash((np.arange(LEVELS) - LEVELS // 2) * (LIMIT / (LEVELS // 2)))
        self.refined = np.stack([np.tile((1 - even) * APM_WEIGHT, (GATES, 1)), np.tile(even * APM_WEIGHT, (GATES, 1))], axis=-1)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -LIMIT - 4, LIMIT + 4)))


class Cells:
    """Sightings of each cell, of a zero and of a one, and what they say of the next bit."""

    def __init__(self, counts: np.ndarray, leave_out: bool = False):
        """leave_out: two values a cell, one without a sighting of a zero, one without one of a one."""
        zero, one = counts[0::2], counts[1::2]
        if leave_out:
            zero, one = np.stack([np.maximum(zero - 1, 0), zero], axis=1).ravel(), np.stack([one, np.maximum(one - 1, 0)], axis=1).ravel()
        seen = zero + one
        #: None, up to 3, up to 7, or more sightings.
        self.grade, self.stretched = (seen > 0).astype(np.int8) + (seen > 3) + (seen > 7), stretch(zero, one)


def stretch(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    ratio = (one.astype(np.float32) + np.float32(DELTA)) / (zero.astype(np.float32) + np.float32(DELTA))
    return np.clip(np.log(ratio, out=ratio), -LIMIT, LIMIT, out=ratio)


def inputs(events: Events, code: WordCode, cells: Cells, zero: np.ndarray, one: np.ndarray, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """Stretched probabilities of a one, a row a context and one bias, and the gate of each bit. zero, one: what the text saw at its nodes.

    leave_out: one sighting of the bit at hand is left out of cells, which were made for that.
    """
    cut, n = events.words, len(events.bit)
    at = lambda own, part: 2 * own + events.bit[part] if leave_out else own
    x, gate = np.empty((INPUTS, n), np.float32), np.empty(n, np.int64)
    words, letters = slice(0, cut), slice(cut, n)
    code.stretched.take(events.node, out=x[0, words], mode="clip")
    places = at(events.cells[0], words)
    cells.stretched.take(places, out=x[1, words], mode="clip")
    after = cells.grade[places]
    cells.stretched.take(at(events.cells[1], words), out=x[2, words], mode="clip")
    x[3, words] = stretch(zero, one)
    here, own = zero + one, gate[words]
    np.minimum(events.depth, 5, out=own)
    own *= 3
    own += here > 0
    own += here > 3
    own *= 3
    own += (after + np.int8(1)) >> 1
    for k, byte_cells in enumerate(events.byte_cells):
        places = at(byte_cells, letters)
        cells.stretched.take(places, out=x[k, letters], mode="clip")
    gate[letters] = WORD_GATES + np.minimum(events.position, 7) * 3 + np.minimum(cells.grade[places], 2)
    x[4] = 0.3
    return x, gate


def run_through(events: Events, x: np.ndarray, gate: np.ndarray, weights: np.ndarray, refined: np.ndarray | None) -> np.ndarray:
    """Bits of each text. weights (input, text x gate) and refined (text x gate x level x bit) learn after each block of a text.

    Texts come longest first, so that those that go on at a block are the first ones. Without refined, nothing is
    priced: the sightings of all texts by gate, level and bit come back instead.
    """
    places = events.text * GATES
    places += gate
    sign = (2 * events.bit - 1).astype(np.float32)
    dots, off = np.empty((2, len(gate)), np.float32)  # off: the bit less its probability
    for low, high, live in events.blocks:
        own, n = slice(low, high), live * GATES
        at, rows, z = places[own], x[:, own], off[own]
        dot = np.add.reduce(weights.take(at, axis=1) * rows, axis=0, out=dots[own])
        np.multiply(dot, sign[own], out=z)
        np.minimum(z, LIMIT + 4, out=z)
        np.maximum(z, -LIMIT - 4, out=z)
        np.exp(z, out=z)
        z += 1
        np.divide(sign[own], z, out=z)
        # one step a gate and text: the sum of the block's gradients over the root of their number
        rates = RATE / np.sqrt(np.maximum(np.bincount(at, minlength=n), 1))
        for own_weights, step in zip(weights, rows * (z * rates.astype(np.float32).take(at)), strict=True):
            np.add.at(own_weights, at, step)
    half = LEVELS // 2
    dots *= half / LIMIT
    np.rint(dots, out=dots)
    np.clip(dots, -half, half, out=dots)
    dots += half
    level = (gate if refined is None else places) * LEVELS
    level += dots.astype(np.int64)
    seen = 2 * level + events.bit
    if refined is None:
        return np.bincount(seen, minlength=2 * GATES * LEVELS)
    pairs, both = np.empty(len(level), np.complex64), refined.view(np.complex64)  # the counts of a zero and of a one
    for low, high, _ in events.blocks:
        both.take(level[low:high], out=pairs[low:high], mode="clip")
        np.add.at(refined, seen[low:high], np.float32(1))
    pairs = pairs.view(np.float32)
    p = pairs[2 * np.arange(len(level)) + events.bit]
    p /= pairs[0::2] + pairs[1::2]
    off *= sign
    p -= off
    p += 1
    p *= np.float32(0.5)
    np.clip(p, 1e-5, 1 - 1e-5, out=p)
    return np.bincount(events.text, np.log(p, out=p), int(events.text.max()) + 1) / -math.log(2)


class Texts:
    """A block's documents as leaves, and what its dictionary says of them."""

    def __init__(self, code: WordCode, found: pd.DataFrame, learner: bool):
        """found: (code, word, leaf, c), a row for each word of the dictionary; word is null from two sightings. learner: words seen once are unknown."""
        n, at = len(found), found["code"].to_numpy()
        self.code, self.c = code, np.zeros(n, np.int64)
        self.c[at] = found["c"]
        leaf = found["leaf"].to_numpy(np.float64, na_value=np.nan)
        self.leaf = np.empty(n, np.int64)
        self.leaf[at] = np.where(np.isnan(leaf), code.rare, leaf)
        self.leaf[self.c <= learner] = code.unknown
        self.words = np.empty(n, object)
        odd = found["c"].to_numpy() < 2
        self.words[at[odd]] = [x.encode() for x in found["word"][odd]]

    def groups(self, texts: list[np.ndarray]) -> Iterator[tuple[list[int], Events, np.ndarray, bool]]:
        """(texts, their events, the codes of all words in order, first) in groups of about SLICE words and up to 1,000 texts, each of which has a mixer; a longer text in slices."""
        group: list[tuple[int, int, int]] = []
        size = 0
        for i, own in enumerate(texts):
            for low in range(0, len(own) + 1, SLICE):
                high = min(len(own) + 1, low + SLICE)
                if group and (size + high - low > SLICE or len(group) == 1000 or low or group[0][1]):
                    yield self._events(group, texts)
                    group, size = [], 0
                group.append((i, low, high))
                size += high - low
        if group:
            yield self._events(group, texts)

    def _events(self, group: list[tuple[int, int, int]], texts: list[np.ndarray]):
        group = sorted(group, key=lambda x: x[1] - x[2])  # the longest first
        start = len(self.code.offsets)  # stands before a text
        leaves, before, words, used = [], [], [], []
        for i, low, high in group:
            whole = np.append(self.leaf[texts[i][max(0, low - 2) : high]], self.code.end)[: high - max(0, low - 2)]
            past = np.concatenate([np.full(max(0, 2 - low), start), whole])
            leaves.append(past[2:])
            before.append(np.stack([past[1:-1], past[:-2]], axis=1))
            own = texts[i][low:high]
            used.append(own)
            words += self.words[own[self.leaf[own] == self.code.unknown]].tolist()
        text, place = _runs(np.array([len(x) for x in leaves]))
        return [i for i, *_ in group], Events(self.code, np.concatenate(leaves), text, place, np.concatenate(before), words), np.concatenate(used), group[0][1] == 0


def sightings(texts: list[np.ndarray], own: Texts) -> np.ndarray:
    """How often each cell saw a zero and a one in all texts: the sum of their events' sightings.

    Words that recur after the same one or two words are counted first, so that their paths are gone through once.
    """
    code, total, some = own.code, np.zeros(2 * SLOTS, np.int64), SLICE
    start, span = len(code.offsets), len(code.offsets) + 1
    runs = np.cumsum([0, *(len(x) for x in texts)])[:-1] // (10 * SLICE)  # so many words at once
    for run in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(runs)) + 1):
        leaves = np.concatenate([y for i in run for y in ([start, start], own.leaf[texts[i]], [code.end])])
        at = np.flatnonzero(leaves != start)
        pairs = leaves[at - 1] * span + leaves[at]
        for kind in (1, 2):
            keys, counts = np.unique(pairs if kind == 1 else leaves[at - 2] * span**2 + pairs, return_counts=True)
            for low in range(0, len(keys), some):
                before, leaf = np.divmod(keys[low : low + some], span)
                lengths, _, node, bit = code.path(leaf)
                cells = code.spread[node] ^ np.repeat(spread(kind, *((before,) if kind == 1 else (before % span, before // span))), lengths)
                np.add.at(total, 2 * cells + bit, np.repeat(counts[low : low + some], lengths))
        codes = np.concatenate([texts[i] for i in run])
        words = own.words[codes[own.leaf[codes] == code.unknown]]
        for low in range(0, len(words), some):
            *_, bit, cells = _spelt(code, words[low : low + some].tolist())
            for x in cells:
                np.add.at(total, 2 * x + bit, 1)
    return total


def score(texts: list[np.ndarray], own: Texts, cells: Cells, mixer: Mixer, leave_out: bool = False) -> tuple[np.ndarray, Mixer]:
    """Bits of each text, but for the shares of rarer words; and the mixer as the texts left it, on average.

    leave_out: only the mixer is learned, from cells made to leave a sighting out.
    """
    bits, weights, refined, n = np.zeros(len(texts)), np.zeros((GATES, INPUTS)), np.zeros(mixer.refined.size), 0
    w = r = past = None
    order = np.argsort([-len(x) for x in texts], kind="stable")  # texts of like length end together
    for which, events, _, first in own.groups([texts[i] for i in order]):
        if first:
            w = np.tile(mixer.weights.T.astype(np.float32), len(which))
            r = None if leave_out else np.tile(mixer.refined.astype(np.float32).ravel(), len(which))
            past = None
        cut = events.words
        zero, one = _earlier(events.text[:cut] * len(own.code.offsets) + events.node, events.bit[:cut])
        if past is not None:
            zero, one = zero + past[0][events.node], one + past[1][events.node]
        if len(which) == 1:  # may go on
            now = [np.bincount(events.node, events.bit[:cut] == b, len(own.code.offsets)).astype(np.int64) for b in (0, 1)]
            past = now if past is None else [a + b for a, b in zip(past, now, strict=True)]
        x, gate = inputs(events, own.code, cells, zero, one, leave_out)
        found = run_through(events, x, gate, w, r)
        if leave_out:
            weights += w.reshape(INPUTS, -1, GATES).sum(axis=1, dtype=np.float64).T
            refined += found
            n += len(which)
        else:
            bits[order[which]] += found
        del events, x, gate, zero, one  # before the next group is made
    out = Mixer()
    if n:
        out.weights, out.refined = weights / n, mixer.refined + refined.reshape(mixer.refined.shape)
    return bits, out


# ---- in tasks ----


def _encode():
    """Batches of (doc_id, text, learned) to documents as codes, and a row for each word of its dictionary at the end of each block."""
    fields = pa.schema([("block", pa.string()), ("doc_id", pa.string()), ("n_bytes", pa.int64()), ("codes", pa.binary()), ("taught", pa.bool_()), ("code", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def coded(name: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, sizes, taught, words, counts = (pa.concat_arrays([x[i] for x in rows]) if i not in (1, 4) else np.concatenate([x[i] for x in rows]) for i in range(5))
        found = words.dictionary_encode()
        codes, n = found.indices.to_numpy().astype(np.int32), len(counts)
        ends = np.append(0, np.cumsum(counts))
        learned = np.bincount(codes[np.repeat(taught.to_numpy(zero_copy_only=False), counts)], minlength=len(found.dictionary)).astype(np.int64)
        binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(codes)])
        for low in range(0, n, 1000):
            own = slice(low, low + 1000)
            size = len(sizes[own])
            yield pa.RecordBatch.from_arrays([pa.array([name] * size), ids[own], pa.array(sizes[own], pa.int64()), binary[own], taught[own], *(pa.nulls(size, t) for t in fields.types[5:])], schema=fields)
        for low in range(0, len(learned), 10_000):
            own = slice(low, low + 10_000)
            size = len(learned[own])
            yield pa.RecordBatch.from_arrays([pa.array([name] * size), *(pa.nulls(size, t) for t in fields.types[1:5]), pa.array(np.arange(low, low + size), pa.int32()), found.dictionary[own], pa.array(learned[own])], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, rows, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                sizes = pc.binary_length(part.column(1)).to_numpy()
                lists = pc.ascii_split_whitespace(pc.ascii_lower(part.column(1)))
                words, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
                full = pc.greater(pc.binary_length(words), 0)
                rows.append((part.column(0), sizes, part.column(2), words.filter(full), np.bincount(of[full.to_numpy(zero_copy_only=False)], minlength=part.num_rows)))
                size += int(sizes.sum())
                if size > BLOCK_BYTES:
                    yield from coded(f"{task}-{number}", rows)
                    rows, size, number = [], 0, number + 1
        if rows:
            yield from coded(f"{task}-{number}", rows)

    return run


def _codes(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in rows["codes"]]


def packed(back: DataFrame) -> DataFrame:
    """Dictionaries (of, code, word, leaf, c) as a row a block, written; packed ones are left as they are."""
    if "counts" in back.columns:
        return back

    def pack(rows: pa.Table) -> pa.Table:
        at, c, leaf = rows["code"].to_numpy(), rows["c"].to_numpy(), pc.fill_null(rows["leaf"], -1).to_numpy()
        counts, leaves, odd = np.empty(len(at), np.int64), np.empty(len(at), np.int32), c < 2
        counts[at], leaves[at] = c, leaf
        words = pa.array(rows["word"].filter(pa.array(odd)).to_pylist(), pa.string())
        binary = [pa.array([x.tobytes()], pa.binary()) for x in (counts, leaves, at[odd].astype(np.int32))]
        return pa.table([pa.array([rows["of"][0].as_py()]), *binary, pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], ["of", "counts", "leaves", "odd", "words"])

    return keep(back.groupBy("of").applyInArrow(pack, "of string, counts binary, leaves binary, odd binary, words array<string>"), "dictionaries")


def _unpacked(found: pd.DataFrame) -> pd.DataFrame:
    """(code, word, leaf, c) of a block's packed dictionary; of none, no rows."""
    row = found.iloc[0] if len(found) else {"counts": b"", "leaves": b"", "odd": b"", "words": []}
    c, leaf = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["leaves"], np.int32)
    words = np.full(len(c), None, object)
    words[np.frombuffer(row["odd"], np.int32)] = row["words"]
    return pd.DataFrame({"code": np.arange(len(c)), "word": words, "leaf": np.where(leaf < 0, np.nan, leaf), "c": c})


def _summed(parts: DataFrame) -> DataFrame:
    """(slice, data): sums of cells over parts (part, slice, data), FAN at a time."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in rows["data"])
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "slice": [rows["slice"].iloc[0]], "data": [zlib.compress(total.tobytes(), 1)]})

    n = parts.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    while n > 1:
        n = -(-n // FAN)
        parts = keep(parts.withColumn("part", F.pmod("part", F.lit(n)).cast("int")).groupBy("part", "slice").applyInPandas(add, "part int, slice int, data binary"), "cells")
    return parts


def model(held: DataFrame, back: DataFrame, code) -> tuple:
    """Broadcast cells and mixer, from the learned rows of held (block, codes, ...) and the dictionaries back."""
    spark, held, back = back.sparkSession, held.where("taught"), packed(back)

    def count(documents_: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        total = sightings(_codes(documents_), Texts(code.value, _unpacked(found), True)) if len(documents_) else np.zeros(2 * SLOTS, np.int64)
        parts = total.reshape(SLICES, -1)
        return pd.DataFrame({"part": [zlib.crc32(str(found["of"].iloc[0] if len(found) else "").encode()) & 0x7FFFFFFF] * SLICES, "slice": range(SLICES), "data": [zlib.compress(x.tobytes(), 1) for x in parts]})

    cells = keep(held.groupBy("block").cogroup(back.groupBy("of")).applyInPandas(count, "part int, slice int, data binary"), "cells")
    numbered = cells.select(F.pmod("part", F.lit(max(1, cells.count() // SLICES))).cast("int").alias("part"), "slice", "data")
    rows = _summed(numbered).select("slice", "data").collect()  # of a size that no input changes
    counts = np.zeros((SLICES, 2 * SLOTS // SLICES), np.int64)
    for x in rows:
        counts[x.slice] += np.frombuffer(zlib.decompress(bytes(x.data)), np.int64)
    counts = spark.sparkContext.broadcast(counts.ravel().astype(np.int32 if counts.max(initial=0) < 1 << 31 else np.int64))

    def learned(documents_: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        mixer, texts = Mixer(), _codes(documents_)
        if not texts:
            return pd.DataFrame({"place": pd.Series(dtype=int), "value": pd.Series(dtype=float)})
        own, cells = Texts(code.value, _unpacked(found), True), Cells(counts.value, True)
        for low in range(0, len(texts), 50):  # each run of texts starts where the one before ended
            part = texts[low : low + 50]
            mixer = score(part, own, cells, mixer, True)[1]
        values = len(texts) * np.concatenate([[1.0], mixer.weights.ravel(), mixer.refined.ravel()])
        return pd.DataFrame({"place": np.arange(len(values)), "value": values})

    ends = keep(held.groupBy("block").cogroup(back.groupBy("of")).applyInPandas(learned, "place int, value double"), "mixers")
    found = ends.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()  # a mixer
    mixer = Mixer()
    if found:
        values, n = np.array([x.value for x in found]), mixer.weights.size
        values = values[1:] / values[0]
        mixer.weights, mixer.refined = values[:n].reshape(mixer.weights.shape), values[n:].reshape(mixer.refined.shape)
        # the table goes on from its shape, with the weight of APM_WEIGHT sightings
        mixer.refined *= APM_WEIGHT / np.maximum(mixer.refined.sum(axis=-1, keepdims=True), APM_WEIGHT)
    return counts, spark.sparkContext.broadcast(mixer)


def score_documents(docs: DataFrame, learned) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row.

    learned: a boolean column, true for the rows to learn from. base_score is the smoothed unigram sum.
    """
    kind = dict(docs.dtypes)["doc_id"]
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    coded = keep(texts.mapInArrow(_encode(), "block string, doc_id string, n_bytes long, codes binary, taught boolean, code int, word string, n long"), "codes")
    entries = coded.where("word IS NOT NULL").select("block", "code", "word", "n")
    words = keep(entries.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "words")
    ends = int(coded.where("taught").count())
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    total, distinct = int(sums.n) + ends, int(sums.v) + (ends > 0)
    top = words.where("c > 1").orderBy(F.desc("c"), "word").limit(TOP).collect()
    rare = int(sums.n) - sum(x.c for x in top)
    letters = words.select(F.explode(F.split(F.hex(F.col("word").cast("binary")), "(?<=\\G..)")).alias("byte")).where("byte <> ''").groupBy("byte").count().collect()  # 256 rows at most
    seen = {int(x.byte, 16): x["count"] for x in letters} | {0: int(sums.v)}
    code = spark.sparkContext.broadcast(WordCode([x.c for x in top], rare - int(sums.once), int(sums.once), ends, [seen.get(b, 0) for b in range(256)]))
    leaves = spark.createDataFrame([(x.word, i) for i, x in enumerate(top)], "word string, leaf int")
    known = words.join(F.broadcast(leaves), "word", "left")
    # a partition's own words are hashed: entries, of which there are many more, need no sorting
    back = packed(entries.select(F.col("block").alias("of"), "code", "word").join(known.hint("shuffle_hash"), "word", "left").select("of", "code", F.when(F.coalesce("c", F.lit(0)) < 2, F.col("word")).alias("word"), "leaf", F.coalesce("c", F.lit(0)).alias("c")))
    held = coded.where("codes IS NOT NULL").select("block", "doc_id", "n_bytes", "codes", "taught")
    counts, mixer = model(held, back, code)
    floor = math.log10(total + 0.5 * (distinct + 1))

    def total_up(documents_: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        own, texts_ = Texts(code.value, _unpacked(found), False), _codes(documents_)
        bits = score(texts_, own, Cells(counts.value), mixer.value)[0]
        base = np.log10(own.c + 0.5) - floor
        share = np.where(own.leaf == code.value.rare, np.log2(max(1, rare) / np.maximum(own.c, 1)), 0)
        bits += [share[x].sum() for x in texts_]
        out = documents_[["doc_id", "n_bytes"]].assign(n_tokens=[len(x) + 1 for x in texts_], n_known=[int((own.c[x] > 0).sum()) + (ends > 0) for x in texts_], train_tokens=total)
        out["base_score"] = [base[x].sum() + math.log10(ends + 0.5) - floor for x in texts_]
        return out.assign(score=-bits * math.log10(2), bits_per_byte=bits / (out["n_bytes"].to_numpy() + 1))

    schema = "doc_id string, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return held.drop("taught").groupBy("block").cogroup(back.groupBy("of")).applyInPandas(total_up, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    return score_documents(docs, ~out).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
