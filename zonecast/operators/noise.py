"""Uniform noise of one seeded legacy generator, drawn in blocks by tasks: bit for bit the sequence of one process.

The generator's 32-bit words are a linear recurrence over bits, so the words from any place on are sums (exclusive or)
of early words: those whose powers are in x^place modulo the recurrence's polynomial. The driver finds the polynomial
once from the generator's own bits; a task starts its block at its place, whatever it is, with a few polynomial squares.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words of the generator's state and bits of its recurrence.
WORDS, DEGREE = 624, 19937
BLOCK = 1 << 20


def _words(seed: int, count: int) -> np.ndarray:
    """The first raw words that the seeded generator makes, at least count."""
    generator, out = np.random.MT19937(), []
    generator.state = {"bit_generator": "MT19937", "state": {"key": np.random.RandomState(seed).get_state()[1], "pos": WORDS}}
    while len(out) * WORDS < count:
        generator.random_raw(WORDS)
        out.append(generator.state["state"]["key"].astype(np.uint32))
    return np.concatenate(out)


@lru_cache(maxsize=1)
def exponents() -> tuple[int, ...]:
    """Exponents of the recurrence's polynomial: the shortest one that a bit of the words follows (Berlekamp and Massey)."""
    bits = (_words(1, 2 * DEGREE + 64) & np.uint32(1)).tolist()
    found, before, length, shift, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = (seen << 1) | bit
        if (found & seen).bit_count() & 1:
            now = found ^ (before << shift)
            if 2 * length <= n:
                before, length, shift = found, n + 1 - length, 1
            else:
                shift += 1
            found = now
        else:
            shift += 1
    return tuple(length - i for i in range(length, -1, -1) if found >> i & 1)


def _reduced(poly: int, lower: tuple[int, ...]) -> int:
    while (high := poly >> DEGREE) != 0:
        poly &= (1 << DEGREE) - 1
        for e in lower:
            poly ^= high << e
    return poly


_SPREAD = np.array([sum((b >> i & 1) << (2 * i) for i in range(8)) for b in range(256)], "<u2")


def _squared(poly: int) -> int:
    return int.from_bytes(_SPREAD[np.frombuffer(poly.to_bytes(-(-poly.bit_length() // 8), "little"), np.uint8)].tobytes(), "little")


def power(place: int, powers: tuple[int, ...]) -> int:
    """x^place modulo the polynomial, as its bits."""
    lower, out = tuple(e for e in powers if e < DEGREE), 1
    for bit in bin(place)[2:]:
        out = _reduced(_squared(out) << (bit == "1"), lower)
    return out


def started(seed: int, place: int, powers: tuple[int, ...]) -> np.random.RandomState:
    """The seeded generator after place words."""
    words, chosen = _words(seed, DEGREE + 2 * WORDS), power(place, powers)
    bits = np.flatnonzero(np.unpackbits(np.frombuffer(chosen.to_bytes(DEGREE // 8 + 1, "little"), np.uint8), bitorder="little"))
    key = np.zeros(WORDS, np.uint32)
    for low in range(0, len(bits), 1024):
        key ^= np.bitwise_xor.reduce(np.lib.stride_tricks.sliding_window_view(words, WORDS)[bits[low : low + 1024]], axis=0)
    out = np.random.RandomState()
    out.set_state(("MT19937", key, 0))
    return out


def uniform(spark: SparkSession, rows: int, columns: int, names: tuple[str, str] = ("edge_id", "slot"), seed: int = 42, low: float = 0.7, high: float = 1.3, block: int = BLOCK) -> DataFrame:
    """(names, noise): what RandomState(seed).uniform(low, high, (rows, columns)) has at each index."""
    powers = exponents()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                first, last = number * block, min((number + 1) * block, rows * columns)
                generator = started(seed, 2 * first, powers)
                for at in range(first, last, 1 << 16):
                    index = np.arange(at, min(at + (1 << 16), last))
                    yield pa.RecordBatch.from_arrays([pa.array((index // columns).astype(np.int32)), pa.array((index % columns).astype(np.int32)), pa.array(generator.uniform(low, high, len(index)))], [*names, "noise"])

    blocks = -(-rows * columns // block)
    return spark.range(0, blocks, 1, max(1, min(blocks, 10_000))).mapInArrow(run, f"{names[0]} int, {names[1]} int, noise double")
