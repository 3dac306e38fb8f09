"""64-bit hashes of words and of runs of words, for whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text hashed in one go, unless one text is longer.
CHUNK = 1 << 20
#: A fixed random number for each byte value.
BYTES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The same numbers with their bits spread evenly."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def grams(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive values; the last ``size - 1`` starts have none."""
    out = np.zeros(max(0, len(values) - size + 1), dtype=np.uint64)
    for k in range(size):
        out = out * BASE + values[k : k + len(out)]
    return mixed(out)


def hashed_texts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of the batch: first text's index, hash of every word, its byte offset within its
    text, and where each text's words begin (one more than texts)."""
    texts = texts.cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK, side="right")) - 1)
        own = data[edges[at] : edges[to]]
        borders = edges[at : to + 1] - edges[at]
        word = (own != 32) & ((own < 9) | (own > 13))
        before = np.zeros(len(own), dtype=bool)
        before[1:] = word[:-1]
        heads = borders[:-1][borders[:-1] < len(own)]
        before[heads] = False
        starts = np.flatnonzero(word & ~before)
        after = np.zeros(len(own), dtype=bool)
        after[:-1] = word[1:]
        tails = borders[1:][borders[1:] > 0] - 1
        after[tails] = False
        ends = np.flatnonzero(word & ~after) + 1
        sums = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(BYTES[own] * powers(BASE, len(own)), out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(own) + 1)[starts])
        first = np.searchsorted(starts, borders)
        offsets = starts - np.repeat(borders[:-1], np.diff(first))
        yield at, hashes, offsets, first
        at = to


class Ranges:
    """Hashes of ranges of a list of values, each in constant time."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(BASE, len(values)), out=self.sums[1:])
        self.back = powers(INVERSE, len(values) + 1)

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))
