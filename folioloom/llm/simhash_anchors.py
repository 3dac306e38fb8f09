"""SimHash near-duplicates by anchors of a covering code.

A fingerprint's 61 lower bits are two blocks of 23 bits and one of 15, each covered by a
perfect code: the binary Golay code, of covering radius 3, and the Hamming code, of radius 1.
An anchor is a codeword of all three.  Every fingerprint has one anchor within the covering
radius, its home, and is sent to every anchor within covering radius plus threshold, block by
block.  Two fingerprints within the threshold thus meet at the home of either.  The three
bits without a code only take part in the comparison.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import chunked, settle, whole_text
from folioloom.llm.components import components

#: Words of a shingle; bits in which linked fingerprints differ at most.
SHINGLE, THRESHOLD = 3, 2
#: Generator polynomials of the codes, and the seed of shingle hashes.
GOLAY, HAMMING, SEED = 0b101011100011, 0b10011, 42
#: Length and radius of the codes' blocks, from the lowest bit on.
BLOCKS = ((23, GOLAY, 3), (23, GOLAY, 3), (15, HAMMING, 1))
#: Homes at an anchor up to which all pairs are compared there.
DENSE = 64


class Code:
    """A perfect cyclic code: by syndrome, the errors that lead to its words.

    ``errors[k]`` and ``first[k]`` list, one syndrome after the other, the errors of weight
    radius + 1 up to radius + k that begin at an index; ``leader`` has the lightest of each.
    """

    def __init__(self, length: int, polynomial: int, radius: int):
        self.length, degree = length, polynomial.bit_length() - 1
        # Syndromes of single bits: powers of x modulo the polynomial.
        single, value = [], 1
        for _ in range(length):
            single.append(value)
            value <<= 1
            value ^= polynomial * (value >> degree)
        self.single = np.array(single, dtype=np.uint64)
        self.leader = np.zeros(1 << degree, dtype=np.uint64)
        for weight in range(1, radius + 1):
            error, syndrome = self._errors(weight)
            self.leader[syndrome] = error
        self.errors, self.first = [np.zeros(0, np.uint64)], [np.zeros((1 << degree) + 1, np.int64)]
        for k in range(1, THRESHOLD + 1):
            parts = [self._errors(radius + j) for j in range(1, k + 1)]
            error, syndrome = (np.concatenate(x) for x in zip(*parts, strict=True))
            self.errors.append(error[np.argsort(syndrome, kind="stable")])
            counts = np.bincount(syndrome.astype(np.int64), minlength=1 << degree)
            self.first.append(np.concatenate([[0], np.cumsum(counts)]))

    def _errors(self, weight: int) -> tuple[np.ndarray, np.ndarray]:
        places = np.array(list(itertools.combinations(range(self.length), weight)), dtype=np.uint64)
        error = np.bitwise_or.reduce(np.uint64(1) << places, axis=1)
        return error, np.bitwise_xor.reduce(self.single[places.astype(np.int64)], axis=1)

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.uint64)
        for k, value in enumerate(self.single):
            out ^= (words >> np.uint64(k) & np.uint64(1)) * value
        return out.astype(np.int64)


@cache
def codes() -> list[tuple[int, Code]]:
    """The blocks' shifts and codes."""
    made = {spec: Code(*spec) for spec in set(BLOCKS)}
    shifts = itertools.accumulate((length for length, _, _ in BLOCKS), initial=0)
    return [(shift, made[spec]) for shift, spec in zip(shifts, BLOCKS, strict=False)]


def homes(prints: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The anchor within the covering radius of each fingerprint, and the blocks' syndromes."""
    anchor, syndromes = np.zeros(len(prints), dtype=np.uint64), []
    for shift, code in codes():
        block = prints >> np.uint64(shift) & np.uint64((1 << code.length) - 1)
        syndromes.append(code.syndromes(block))
        anchor |= (block ^ code.leader[syndromes[-1]]) << np.uint64(shift)
    return anchor, syndromes


def _alternatives(block: int, k: int, rows: np.ndarray, syndromes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``rows``, repeated, and what turns a home's block into another codeword
    that lies up to ``k`` beyond the radius from the row's block."""
    shift, code = codes()[block]
    own = syndromes[block][rows]
    begin, n = code.first[k][own], np.diff(code.first[k])[own]
    which = np.repeat(np.arange(len(rows)), n)
    at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    return which, (code.errors[k][at] ^ code.leader[own][which]) << np.uint64(shift)


def replicas(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within covering radius plus threshold: rows of ``prints``, repeated, and
    anchors; a row's home is among them."""
    home, syndromes = homes(prints)
    every = np.arange(len(prints))
    rows, anchors = [every], [home]
    for block in range(len(BLOCKS)):
        # The whole excess in one block, or one bit in each of two.
        which, change = _alternatives(block, THRESHOLD, every, syndromes)
        rows.append(which)
        anchors.append(home[which] ^ change)
        which, change = _alternatives(block, 1, every, syndromes)
        for other in range(block + 1, len(BLOCKS)):
            again, second = _alternatives(other, 1, which, syndromes)
            rows.append(which[again])
            anchors.append(home[which[again]] ^ change[again] ^ second)
    return np.concatenate(rows), np.concatenate(anchors)


#: The bits of a byte, each in a byte of its own.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the hashes of each text, of which there are
    ``sizes``: in blocks of 255 at most, whose counts fit into bytes."""
    blocks = -(-sizes // 255)
    begin = np.cumsum(sizes) - sizes
    counts = np.zeros((len(sizes), 64), dtype=np.int64)
    block_of = np.repeat(np.arange(len(sizes)), blocks)
    if len(block_of):
        nth = np.arange(len(block_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        lanes = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], begin[block_of] + 255 * nth, axis=0)
        some = np.flatnonzero(blocks)
        first = (np.cumsum(blocks) - blocks)[some]
        counts[some] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), first, axis=0)
    return counts


def shingles_of(text: bytes) -> list[bytes]:
    """Runs of three words, lower-cased in ASCII and joined by a space, with repeats; of fewer
    words the whole sequence."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return [joined] if words else []
    ends = list(itertools.accumulate((len(word) + 1 for word in words), initial=0))
    return [joined[a : b - 1] for a, b in zip(ends, ends[SHINGLE:], strict=False)]


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """Each text's fingerprint: a bit is 1 where over half the hashes have it; 0 without words."""
    hashed, digest = [], xxhash.xxh64_digest
    sizes = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        own = shingles_of(text)
        sizes[k] = len(own)
        hashed += [digest(x, SEED) for x in own]
    hashes = np.frombuffer(b"".join(hashed), dtype=">u8").astype("<u8")
    bits = 2 * bit_counts(hashes, sizes) > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print`` of every row, the fingerprint's bits as a long."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunked(batch, batch.column(1)):
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                prints = fingerprints_of(texts).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], names=["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(measure, f"doc_id {kind}, print bigint")


def with_homes(prints: DataFrame) -> DataFrame:
    """The rows of ``print`` with their ``home``."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, _ = homes(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home.view(np.int64))], names=["print", "home"])

    return prints.select("print").mapInArrow(place, "print bigint, home bigint")


def sent_to_anchors(prints: DataFrame) -> DataFrame:
    """``anchor, print``: every anchor within covering radius plus threshold."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                own = batch.column(0).slice(k, 512).to_numpy().view(np.uint64)
                rows, anchors = replicas(own)
                arrays = [pa.array(anchors.view(np.int64)), pa.array(own[rows].view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "print"])

    return prints.select("print").mapInArrow(send, "anchor bigint, print bigint")


def near_prints(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """``a, b``: links that join the distinct fingerprints within the threshold of each other,
    directly or over others, and no more.

    At an anchor with up to ``dense`` homes, homes are compared with all that was sent there.
    Where more have their home, pairs would grow with their square; what was sent there goes
    to itself and its 64 neighbours by one bit, and all that meet at one of these are linked
    to the smallest.  Two fingerprints meet so if, and only if, they differ in two bits or less.
    """
    placed = settle(with_homes(prints), "simhash-homes")
    full = settle(placed.groupBy(F.col("home").alias("anchor")).count().where(F.col("count") > dense), "simhash-dense")
    sparse = placed.select(F.col("home").alias("anchor"), F.col("print").alias("a")).join(full, "anchor", "left_anti")
    sent = sent_to_anchors(placed)
    # Spark takes rows made in a plan for no more than those they are made from, and would
    # broadcast what was sent, some 150 times what it is taken for; so joins on it are merged.
    met = sent.select("anchor", F.col("print").alias("b")).join(sparse.hint("merge"), "anchor")
    links = met.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD))
    links = links.select("a", "b")
    if full.isEmpty():
        return links
    # Before the copies by bit are made, each print of a full anchor counts once.
    crowded = settle(sent.join(full, "anchor", "left_semi").select("print").distinct(), "simhash-crowded")
    flips = [0, *[1 << k for k in range(63)], -1 << 63]
    points = F.explode(F.array(*[F.col("print").bitwiseXOR(F.lit(bit).cast("bigint")) for bit in flips]))
    around = crowded.select(F.col("print").alias("b"), points.alias("point"))
    least = settle(around.groupBy("point").agg(F.min("b").alias("a"), F.max("b").alias("_most")).where("a < _most"), "simhash-points")
    return links.unionByName(around.join(least.hint("merge"), "point").where(F.col("a") < F.col("b")).select("a", "b"))


def near_documents(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` has 16 hex digits; texts without words, null among them, have zero and are
    linked by it like any others.  ``component_id`` is the smallest id that links reach, the
    row's own included; rows without id take part, and get a null only where no id is reached.
    Rows with the same id or text each get their row; an empty table gives an empty result;
    columns other than ``doc_id`` and ``text`` are not looked at.

    Copies count as one fingerprint from the first shuffle on.  Of a fingerprint some 150 rows
    of two numbers are sent to anchors, whatever the number of documents.
    """
    rows = settle(fingerprints(docs), "simhash-prints")
    prints = settle(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    labels = settle(components(near_prints(prints, dense), written_minima=True), "simhash-labels")
    joined = prints.join(labels, prints["print"] == labels["node"], "left")
    top = settle(
        joined.select("print", "least", F.coalesce("label", "print").alias("label")), "simhash-members"
    )
    reached = settle(top.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-reached")
    found = settle(top.join(reached, "label").select("print", "component_id"), "simhash-found")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return rows.join(found, "print").select("doc_id", digits.alias("fingerprint"), "component_id")
