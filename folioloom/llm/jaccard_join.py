"""Jaccard join on word n-grams by chosen paths.

Sets of shingles are drawn as MinHash signatures, lists of sampled tokens.  A run of the
chosen-path join splits all sets by one sampled token; buckets that are still large are split
again by further tokens chosen from the bucket's own path; small buckets are compared pair by
pair, by sketch.  Runs repeat until a pair at the threshold is missed with a probability below
``1 - recall``.  A bucket passes on stars, not pairs: they tie candidates together into
candidate groups, and inside these every pair of different sets is compared exactly, in
blocks of bounded size, from the full sets of the full texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioloom.llm.common import settle, whole_text
from folioloom.llm.components import components
from folioloom.llm.wordhash import grams, hashed_texts

#: Tokens of a signature.
TOKENS = 64
#: Buckets up to this size are compared pair by pair.
SMALL = 512
#: Splits of a bucket, the first included.
DEPTH = 5
#: Tokens that a large bucket is split by, each time.
WIDTH = 2
#: A part with this share of the bucket that it is split from isn't split again.
ALIKE = 0.5
#: Sets of a block of the exact comparison.
BLOCK = 512

_RANDOM = np.random.default_rng(8)
FACTORS = _RANDOM.integers(1, 1 << 31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADDENDS = _RANDOM.integers(0, 1 << 32, TOKENS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of hashed word n-grams of every text; a text of fewer words has one of
    all its words, a text without words none."""
    for _, hashes, _, first in hashed_texts(texts):
        runs = grams(hashes, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(runs[a : b - n + 1])
            elif b > a:
                yield grams(hashes[a:b], b - a)
            else:
                yield hashes[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of ``TOKENS`` hash functions."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(TOKENS, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(short), 4096):
        np.minimum(out, (short[k : k + 4096, None] * FACTORS + ADDENDS).min(axis=0), out=out)
    return out


SETS = "doc_id {kind}, sha binary, key binary, signature array<int>, sketch binary"


def signed(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, sha, key, signature, sketch``: the digests of the text and of its set, the set's
    tokens, and a byte of each token."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tokens, sketches = [], [], []
            for shingles in shingle_sets(batch.column(1), n):
                empty = not len(shingles)
                found = None if empty else signature(shingles)
                keys.append(None if empty else hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                tokens.append(None if empty else found.view(np.int32))
                sketches.append(None if empty else found.astype(np.uint8).tobytes())
            arrays = [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(tokens, pa.list_(pa.int32()))]
            arrays.append(pa.array(sketches, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "sha", "key", "signature", "sketch"])

    # Ids may be of any type that has an order.
    kind = docs.schema["doc_id"].dataType
    kind = T.LongType() if isinstance(kind, T.NumericType) else kind
    rows = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), whole_text().alias("text"))
    return rows.withColumn("sha", F.unhex(F.sha2("text", 256))).mapInArrow(sign, SETS.format(kind=kind.simpleString()))


def _roots(alike: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links: the smallest index of each row's component."""
    label = np.arange(len(alike))
    todo = np.ones(len(alike), dtype=bool)
    for start in range(len(alike)):
        if todo[start]:
            reached = np.zeros(len(alike), dtype=bool)
            reached[start] = True
            front = reached
            while front.any():
                front = alike[front].any(axis=0) & ~reached
                reached |= front
            label[reached], todo[reached] = start, False
    return label


def runs_and_tokens(threshold: float, recall: float) -> tuple[int, int]:
    """How many runs there are, and how many equal tokens make two sketches alike.

    Half of what ``recall`` lets a pair at the threshold be missed with goes to the sketch, whose
    tokens are equal with that probability each, and half to the runs: a pair stays together
    through the first split, and through each of the further ones unless all of its tokens differ.
    """
    missed = (1 - recall) / 2
    below, least = 0.0, 0
    while least < TOKENS:
        below += math.comb(TOKENS, least) * threshold**least * (1 - threshold) ** (TOKENS - least)
        if below > missed:
            break
        least += 1
    together = threshold * (1 - (1 - threshold) ** WIDTH) ** (DEPTH - 1)
    return min(TOKENS, math.ceil(math.log(missed) / math.log(1 - together))), least


def candidate_stars(sets: DataFrame, threshold: float, recall: float, small_bucket: int = SMALL) -> DataFrame:
    """Edges ``a, b`` between keys, so that sets of the threshold's similarity are connected.

    Paths are rows of a key and a bucket.  Buckets of one set end.  Small buckets are compared
    pair by pair, by sketch, and pass on a star for each group.  A large bucket is split by
    further tokens; a part that still holds most of it is a group of much alike sets, which a
    star of all of them covers without comparing pairs.
    """
    runs, least = runs_and_tokens(threshold, recall)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(keys: list[bytes], sketches: list[bytes]) -> list[tuple[bytes, bytes]]:
            sketch = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(-1, TOKENS)
            alike = np.zeros((len(keys), len(keys)), dtype=bool)
            for k in range(len(keys)):
                alike[k] = (sketch == sketch[k]).sum(axis=1) >= least
            roots = _roots(alike)
            return [(keys[k], keys[root]) for k, root in enumerate(roots.tolist()) if k != root]

        def edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        node, keys, sketches, out = None, [], [], []
        for batch in batches:
            for own, key, sketch in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if own != node:
                    if len(keys) > 1:
                        out += stars(keys, sketches)
                    node, keys, sketches = own, [], []
                keys.append(key)
                sketches.append(sketch)
            yield edges(out)
            out = []
        if len(keys) > 1:
            yield edges(stars(keys, sketches))

    token = lambda k: F.get("signature", k)
    roots = F.array(*[F.xxhash64(F.lit(run), token(F.lit(run))) for run in range(runs)])
    paths = sets.select("key", F.explode(roots).alias("node"), F.lit(None).cast("long").alias("of"))
    edges = []
    for depth in range(1, DEPTH + 1):
        counts = paths.groupBy("node").agg(F.count(F.lit(1)).alias("held"), F.min("key").alias("root"))
        shared = settle(paths.join(counts.where(F.col("held") > 1), "node"), "paths")
        small = shared.where(F.col("held") <= small_bucket).join(sets, "key").select("node", "key", "sketch")
        dealt = small.repartition("node").sortWithinPartitions("node")
        edges.append(settle(dealt.mapInArrow(compare, "a binary, b binary").distinct(), "stars"))
        large = shared.where(F.col("held") > small_bucket)
        if large.isEmpty():
            break
        alike = F.coalesce(F.col("held") >= ALIKE * F.col("of"), F.lit(False)) | F.lit(depth == DEPTH)
        edges.append(large.where(alike).select(F.col("key").alias("a"), F.col("root").alias("b")).distinct())
        chosen = [F.pmod(F.xxhash64("node", F.lit(k)), F.lit(TOKENS)).cast("int") for k in range(WIDTH)]
        parts = F.array_distinct(F.array(*[F.xxhash64("node", c, token(c)) for c in chosen]))
        split = large.where(~alike).join(sets, "key")
        paths = split.select("key", F.explode(parts).alias("node"), F.col("held").alias("of"))
    out = edges[0]
    for more in edges[1:]:
        out = out.union(more)
    return out


def _similar(sets: list[np.ndarray], others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets have which of the others at or above the threshold, exactly."""
    sizes = np.array([len(x) for x in others])
    tokens = np.concatenate(others)
    owners = np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    out = np.zeros((len(sets), len(others)), dtype=bool)
    for k, own in enumerate(sets):
        low, high = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
        n = high - low
        if not n.sum():
            continue
        hits = owners[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        common = np.bincount(hits, minlength=len(others))
        # Whole numbers times 1000, so that equality counts.
        out[k] = 1000 * common >= round(1000 * threshold) * (len(own) + sizes - common)
    return out


PART = "group binary, one int, two int, side int, key binary, n long, shingles binary"
LINKED = "key binary, n_links long, root binary"


def linked_sets(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """``key, n_links, root`` for pairs of blocks of every candidate group.

    ``texts`` has ``group, block, blocks, key, n, text``.  A set goes to every pair of blocks
    that its own block is in.  ``n_links`` counts documents of other sets that are similar;
    ``root`` is the set that it is tied to within the pair of blocks.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "one", "two", "side", "key", "n", "shingles"]
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = batch.drop_columns(["text"]).to_pylist()
            out, size = [], 0
            for row, own in zip(rows, shingle_sets(batch.column("text"), n), strict=True):
                for other in range(row["blocks"]):
                    one, two = sorted((row["block"], other))
                    side = int(row["block"] != one)
                    out.append((row["group"], one, two, side, row["key"], row["n"], own.tobytes()))
                    size += own.nbytes
                if size > 8 << 20:
                    yield _rows(out, names, kinds)
                    out, size = [], 0
            yield _rows(out, names, kinds)

    def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "n_links", "root"], [pa.binary(), pa.int64(), pa.binary()]

        def links(rows: list[dict]) -> list[tuple]:
            two_sided = rows[0]["one"] != rows[0]["two"]
            left = [r for r in rows if r["side"] == 0]
            right = [r for r in rows if r["side"] == 1] if two_sided else left
            if not left or not right:
                return []  # an empty block
            sets = [np.frombuffer(r["shingles"], np.uint64) for r in left]
            others = [np.frombuffer(r["shingles"], np.uint64) for r in right] if two_sided else sets
            alike = _similar(sets, others, threshold)
            if two_sided:
                square = np.zeros((len(rows), len(rows)), dtype=bool)
                square[: len(left), len(left) :] = alike
                alike = square | square.T
                both = left + right
            else:
                np.fill_diagonal(alike, False)
                both = left
            weights = np.array([r["n"] for r in both], dtype=np.int64)
            roots, n_links = _roots(alike), alike @ weights
            return [(both[k]["key"], int(n_links[k]), both[root]["key"]) for k, root in enumerate(roots.tolist())]

        place, rows, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                own = row["group"], row["one"], row["two"]
                if own != place:
                    out += links(rows) if rows else []
                    place, rows = own, []
                rows.append(row)
            yield _rows(out, names, kinds)
            out = []
        yield _rows(links(rows) if rows else [], names, kinds)

    parts = texts.select("group", "blocks", "block", "key", "n", "text").mapInArrow(deal, PART)
    dealt = parts.repartition("group", "one", "two").sortWithinPartitions("group", "one", "two")
    return dealt.mapInArrow(compare, LINKED)


def join_near(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99995, small_bucket: int = SMALL
) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_copies, n_links``.

    Two documents are linked where the Jaccard similarity of their sets of word n-grams is at
    least ``threshold``; a pair at the threshold is a candidate with a probability of at least
    ``recall``, and much alike pairs nearly always.  ``class_id`` is the smallest id of the connected documents,
    ``n_copies`` counts the documents of the very same set, ``n_links`` all other documents
    linked to this one, copies included.  Words are runs of characters other than ASCII white
    space; a text of fewer than n words has one shingle, of all its words.  A null text, or
    one without words, is linked to nothing: it is its own class, with one copy and no link.
    A class without any id has none; of repeated rows each gets its row; an empty table gives
    an empty result; columns other than ``doc_id`` and ``text`` are not looked at.
    """
    rows = settle(signed(docs, n), "shingles")
    sets = rows.where(F.col("key").isNotNull()).groupBy("key")
    classes = settle(
        sets.agg(
            F.min("doc_id").alias("least_id"),
            F.count(F.lit(1)).alias("n"),
            F.min("sha").alias("sha"),
            F.first("signature").alias("signature"),
            F.first("sketch").alias("sketch"),
        ),
        "sets",
    )
    groups = components(candidate_stars(classes, threshold, recall, small_bucket))
    groups = settle(groups.withColumnsRenamed({"node": "key", "label": "group"}), "groups")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size")).select("group", blocks.alias("blocks"))
    members = groups.join(sizes, "group").join(classes.select("key", "sha", "n"), "key")
    members = members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    texts = docs.select(whole_text().alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    texts = texts.groupBy("sha").agg(F.first("text").alias("text")).join(members, "sha")
    found = settle(linked_sets(texts, n, threshold), "links")

    n_links = found.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    tied = found.where(F.col("key") != F.col("root")).select(F.col("key").alias("a"), F.col("root").alias("b"))
    labels = components(tied).withColumnsRenamed({"node": "key"})
    known = (
        classes.select("key", "least_id", "n")
        .join(n_links, "key", "left")
        .join(labels, "key", "left")
        .withColumn("label", F.coalesce("label", "key"))
    )
    known = settle(known, "known")
    tops = known.groupBy("label").agg(F.min("least_id").alias("class_id"))
    found = known.join(tops, "label").select(
        "key",
        "class_id",
        F.col("n").alias("n_copies"),
        (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
    )
    return rows.select("doc_id", "key").join(found, "key", "left").select(
        "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
