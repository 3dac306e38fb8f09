"""Alignment of the tokens of two tokenizers by lockstep merging.

Both tokenizers' tokens cover the same bytes.  Lanes of tokens, many of all documents of a
batch, are merged in lockstep: one array holds the pointers of all lanes, and every step
compares the ends of all current tokens, emits a link and a cut where they are equal, advances
the token that ends first, or both, and drops the lanes that are done.  How often two ids are
linked is counted over the corpus: each block of documents sends every pair once, and gets its
count back once.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import chunked, in_worker, settle, whole_text

#: Tokens of the first tokenizer in a lane, and bytes of text in a block.
LANE, BLOCK = 256, 2 << 20

PART = (
    "block bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "groups string, places array<int>, times array<bigint>, place int, a int, b int, n bigint"
)
RESULT = (
    "doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string, groups string"
)


class Vocabulary(NamedTuple):
    """How a tokenizer encodes texts, the bytes of each id, and what it puts before a text."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes]


def byte_level(model: str) -> Vocabulary:
    """A byte-level tokenizer of the library tokenizers; its special strings are plain text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(model)
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    # Printable bytes stand for themselves, the others for the code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(byte): byte for byte in plain}
    byte_of |= {chr(256 + k): byte for k, byte in enumerate(sorted(set(range(256)) - set(plain)))}
    tokens = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for entry, k in tokenizer.get_vocab(with_added_tokens=True).items():
        tokens[k] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return Vocabulary(encode, tokens)


def pieces(model: str) -> Vocabulary:
    """A tokenizer of the library sentencepiece, which puts a space before the text."""
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=model)

    def read(k: int) -> bytes:
        piece = processor.id_to_piece(k)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece) if processor.is_byte(k) else None
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    tokens = [read(k) for k in range(processor.get_piece_size())]
    return Vocabulary(lambda texts: [processor.encode(text) for text in texts], tokens)


def common_ends(a: np.ndarray, b: np.ndarray, first: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of ``a`` and ``b`` end together: two lists of indices, of equal length.

    ``a`` and ``b`` are the rising ends of the tokens of all documents, one after the other;
    ``first`` says where each document's tokens begin in ``a``.  A document's tokens are dealt
    to lanes of at most ``lane`` tokens, so that a long one is as many lanes, not as many steps.
    """
    sizes = np.diff(np.append(first, len(a)))
    lanes = -(-sizes // lane)
    nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = np.repeat(first, lanes) + lane * nth
    end = np.minimum(begin + lane, np.repeat(first + sizes, lanes))
    before = np.where(begin > 0, a[begin - 1], 0)
    at_b, end_b = np.searchsorted(b, before, "right"), np.searchsorted(b, a[end - 1], "right")
    state = np.array([begin, at_b, end, end_b])
    state = state[:, state[1] < state[3]]
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while state.shape[1]:
        x, y = a[state[0]], b[state[1]]
        together = x == y
        links_a.append(state[0, together])
        links_b.append(state[1, together])
        state[0] += x <= y
        state[1] += y <= x
        alive = (state[0] < state[2]) & (state[1] < state[3])
        if not alive.all():
            state = state[:, alive]
    # Steps mix the lanes; both lists rise with the text.
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


class Written:
    """Ids as they are written in a list of groups, with the mark that follows them."""

    def __init__(self, n_a: int, n_b: int):
        marks = [(n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")]
        self.strings = np.array([f"{k}{mark}" for n, mark in marks for k in range(n)], dtype=object)
        self.a_last, self.b, self.b_last = n_a, 2 * n_a, 2 * n_a + n_b

    def in_order(self, ids_a: np.ndarray, ids_b: np.ndarray, links_a: np.ndarray, links_b: np.ndarray) -> list[str]:
        """All ids in the order of their groups: a group's of the first, then of the second."""
        index_a, index_b = ids_a.copy(), ids_b + self.b
        index_a[links_a] += self.a_last
        index_b[links_b] += self.b_last - self.b
        # A token comes after the others' tokens of all groups before its own, or up to it.
        group_a, group_b = np.searchsorted(links_a, np.arange(len(ids_a))), np.searchsorted(links_b, np.arange(len(ids_b)))
        b_before = np.append(0, links_b + 1)
        out = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        out[np.arange(len(ids_a)) + b_before[group_a]] = index_a
        out[np.arange(len(ids_b)) + links_a[group_b] + 1] = index_b
        return self.strings[out].tolist()


class Aligned(NamedTuple):
    """What is known of some texts: numbers of tokens and links of each, the list of groups,
    and the pairs of linked ids as ``a << 32 | b``, one after the other."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pairs: np.ndarray


def is_plain(part: str) -> bool:
    """Whether a part begins with something that is neither white space nor a mark on a space."""
    return bool(part) and (part[0].isalnum() or "!" <= part[0] <= "~")


def segments(text: str) -> list[str]:
    """A text that begins with a space, cut before every space that lies between something
    else than a space and a plain part."""
    parts, out = text.split(" ")[1:], []
    before = ""
    for part in parts:
        if before and is_plain(part):
            out.append(f" {part}")
        elif out:
            out[-1] += f" {part}"
        else:
            out.append(f" {part}")
        before = part
    return out


class Segments:
    """The tokens of segments of text in both tokenizers, each encoded once by a worker.

    No token of either reaches over such a cut: the first one's pattern ends a match there, and
    the second one has no entry with a space after another character (``ValueError`` otherwise).  So a
    text's tokens are those of its segments.  More than ``most`` segments are forgotten.
    """

    def __init__(self, first: Vocabulary, second: Vocabulary, most: int = 1 << 18):
        if any(b" " in token.lstrip(b" ") for token in second.tokens):
            raise ValueError("the second tokenizer has an entry with a space inside")
        self.vocabularies, self.most = (first, second), most
        self.sizes = [np.array([len(token) for token in known.tokens], dtype=np.int64) for known in self.vocabularies]
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        #: Of these, plain parts of a text without their space: most texts have no others.
        self.plain: dict[str, int] = {}
        self.first = [np.zeros(1, dtype=np.int64) for _ in range(2)]
        self.ids = [np.zeros(0, dtype=np.int64) for _ in range(2)]
        self.same = np.zeros(0, dtype=bool)

    def learn(self, new: list[str]) -> None:
        """Encode segments; the second tokenizer puts their first space before them itself."""
        fresh = dict(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.numbers |= fresh
        self.plain |= {text[1:]: k for text, k in fresh.items() if " " not in text[1:] and is_plain(text[1:])}
        same = np.ones(len(new), dtype=bool)
        for side, texts in enumerate((new, [text[1:] for text in new])):
            known = self.vocabularies[side]
            encoded = known.encode(texts)
            same &= [b"".join([known.tokens[i] for i in own]) == text.encode() for own, text in zip(encoded, new, strict=True)]
            ends = self.first[side][-1] + np.cumsum([len(own) for own in encoded], dtype=np.int64)
            self.first[side] = np.concatenate([self.first[side], ends])
            flat = np.array([i for own in encoded for i in own], dtype=np.int64)
            self.ids[side] = np.concatenate([self.ids[side], flat])
        self.same = np.concatenate([self.same, same])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the segments of all texts, and how many each text has; a text that
        either tokenizer changes has none."""
        if len(self.numbers) > self.most:
            self.clear()
        codes = [list(map(self.plain.get, text.split(" "))) if text else [] for text in texts]
        # Texts with other segments, or with segments not yet known.
        cut = {k: segments(f" {texts[k]}") for k, own in enumerate(codes) if None in own}
        new = {part: None for own in cut.values() for part in own if part not in self.numbers}
        if new:
            self.learn(list(new))
        for k, own in cut.items():
            codes[k] = [self.numbers[part] for part in own]
        sizes = np.array([len(own) for own in codes], dtype=np.int64)
        numbers = np.fromiter(itertools.chain.from_iterable(codes), dtype=np.int64, count=int(sizes.sum()))
        text_of = np.repeat(np.arange(len(texts)), sizes)
        changed = np.zeros(len(texts), dtype=bool)
        changed[text_of[~self.same[numbers]]] = True
        return numbers[~changed[text_of]], np.where(changed, 0, sizes)

    def tokens(self, side: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the segments, one after the other, and how many each has."""
        begin = self.first[side][numbers]
        n = self.first[side][numbers + 1] - begin
        return self.ids[side][np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)], n


def align_texts(texts: list[str], known: Segments, written: Written) -> Aligned:
    """Align the tokens of every text; texts that either tokenizer changes have no tokens."""
    numbers, sizes = known.of(texts)
    borders = np.append(0, np.cumsum(sizes))
    ids, counts = [], []
    for side in (0, 1):
        own, n = known.tokens(side, numbers)
        ids.append(own)
        counts.append(np.diff(np.append(0, np.cumsum(n))[borders]))
    (ids_a, ids_b), (n_a, n_b) = ids, counts
    ends_a, ends_b = (np.cumsum(size[own]) for size, own in zip(known.sizes, ids, strict=True))
    starts_a = np.cumsum(n_a) - n_a
    links_a, links_b = common_ends(ends_a, ends_b, starts_a)
    n_links = np.diff(np.searchsorted(links_a, np.append(starts_a, len(ids_a))))
    strings = written.in_order(ids_a, ids_b, links_a, links_b)
    ends = np.cumsum(n_a + n_b)
    groups = ["".join(strings[begin:end])[:-1] for begin, end in zip((ends - n_a - n_b).tolist(), ends.tolist(), strict=True)]
    return Aligned(n_a, n_b, n_links, groups, ids_a[links_a] << 32 | ids_b[links_b])


def align_tokens(docs: DataFrame, first_model: str, second_model: str, with_groups: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``, with ``with_groups`` also ``groups``.

    ``first_model`` is a byte-level file of tokenizers, given a space and the text;
    ``second_model`` one of sentencepiece, given the text.  Both tokenizers' tokens are cut
    into groups where tokens of both end; tokens that end together are linked.  ``n_best``
    counts a row's links of id pairs that no other pair with the same second id exceeds over
    all rows; ``count_sum`` sums, over its links, how often their pairs are linked in all rows.
    ``groups`` reads ``a1,a2|b1;a3|b2,b3``, and ``groups_sha256`` is its digest, '' without
    tokens.  A null or empty text, and one whose bytes either tokenizer changes, has no tokens:
    zeros.  Rows with the same id or text each get their row, and count each; an empty table
    gives an empty result; columns other than ``doc_id`` and ``text`` are not looked at.

    Blocks of about two megabytes of text are aligned at a time, a longer text by itself; words
    and copies within one are encoded once.  A block keeps its distinct pairs, and how often each row has
    them; only these pairs are joined with their counts, one row for each block and pair.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    part_type = PART.format(kind=kind)
    names = [column.split()[0] for column in part_type.split(", ")]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = f"{first_model} {second_model}"
        known = in_worker(f"segments {models}", lambda: Segments(byte_level(first_model), pieces(second_model)))
        written = in_worker(f"written {models}", lambda: Written(*map(len, known.sizes)))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunked(batch, batch.column(1), BLOCK):
                yield from block_rows(part, block, known, written)
                block += 1

    def block_rows(part: pa.RecordBatch, block: int, known: Segments, written: Written) -> Iterator[pa.RecordBatch]:
        encoded = part.column(1).dictionary_encode()
        which = encoded.indices.to_numpy()
        found = align_texts(encoded.dictionary.to_pylist(), known, written)
        places, pairs = pd.factorize(found.pairs)
        text_of = np.repeat(np.arange(len(found.n_links)), found.n_links)
        # Distinct pairs of each text, and how often it has them.
        own, times = np.unique(text_of * max(1, len(pairs)) + places, return_counts=True)
        text, place = np.divmod(own, max(1, len(pairs)))
        copies = np.bincount(which, minlength=len(found.n_links))
        total = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(total, place, times * copies[text])
        edges = np.append(0, np.cumsum(np.bincount(text, minlength=len(found.n_links)))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in (place.astype(np.int32), times.astype(np.int64))]
        digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in found.groups]
        rows = {
            "doc_id": part.column(0),
            "n_a": pa.array(found.n_a).take(encoded.indices),
            "n_b": pa.array(found.n_b).take(encoded.indices),
            # Documents end with a link: as many groups as links.
            "n_groups": pa.array(found.n_links).take(encoded.indices),
            "n_links": pa.array(found.n_links).take(encoded.indices),
            "groups_sha256": pa.array(digest, pa.string()).take(encoded.indices),
            "places": lists[0].take(encoded.indices),
            "times": lists[1].take(encoded.indices),
        }
        if with_groups:
            rows["groups"] = pa.array(found.groups, pa.string()).take(encoded.indices)
        yield filled(rows, part.num_rows, block, part.schema.field(0).type)
        sides = {"a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "place": np.arange(len(pairs))}
        rows = {name: pa.array(values.astype(np.int32)) for name, values in sides.items()}
        yield filled(rows | {"n": pa.array(total)}, len(pairs), block, part.schema.field(0).type)

    def filled(rows: dict[str, pa.Array], n: int, block: int, id_type: pa.DataType) -> pa.RecordBatch:
        string, long, integer = pa.string(), pa.int64(), pa.int32()
        types = [long, id_type, long, long, long, long, string, string, pa.list_(integer), pa.list_(long), *[integer] * 3, long]
        rows = rows | {"block": pa.array([block] * n, long)}
        arrays = [rows.get(name, pa.nulls(n, kind)) for name, kind in zip(names, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's documents with the counts of its pairs."""
        size = right.num_rows
        count, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        place = right["place"].to_numpy()
        count[place], best[place] = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        n_best, count_sum = [], []
        for places, times in zip(left["places"], left["times"], strict=True):
            at, n = places.values.to_numpy(), times.values.to_numpy()
            n_best.append(int(best[at] @ n))
            count_sum.append(int(count[at] @ n))
        out = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return out.append_column("groups_sha256", left["groups_sha256"]).append_column("groups", left["groups"])

    parts = settle(docs.select("doc_id", whole_text().alias("text")).mapInArrow(align, part_type), "alignment")
    rows = parts.where(F.col("n_a").isNotNull()).select("block", *names[1:10])
    pairs = parts.where(F.col("n").isNotNull()).select("block", "place", "a", "b", "n")
    counts = settle(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    known = counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    counted = pairs.join(settle(known, "pairs"), ["a", "b"]).select(F.col("block").alias("of"), "place", "count", "best")
    result = rows.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(answer, RESULT.format(kind=kind))
    return result if with_groups else result.drop("groups")
