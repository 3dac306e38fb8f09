"""Best-fit packing of token sequences by exact-complement hashing.

Texts become pieces of at most ``capacity`` tokens.  Only the counts of pieces by length, at
most ``capacity`` numbers, are planned with: for the longest length left, the gap is looked up
among the lengths, the sums of two and the sums of three that are still available, and
combinations that fill it exactly are used up; what remains is packed best-fit.  Pieces of a
length are then numbered and take the places planned for that length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import in_worker, ranked, settle, whole_text

CAPACITY = 4096
#: Words whose ids a worker remembers.
REMEMBERED = 1_000_000
#: What str.split() takes for white space and the tokenizer does not.
UNSURE = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\t-\r ]+")
#: Latin letters that stay single letters in lower case, and punctuation after them.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?]*)")


class WordEncoder:
    """Token ids of texts as little-endian bytes, from remembered ids of their words.

    Only for tokenizers that drop white space, lower-case, and never join words across white
    space or letters with other characters, so that the ids of a text are the ids of its
    words in a row.  Every id comes from the tokenizer: of a plain word its letters and its
    final punctuation each once, of any other word as a whole.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}

    def _whole(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _learn(self, new: list[str]) -> None:
        parts = [PLAIN.fullmatch(word) for word in new]
        cores = {m[1].lower() for m in parts if m}.difference(self.letters)
        for part in batched(cores, 256):
            # Many words in one text; each ends with a token that ends a word.
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                data, at = ids.tobytes(), 0
                for word, end in zip(part, (4 * ends).tolist(), strict=True):
                    self.letters[word], at = data[at:end], end
            else:
                self.letters.update(zip(part, self._whole(list(part)), strict=True))
        tails = list({m[2] for m in parts if m}.difference(self.letters))
        self.letters.update(zip(tails, self._whole(tails), strict=True))
        others = [word for word, m in zip(new, parts, strict=True) if not m]
        for k in range(0, len(others), 4096):
            self.known.update(zip(others[k : k + 4096], self._whole(others[k : k + 4096]), strict=True))
        letters = self.letters
        self.known.update((m[0], letters[m[1].lower()] + letters[m[2]]) for m in parts if m)

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [SPACES.split(t) if UNSURE.search(t) else t.split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.letters.clear()
        self._learn(list(set(chain.from_iterable(words)).difference(self.known)))
        look = self.known.__getitem__
        return [b"".join(map(look, text)) for text in words]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def pieces_of(docs: DataFrame, model: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; ``row`` numbers them, ``ids`` (if asked for) holds their tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = in_worker(f"words {model}", lambda: WordEncoder(model))
        row, end = TaskContext.get().partitionId() << 36, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                doc_ids, out = part.column(0).to_pylist(), []
                for doc_id, data in zip(doc_ids, encoder.encode(part.column(1).to_pylist()), strict=True):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at : at + 4 * capacity]
                        out.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), row, own))
                        row += 1
                columns = list(zip(*out, strict=True))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
                if with_ids:
                    ids = [np.frombuffer(x, "<u4").astype("i4") for x in columns[6]]
                    names, arrays = [*names, "ids"], [*arrays, pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


Pattern = tuple[int, ...]


class Stock:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def times(self, parts: Pattern) -> int:
        """How often the combination can be taken."""
        return min(int(self.left[length]) // n for length, n in Counter(parts).items())

    def take(self, parts: Pattern, times: int) -> None:
        for length in parts:
            self.left[length] -= times

    def pair(self, total: int, below: int) -> Pattern | None:
        """Two lengths with this sum, the longer at most ``below``, the longer as long as can be."""
        high = min(below, total - 1)
        low = (total + 1) // 2
        if high < low:
            return None
        longer = np.arange(high, low - 1, -1)
        fits = (self.left[longer] > 0) & (self.left[total - longer] > 0)
        if total % 2 == 0:
            fits[-1] &= longer[-1] != total // 2 or self.left[total // 2] > 1
        at = int(np.argmax(fits))
        return (int(longer[at]), total - int(longer[at])) if fits[at] else None

    def complement(self, gap: int, below: int) -> Pattern | None:
        """One, two or three lengths that fill the gap exactly."""
        if gap <= below and self.left[gap] > 0:
            return (gap,)
        found = self.pair(gap, below)
        if found:
            return found
        # Of three, the longest is at least a third of the gap.
        least = (gap + 2) // 3
        for first in (np.flatnonzero(self.left[least : min(below, gap - 2) + 1])[::-1] + least).tolist():
            self.left[first] -= 1
            rest = self.pair(gap - first, first)
            self.left[first] += 1
            if rest:
                return (first, *rest)
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns of lengths and how many sequences are packed so; ``counts`` are all used up.

    Each step uses up a length, or the gaps of one size, for good: the plan's length depends
    on ``capacity`` and not on the number of pieces.
    """
    stock, out = Stock(counts, capacity), []
    for longest in range(capacity, 0, -1):
        while stock.left[longest] > 0:
            if longest == capacity:
                parts: Pattern | None = (longest,)
            else:
                stock.left[longest] -= 1
                found = stock.complement(capacity - longest, longest)
                stock.left[longest] += 1
                parts = (longest, *found) if found else None
            if not parts:
                break
            times = stock.times(parts)
            stock.take(parts, times)
            out.append((parts, times))
    # Best fit, longest first: equal pieces go to equal gaps together.
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    for length in range(capacity, 0, -1):
        left = int(stock.left[length])
        while left:
            gap = min((g for g in open_bins if g >= length), default=None)
            if gap is None:
                per = min(capacity // length, left)
                times = left // per
                open_bins.setdefault(capacity - per * length, []).append(((length,) * per, times))
                left -= per * times
                continue
            parts, times = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
            used = min(times, left)
            if used < times:
                open_bins.setdefault(gap, []).append((parts, times - used))
            open_bins.setdefault(gap - length, []).append(((*parts, length), used))
            left -= used
    return out + [group for groups in open_bins.values() for group in groups]


def places(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows ``length, first, per, sequence, offset``: from its number ``first`` on, a piece of
    this length goes to sequence ``sequence + i // per`` at ``offset + i % per * length``."""
    rows, used, sequence = [], Counter(), 0
    for parts, times in patterns:
        offset = 0
        for length, per in sorted(Counter(parts).items(), reverse=True):
            rows.append((length, used[length], per, sequence, offset))
            used[length] += per * times
            offset += per * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, model: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is the tokenizer's ids and then ``end_id``; only longer ones are cut, into
    pieces of ``capacity`` tokens of which the last may be shorter.  ``with_ids`` adds the
    ids themselves.  A null text is empty and makes a piece of one token.  Rows with the same
    id each make their pieces; an empty table gives an empty result; columns other than
    ``doc_id`` and ``text`` are not looked at.  ``model`` must drop white space and keep words
    apart; see :class:`WordEncoder`.
    """
    pieces = settle(pieces_of(docs, model, end_id, capacity, with_ids), "pack-pieces")
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(plan(counts, capacity))
    starts = (table[:, 0] << 40) + table[:, 1] if len(table) else table[:, 0]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(name).to_numpy() for name in ("length", "_number"))
            found = table[np.searchsorted(starts, (length << 40) + number, side="right") - 1]
            i, per = number - found[:, 1], found[:, 2]
            kept = [name for name in batch.schema.names if name not in ("row", "_number", "_order")]
            arrays = [batch.column(name) for name in kept]
            arrays += [pa.array(found[:, 3] + i // per), pa.array(found[:, 4] + i % per * length)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "sequence_id", "offset"])

    keyed = pieces.withColumn("_order", F.xxhash64("row"))
    numbered = ranked(keyed, ["length"], ["_order", "row"], sum(counts.values()), "_number")
    names = "doc_id long, piece int, start long, length long, ids_crc32 long"
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "_number"]
    schema = names + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return numbered.select(*columns).mapInArrow(assign, schema)
