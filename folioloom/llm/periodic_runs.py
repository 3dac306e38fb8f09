"""Runs of periodic words by maximal pairs of an LCP-interval tree.

The words of a document are sorted by what follows them.  Neighbours in that order and the
lengths of what they share make up the tree of LCP intervals: each interval is a repeated
passage with all its places, and holds the intervals of the longer passages that begin with
it.  The tree is built from the bottom up; every interval keeps its places in lists by the word
to their left.  Two places of different lists from different children are a maximal pair: they
share exactly the interval's words and differ before and after.  A pair ``q`` words apart that
shares ``l`` words spans ``l + q`` words with period ``q`` that no neighbour extends, so pairs
whose distance fits their length are runs as they are found.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import SPACE, chunked, whole_text

#: A run holds its period so often, and so many words, at least.
TIMES, LEAST = 4, 6
RUN = "struct<start: bigint, length: bigint, period: bigint>"
RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def suffix_order(codes: np.ndarray, docs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places in the order of their document and of the words from there to its end, and
    which entries share four words with the one before.

    Each round sorts the places that are still alike by the rank of the place as many words on
    as are known to be alike; so a round doubles that number.
    """
    n = len(codes)
    key = docs * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    same = np.zeros(n + 1, dtype=bool)
    same[1:n] = key[order][1:] == key[order][:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(same[:n], 0, np.arange(n)))
    alike, known = same.copy(), 1
    while True:
        if known == 4:
            alike = same.copy()
        slots = np.flatnonzero(same[:n] | same[1:])
        if not len(slots):
            return order, alike[:n] if known >= 4 else same[:n]
        places = order[slots]
        ahead = places + known
        inside = ahead < ends[docs[places]]
        following = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[places] * (n + 1) + following
        by_key = np.argsort(key, kind="stable")
        key, places = key[by_key], places[by_key]
        order[slots] = places
        equal = np.zeros(len(slots), dtype=bool)
        equal[1:] = key[1:] == key[:-1]
        same[slots] = equal
        rank[places] = np.maximum.accumulate(np.where(equal, 0, slots))
        known *= 2


def common_words(codes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from ``a`` and ``b`` on are the same, at most ``most``, in growing blocks."""
    out, active, width = np.zeros(len(a), dtype=np.int64), np.flatnonzero(most > 0), 8
    while len(active):
        steps = np.arange(width)
        at = out[active, None] + steps
        last = len(codes) - 1
        same = codes[np.minimum(a[active, None] + at, last)] == codes[np.minimum(b[active, None] + at, last)]
        same &= at < most[active, None]
        whole = same.all(axis=1)
        out[active] += np.where(whole, width, same.argmin(axis=1))
        active = active[whole]
        width = min(2 * width, max(8, (1 << 20) // max(1, len(active))))
    return out


def shared_with_previous(codes: np.ndarray, docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """For every entry of the order how many words it shares with the one before; 0 where
    these are fewer than four.

    Only where the words before the two differ are words compared.  Elsewhere the number is one
    less than that of the place before, so it follows from the last place compared.
    """
    slots = np.flatnonzero(alike)
    place, other = order[slots], order[slots - 1]
    first = starts[docs[place]]
    led = (place > first) & (other > first)
    led[led] = codes[place[led] - 1] == codes[other[led] - 1]
    fresh = np.flatnonzero(~led)
    most = ends[docs[place[fresh]]] - np.maximum(place[fresh], other[fresh])
    reach = np.zeros(len(codes), dtype=np.int64)
    reach[place[fresh]] = place[fresh] + common_words(codes, place[fresh], other[fresh], most)
    compared = np.zeros(len(codes), dtype=np.int64)
    compared[place[fresh]] = place[fresh]
    compared = np.maximum.accumulate(compared)
    out = np.zeros(len(codes), dtype=np.int64)
    out[slots] = reach[compared[place]] - place
    return out


class Interval:
    """A repeated passage: all its places, and its places by the word to their left."""

    __slots__ = ("lists", "places")

    def __init__(self, places: list[int], lists: dict[int, list[int]]):
        self.places, self.lists = places, lists

    def add(self, more: list[int], left: list[int]) -> None:
        _put(self.places, more)
        by_word: dict[int, list[int]] = {}
        for p in more:
            by_word.setdefault(left[p], []).append(p)
        for word, own in by_word.items():
            _put(self.lists.setdefault(word, []), own)


def _put(into: list[int], more: list[int]) -> None:
    """Merge a sorted list into another; few numbers one by one."""
    if 16 * len(more) < len(into):
        for p in more:
            insort(into, p)
    else:
        into += more
        into.sort()


def join_children(depth: int, children: list[Interval], left: list[int], reach: int) -> Iterator[tuple[int, int]]:
    """Merge an interval's children into the largest of them, and yield the maximal pairs that
    are at most ``reach`` apart, as place and distance.

    Only the places of the smaller children look for partners, so a place looks as often as
    its interval doubles.  Places within a third of the passage's length of another lie one
    period apart, and all but the first have the period's last word to their left: a window
    meets two lists at most, those of its first and of its last place.
    """
    largest = max(children, key=lambda child: len(child.places))
    child_of = {p: k for k, child in enumerate(children) if child is not largest for p in child.places}
    smaller = sorted(child_of)
    largest.add(smaller, left)
    places, lists = largest.places, largest.lists
    for p in smaller:
        low, high = bisect_left(places, p - reach), bisect_right(places, p + reach)
        if high - low < 2:
            continue
        for word in {left[places[low]], left[places[high - 1]]} - {left[p]}:
            own = lists[word]
            for k in range(bisect_left(own, p - reach), bisect_right(own, p + reach)):
                child = child_of.get(own[k], -1)
                # Those of one child share more words; two of smaller children meet once.
                if child != child_of[p] and (child < 0 or own[k] > p):
                    yield min(p, own[k]), abs(p - own[k])


def maximal_pairs(order: list[int], shared: list[int], left: list[int], times: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Place, distance and shared words of every maximal pair that is a run, where the words
    shared with the entry before are ``shared``."""
    floor = least_shared(times, least)
    stack: list[tuple[int, list[Interval]]] = []
    for k, p in enumerate(order):
        node = Interval([p], {left[p]: [p]})
        depth = shared[k + 1] if k + 1 < len(order) else 0
        while stack and stack[-1][0] > depth:
            length, children = stack.pop()
            children.append(node)
            for at, distance in join_children(length, children, left, length // (times - 1)):
                if length + distance >= least:
                    yield at, distance, length
            node = max(children, key=lambda child: len(child.places))
        if stack and stack[-1][0] == depth:
            stack[-1][1].append(node)
        elif depth >= floor:
            stack.append((depth, [node]))


def least_shared(times: int, least: int) -> int:
    """The fewest words that the pair of a run can share."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def runs_of(words: list[list[bytes]], times: int = TIMES, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Start, length and smallest period of every run of each text, in that order."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    sizes = np.array([len(own) for own in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if not len(ends) or not ends[-1]:
        return found
    flat = pa.array([word for own in words for word in own], pa.large_binary())
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    docs = np.repeat(np.arange(len(words)), sizes)
    order, alike = suffix_order(codes, docs, ends)
    shared = shared_with_previous(codes, docs, starts, ends, order, alike)
    # Stretches of the order that share enough words, and have places near enough for a run.
    linked = shared >= least_shared(times, least)
    member = linked.copy()
    member[:-1] |= linked[1:]
    slots = np.flatnonzero(member)
    if not len(slots):
        return found
    stretch = np.cumsum(~linked[slots]) - 1
    longest = np.zeros(stretch[-1] + 1, dtype=np.int64)
    np.maximum.at(longest, stretch, np.where(linked[slots], shared[slots], 0))
    by_place = np.lexsort((order[slots], stretch))
    gap = np.diff(order[slots][by_place])
    close = (stretch[by_place][1:] == stretch[by_place][:-1]) & (gap <= longest[stretch[by_place][1:]] // (times - 1))
    useful = np.zeros(len(longest), dtype=bool)
    useful[stretch[by_place][1:][close]] = True
    slots = slots[useful[stretch]]
    before = np.full(len(codes), -1, dtype=np.int64)
    before[1:] = codes[:-1]
    before[starts[sizes > 0]] = -1
    spans: dict[tuple[int, int], int] = {}
    left = dict(zip(order[slots].tolist(), before[order[slots]].tolist(), strict=True))
    depths = np.where(linked[slots], shared[slots], 0)
    for at, distance, length in maximal_pairs(order[slots].tolist(), depths.tolist(), left, times, least):
        span = at, length + distance
        # A run is found with its period's multiples, too.
        spans[span] = min(distance, spans.get(span, distance))
    for (at, length), period in spans.items():
        doc = int(docs[at])
        found[doc].append((at - int(starts[doc]), length, period))
    for own in found:
        own.sort(key=lambda run: (run[0], run[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat a run's first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()])


def find_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """One row per document: ``doc_id, runs, collapsed``.

    A run is a stretch of words with smallest period ``q`` that holds at least ``least`` words
    and ``times`` periods, and that no neighbouring word extends with that period.  ``runs``
    lists start, length and period of all of them by start, then period; ``collapsed`` is the
    text with only the first period of each run.  A null or empty text has no runs and an
    empty ``collapsed``; rows with the same id or text each get their row; an empty table
    gives an empty result; columns other than ``doc_id`` and ``text`` are not looked at.

    Documents are worked off in their partition, without a shuffle, about a megabyte of texts
    at a time; a longer text by itself.  Time grows with the words, nearly: a text's places
    are merged from smaller lists into larger ones.
    """
    if times < 4 or least < 5:
        raise ValueError("a run holds its period four times, and five words, at least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunked(batch, batch.column(1)):
                words = [text.split() for text in part.column(1).cast(pa.large_binary()).to_pylist()]
                found = runs_of(words, times, least)
                rows = [[{"start": a, "length": n, "period": q} for a, n, q in own] for own in found]
                texts = [collapsed(own, runs) for own, runs in zip(words, found, strict=True)]
                arrays = [part.column(0), pa.array(rows, RUNS), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        search, f"doc_id {kind}, runs array<{RUN}>, collapsed string"
    )


def strongest(runs: Column) -> Column:
    """The run with the greatest length in periods; of ties the first.  Null if there is none."""
    none = F.lit(None).cast(RUN)
    more = lambda best, run: run["length"] * best["period"] > best["length"] * run["period"]
    return F.reduce(runs, none, lambda best, run: F.when(best.isNull() | more(best, run), run).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, with the end of one text in ten made periodic, by the checksum of its id.

    The words from number ``a`` on repeat the ``p`` words there; texts of other documents, and
    those without words or id, stay as they are."""
    words = F.filter(F.split(whole_text(), SPACE), lambda word: word != "")
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumn("_g", F.when(checksum % 10 == 0, F.floor(checksum / 10)))
    n, a = F.size("_words"), (F.col("_g") % F.size("_words")).cast("int")
    period = (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int")
    source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % period)
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", source(i)))
    chosen = chosen.withColumn("_words", F.when(F.col("_g").isNotNull(), words))
    text = F.when(n > 0, F.array_join(places, " ")).otherwise(F.col("text"))
    return chosen.withColumn("text", text).drop("_g", "_words")


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the strongest run, and digests of all runs and of the collapsed text."""
    line = lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])
    lines = F.transform("runs", lambda run: F.concat(line(run), F.lit("\n")))
    best = found.withColumn("_best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{name}").alias(name) for name in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
