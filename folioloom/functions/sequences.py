"""Listed character sequences found in texts, by rolling hashes over arrays of code points.

A hash only points at places; what is found there is compared character by character, so
results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Sequences up to this length are looked up everywhere, longer ones where their beginning is listed.
SEED = 6
#: Places of the table of listed sequences; it takes half a megabyte as bits.
PLACES = 1 << 22
#: Places that stand for a whole sequence: one that no term is must have all of them by chance.
PROBES = 3
#: Code points worked on together, unless one text is longer; so many stay near the core.
SLICE = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _mixed(numbers: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Numbers whose high bits depend on all bits of the given ones."""
    mixed = numbers + np.atleast_1d(salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    return mixed


def _place(hashes: np.ndarray, kind: int, probe: int = 0) -> np.ndarray:
    return (_mixed(hashes, kind + (probe << 32)) >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)


def _in_table(table: np.ndarray, hashes: np.ndarray, kind: int) -> np.ndarray:
    """Numbers of the hashes that have all their places in the table."""
    found = np.flatnonzero(table[_place(hashes, kind)])
    for probe in range(1, PROBES):
        found = found[table[_place(hashes[found], kind, probe)]]
    return found


class Points:
    """Texts joined to one array of code points, with the hash of any stretch of it."""

    def __init__(self, texts: list[str]):
        self.joined = "".join(texts)
        self.codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        n = len(self.codes)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.codes + np.uint64(1)) * _powers(_BASE, n), out=self._sums[1:])
        self._back = _powers(_BACK, n)

    def hashes(self, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of the stretches of a length that begin at the given places, or at every one."""
        if at is not None:
            return (self._sums[at + length] - self._sums[at]) * self._back[at]
        n = max(0, len(self.codes) - length + 1)
        return (self._sums[length : length + n] - self._sums[:n]) * self._back[:n]


def places_of(terms: list[str]) -> tuple[np.ndarray, set[int]]:
    """Places in the table that stand for terms and the beginnings of long ones; their lengths."""
    lengths = {len(t) for t in terms}
    found = [np.empty(0, np.int64)]
    for length in lengths:
        same = [t for t in terms if len(t) == length]
        points, starts = Points(same), np.arange(len(same)) * length
        found += [_place(points.hashes(length, starts), length, probe) for probe in range(PROBES)]
        if length > SEED:
            found.append(_place(points.hashes(SEED, starts), 0))
    return np.unique(np.concatenate(found)), lengths


def sliced(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``SLICE`` characters, each with the number of its first text."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= SLICE:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0
    yield first, texts[first:]


def _listed(
    points: Points, table: np.ndarray, lengths: list[int]
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: where stretches that the table has begin, their hashes and their texts' numbers."""
    n = len(points.codes)
    seeded = None
    for length in lengths:
        if length > n:
            continue
        if length <= SEED:
            hashes = points.hashes(length)
            at = _in_table(table, hashes, length)
            hashes = hashes[at]
        else:
            if seeded is None:
                seeded = np.flatnonzero(table[_place(points.hashes(SEED), 0)])
            at = seeded[seeded + length <= n]
            hashes = points.hashes(length, at)
            listed = _in_table(table, hashes, length)
            at, hashes = at[listed], hashes[listed]
        owners = np.searchsorted(points.ends, at, side="right")
        inside = at + length <= points.ends[owners]
        yield length, at[inside], hashes[inside], owners[inside]


def count_listed(
    texts: list[str], table: np.ndarray, lengths: list[int]
) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """For each length: numbers of texts, sequences in them that the table has, and how often
    they occur without overlap.  A few sequences that no term is may be among them."""
    points = Points(texts)
    for length, at, hashes, owners in _listed(points, table, lengths):
        yield _counted(points, texts, at, hashes, owners, length)


def count_texts(
    texts: list[str], table: np.ndarray, lengths: list[int]
) -> Iterator[tuple[list[str], np.ndarray]]:
    """Sequences that the table has, and in how many of the texts each occurs.  A few sequences
    that no term is may be among them."""
    points = Points(texts)
    for length, at, hashes, owners in _listed(points, table, lengths):
        while len(at):
            order = np.argsort(hashes, kind="stable")
            at, hashes, owners = at[order], hashes[order], owners[order]
            heads, group, same = _alike(points, at, hashes, length)
            # Places of a group are in the order of the texts.
            of, owned = group[same], owners[same]
            fresh = np.r_[True, (of[1:] != of[:-1]) | (owned[1:] != owned[:-1])]
            words = [points.joined[p : p + length] for p in at[heads].tolist()]
            yield words, np.bincount(of[fresh], minlength=len(heads))
            at, hashes, owners = at[~same], hashes[~same], owners[~same]


def _alike(points, at, marks, length):
    """Of sorted marks: where groups of equal ones begin, every place's group, and whether it has
    the characters of the group's first.  What only shares its mark with it has another turn."""
    opens = np.r_[True, marks[1:] != marks[:-1]]
    heads, group = np.flatnonzero(opens), np.cumsum(opens) - 1
    first = at[heads][group]
    same = np.ones(len(at), bool)
    for j in range(length):
        same &= points.codes[at + j] == points.codes[first + j]
    return heads, group, same


def _counted(points, texts, at, hashes, owners, length):
    """Equal stretches of a text counted together."""
    numbers, found, counts = [np.empty(0, np.int64)], [], [np.empty(0, np.int64)]
    while len(at):
        mark = _mixed(hashes, owners)
        order = np.argsort(mark, kind="stable")
        at, hashes, owners, mark = at[order], hashes[order], owners[order], mark[order]
        heads, group, same = _alike(points, at, mark, length)
        owned = owners[heads]
        same &= owners == owned[group]
        kept, of = at[same], group[same]
        n = np.bincount(of, minlength=len(heads))
        words = [points.joined[p : p + length] for p in at[heads].tolist()]
        close = (kept[1:] - kept[:-1] < length) & (of[1:] == of[:-1])
        for g in np.unique(of[1:][close]).tolist():
            n[g] = texts[owned[g]].count(words[g])
        numbers.append(owned)
        found += words
        counts.append(n)
        at, hashes, owners = at[~same], hashes[~same], owners[~same]
    return np.concatenate(numbers), found, np.concatenate(counts)
