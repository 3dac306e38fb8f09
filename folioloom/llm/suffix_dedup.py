"""Repeated passages by sparse suffix arrays.

Of the suffixes of all texts only those are kept that begin at minimiser positions: places
whose run of ``GRAM`` words has the smallest hash of a window of such runs.  A passage of
``MIN_WORDS`` words holds at least one, and the same ones wherever it occurs.  Suffixes are
sorted by their first run, the words that follow and those before; neighbours are compared by
hashes of these; where a match begins or ends, the words beside it are compared.  Order settles
only runs that occur twice: of runs that occur more often, all passages of ``MIN_WORDS`` words
whose minimiser they are get counted by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import WORD, settle, whole_text
from folioloom.llm.wordhash import Ranges, grams, hashed_texts

MIN_WORDS = 50
GRAM = 20
#: Runs in a window, so that a window has MIN_WORDS words.
WINDOW = MIN_WORDS - GRAM + 1
#: Words that are compared beside the outermost samples of a match.
BESIDE = 32
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(values: np.ndarray, size: int, pick: np.ufunc, fill: np.uint64) -> np.ndarray:
    """``pick`` of every ``size`` consecutive values: running picks over blocks, both ways."""
    n = len(values) - size + 1
    padded = np.full(-(-len(values) // size) * size + size, fill, dtype=values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, size)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[size - 1 : size - 1 + n])


def sampled(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run of words, which of them are minimisers, and the least run of every
    passage of ``MIN_WORDS`` words, 0 where the text ends before.

    ``first`` tells where the texts begin; windows do not cross their borders."""
    runs = grams(hashes, GRAM)
    chosen = np.zeros(len(runs), dtype=bool)
    if len(runs) < WINDOW:
        return runs, chosen, np.zeros(0, dtype=np.uint64)
    least = sliding(runs, WINDOW, np.minimum, MOST)
    room = np.repeat(first[1:], np.diff(first))[: len(least)] - np.arange(len(least))
    least = np.where(room >= MIN_WORDS, least, np.uint64(0))
    # A run is chosen if it is the least of a window that holds it: least of windows, at most.
    around = np.zeros(len(runs) + WINDOW - 1, dtype=np.uint64)
    around[WINDOW - 1 : WINDOW - 1 + len(least)] = least
    return runs, (sliding(around, WINDOW, np.maximum, np.uint64(0)) == runs) & (runs > 0), least


SAMPLES = "h long, r10 int, r20 int, r30 int, l5 int, l15 int, l32 int, key long, pos int, r1 int, l1 int"
ORDER = ["h", "r10", "r20", "r30", "l5", "l15", "l32", "key", "pos"]


def samples(docs: DataFrame) -> DataFrame:
    """One row per kept suffix, by which suffixes are sorted and compared.

    ``h`` stands for its first run, ``r10`` to ``r30`` for so many words after that (even where
    there are fewer), ``l5`` to ``l32`` for so many before it; ``r1`` and ``l1`` for all words to the next sample, or
    from the last, and that sample's run (0 where there is none)."""
    names = [part.split()[0] for part in SAMPLES.split(", ")]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = np.unique(batch.column(0).to_numpy(), return_index=True)[1]
            if len(once) < batch.num_rows:
                batch = batch.take(pa.array(np.sort(once)))
            keys = batch.column(0).to_numpy()
            for at, hashes, _, first in hashed_texts(batch.column(1)):
                runs, chosen, _ = sampled(hashes, first)
                place = np.flatnonzero(chosen)
                if not len(place):
                    continue
                owner = np.searchsorted(first, place, side="right") - 1
                begin, end, h, ranges = first[owner], first[owner + 1], runs[place], Ranges(hashes)

                def word(x: np.ndarray) -> np.ndarray:
                    return (x >> np.uint64(33)).astype(np.int32)

                after = place + GRAM
                columns = {"h": h.view(np.int64), "key": keys[at + owner], "pos": (place - begin).astype(np.int32)}
                for n in (10, 20, 30):
                    rest = word(ranges.hash(after, np.minimum(after + n, end)))
                    columns[f"r{n}"] = np.where(after + n <= end, rest | 1, rest & -2).astype(np.int32)
                for n in (5, 15, 32):
                    columns[f"l{n}"] = word(ranges.hash(np.maximum(place - n, begin), place))
                same = owner[1:] == owner[:-1]
                step = np.where(same, word(ranges.hash(place[:-1], np.where(same, place[1:], place[:-1])) ^ h[1:]) | 1, 0)
                back = np.where(same, word(ranges.hash(place[:-1], np.where(same, place[1:], place[:-1])) ^ h[:-1]) | 1, 0)
                columns["r1"] = np.append(step, 0).astype(np.int32)
                columns["l1"] = np.append(0, back).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(columns[name]) for name in names], names=names)

    return docs.mapInArrow(sample, SAMPLES)


NEAR = f"key long, begin int, end int, match long, side int, edge struct<{SAMPLES.replace(' ', ':').replace(',:', ',')}>"


def neighbours(sorted_samples: DataFrame, numbers: int = 0) -> DataFrame:
    """What sorted neighbours share.

    With null ``match``: words ``begin`` to ``end`` of a text that are repeated.  Otherwise the
    two sides of a match whose ends are still to be compared word by word; matches are counted
    from ``numbers``.  The first and last suffix of a partition come as ``edge``, to be
    compared across partitions.  Of repeated rows only one is looked at.
    """
    columns = [part.split()[0] for part in SAMPLES.split(", ")]

    def matches(rows: dict[str, np.ndarray], number: int, step: int) -> tuple[pa.RecordBatch, int]:
        a, b = ({k: v[s] for k, v in rows.items()} for s in (slice(None, -step), slice(step, None)))
        alike = a["h"] == b["h"]
        more = a["r10"] == b["r10"]
        if step > 1:
            alike &= ~more
        full = alike & more & (a["r20"] == b["r20"]) & (a["r30"] == b["r30"]) & (a["r30"] % 2 == 1)
        # Where the samples beside are alike as well, the match is extended from there.
        open_ended = alike & ((a["r1"] != b["r1"]) | (a["r1"] == 0) | (a["l1"] != b["l1"]) | (a["l1"] == 0))
        key, begin, end, match, side = [], [], [], [], []
        for which, n_words in ((full, MIN_WORDS), (open_ended, GRAM)):
            at = np.flatnonzero(which)
            for k, x in enumerate((a, b)):
                key.append(x["key"][at])
                begin.append(x["pos"][at])
                end.append(x["pos"][at] + n_words)
                match.append(number + np.arange(len(at)) if which is open_ended else np.full(len(at), -1))
                side.append(np.full(len(at), k))
        found = np.concatenate(match)
        arrays = [pa.array(np.concatenate(x), t) for x, t in ((key, pa.int64()), (begin, pa.int32()), (end, pa.int32()))]
        arrays += [pa.array(found, pa.int64(), mask=found < 0), pa.array(np.concatenate(side), pa.int32())]
        arrays.append(pa.nulls(len(found), edge_kind))
        return pa.RecordBatch.from_arrays(arrays, schema=schema), number + int(open_ended.sum())

    def edge(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        struct = pa.StructArray.from_arrays([pa.array(rows[name]) for name in columns], columns)
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, field.type) for field in list(schema)[:-1]), struct], schema=schema)

    edge_kind = pa.struct([(name, pa.int64() if name in ("h", "key") else pa.int32()) for name in columns])
    plain = [("key", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("match", pa.int64()), ("side", pa.int32())]
    schema = pa.schema([*plain, ("edge", edge_kind)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = numbers + (TaskContext.get().partitionId() << 36), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {name: batch.column(name).to_numpy() for name in columns}
            if last is None:
                yield edge({name: values[:1] for name, values in rows.items()})
            else:
                rows = {name: np.append(last[name], values) for name, values in rows.items()}
            new = np.append(True, (np.diff(rows["key"]) != 0) | (np.diff(rows["pos"]) != 0))
            rows = {name: values[new] for name, values in rows.items()}
            # Where little follows alike, order says little: the neighbour after the next, too.
            for step in (1, 2):
                begin = max(0, (0 if last is None else len(last["h"])) - step)
                out, number = matches({name: values[begin:] for name, values in rows.items()}, number, step)
                yield out
            last = {name: values[-2:] for name, values in rows.items()}
        if last is not None:
            yield edge({name: values[-1:] for name, values in last.items()})

    return sorted_samples.mapInArrow(compare, NEAR)


CONTEXT = "match long, side int, key long, begin int, end int, before binary, after binary, hash long"


def passages(hashes: np.ndarray, first: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where passages of ``MIN_WORDS`` words begin whose minimiser is in ``often`` or next to
    such a one, and their hashes.

    Next to it, because a match is not extended from minimisers inside it, and those beside
    may have been compared with others."""
    runs, chosen, least = sampled(hashes, first)
    place = np.flatnonzero(chosen)
    hit = np.isin(runs[place], often)
    near = hit.copy()
    near[1:] |= hit[:-1]
    near[:-1] |= hit[1:]
    begin = np.flatnonzero(np.isin(least, runs[place[near]]) & (least > 0))
    return begin, Ranges(hashes).hash(begin, begin + MIN_WORDS).view(np.int64)


def contexts(texts: DataFrame) -> DataFrame:
    """The words beside each open-ended match, and with null ``match`` the passages of frequent
    runs with their hash: ``texts`` has ``key, text, wanted, often``."""
    names = [part.split()[0] for part in CONTEXT.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, often = batch.column("key").to_numpy(), batch.column("often")
            for at, hashes, _, first in hashed_texts(batch.column("text")):
                short, out = (hashes >> np.uint64(32)).astype(np.uint32), []
                wanted = batch.column("wanted").slice(at, len(first) - 1).to_pylist()
                for k in range(len(first) - 1):
                    own = short[first[k] : first[k + 1]]
                    for w in wanted[k]:
                        begin, end = w["begin"], w["end"]
                        before = own[max(0, begin - BESIDE) : begin][::-1].tobytes()
                        after = own[end : end + BESIDE].tobytes()
                        out.append((w["match"], w["side"], int(keys[at + k]), begin, end, before, after, None))
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
                runs = often.slice(at, len(first) - 1).flatten().to_numpy().view(np.uint64)
                if not len(runs):
                    continue
                begin, found = passages(hashes, first, runs)
                owner = np.searchsorted(first, begin, side="right") - 1
                begin = (begin - first[owner]).astype(np.int32)
                arrays = [pa.nulls(len(begin), kind) for kind in kinds]
                arrays[2:5] = pa.array(keys[at + owner]), pa.array(begin), pa.array(begin + np.int32(MIN_WORDS))
                arrays[7] = pa.array(found)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return texts.mapInArrow(look, CONTEXT)


def _shared(a: bytes, b: bytes) -> int:
    """How many leading words two lists of word hashes share."""
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint32, n) != np.frombuffer(b, np.uint32, n)))


def extended(sides: DataFrame) -> DataFrame:
    """``key, begin, end`` of both sides of every match, extended as far as the words agree."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict | None = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if waiting is None or waiting["match"] != row["match"]:
                    waiting = row
                    continue
                left, right = _shared(waiting["before"], row["before"]), _shared(waiting["after"], row["after"])
                if row["end"] - row["begin"] + left + right >= MIN_WORDS:
                    out += [(x["key"], x["begin"] - left, x["end"] + right) for x in (waiting, row)]
                waiting = None
            key, begin, end = zip(*out, strict=True) if out else ((), (), ())
            arrays = [pa.array(key, pa.int64()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "begin", "end"])

    dealt = sides.repartition("match").sortWithinPartitions("match", "side")
    return dealt.mapInArrow(extend, "key long, begin int, end int")


def united(spans: DataFrame) -> DataFrame:
    """``key, begin, end`` with spans of a text that overlap or touch made one."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["key", "begin", "end"], []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, begin, end = (np.append(np.array(held[k : k + 1], dtype=np.int64), batch.column(k).to_numpy()) for k in range(3))
            fresh = np.append(True, key[1:] != key[:-1])
            # Ends so far within a text: texts are set apart by more than any text's length.
            apart = (np.cumsum(fresh) - 1) << 32
            reach = np.maximum.accumulate(end + apart)
            heads = np.flatnonzero(np.append(True, (begin + apart)[1:] > reach[:-1]) | fresh)
            ends = (reach - apart)[np.append(heads[1:], len(key)) - 1]
            key, begin = key[heads], begin[heads]
            held = [int(x[-1]) for x in (key, begin, ends)]
            arrays = [pa.array(key[:-1]), pa.array(begin[:-1].astype(np.int32)), pa.array(ends[:-1].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        if held:
            arrays = [pa.array([x], kind) for x, kind in zip(held, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    dealt = spans.repartition("key").sortWithinPartitions("key", "begin")
    return dealt.mapInArrow(unite, "key long, begin int, end int")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Documents with passages of ``MIN_WORDS`` words or more that occur elsewhere, in the same
    document or another: ``doc_id, n_words, n_spans, n_repeated_words, spans``.

    ``spans`` lists ``begin:end`` in words, the end exclusive, overlapping ones united.  Words
    are runs of characters other than ASCII white space.  Documents without such a passage
    have no row; null and empty texts never have one.  Repeated rows repeat each other in
    full; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are
    not looked at.  A row's key is a 64-bit hash of its text: copies are looked at once.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    kept = settle(samples(rows.select("key", "text")), "suffixes")
    near = settle(neighbours(kept.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)), "neighbours")
    # Two suffixes for each partition.
    edges = near.where(F.col("edge").isNotNull()).select("edge.*").coalesce(1).sortWithinPartitions(*ORDER)
    near = near.union(settle(neighbours(edges, 1 << 60), "edges")).where(F.col("edge").isNull())

    open_ended = F.struct("match", "side", "begin", "end")
    several = (F.count(F.lit(1)) > 2) & ((F.min("key") < F.max("key")) | (F.min("pos") < F.max("pos")))
    # Settled, so that a frequent run is split where it is joined back.
    often = settle(kept.groupBy("h").agg(several.alias("several")).where("several").select("h"), "often")
    wanted = near.where(F.col("match").isNotNull()).select("key", open_ended.alias("match"), F.lit(None).cast("long").alias("h"))
    runs = kept.select("h", "key").join(often, "h").select("key", F.lit(None).cast(wanted.schema["match"].dataType).alias("match"), "h")
    wanted = wanted.union(runs).groupBy("key").agg(F.collect_list("match").alias("wanted"), F.collect_set("h").alias("often"))
    texts = rows.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")
    looked = settle(contexts(texts), "contexts")
    counted = looked.where(F.col("match").isNull()).select("hash", "key", "begin")
    again = counted.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("hash")
    again = settle(again, "again")
    lengths = rows.select("doc_id", "key", F.regexp_count("text", F.lit(WORD)).cast("int").alias("n_words"))
    repeated = lengths.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("n_words").alias("end"))
    repeated = repeated.where((F.col("n") > 1) & (F.col("end") >= MIN_WORDS))
    found = united(
        near.where(F.col("match").isNull())
        .select("key", "begin", "end")
        .union(extended(looked.where(F.col("match").isNotNull()).drop("hash")))
        .union(counted.join(again, "hash").select("key", "begin", (F.col("begin") + MIN_WORDS).alias("end")))
        .union(repeated.select("key", F.lit(0).alias("begin"), "end"))
    )
    found = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("_spans"))
    length = lambda s: (s["end"] - s["begin"]).cast("long")
    listed = F.transform("_spans", lambda s: F.concat_ws(":", s["begin"].cast("string"), s["end"].cast("string")))
    return lengths.join(found, "key").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("_spans").cast("long").alias("n_spans"),
        F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + length(s)).alias("n_repeated_words"),
        F.array_join(listed, ",").alias("spans"),
    )
