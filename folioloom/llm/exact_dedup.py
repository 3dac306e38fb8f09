"""Exact duplicates by Patricia tries over length-and-hash partitions.

Every input partition first merges its own copies, so a text with a third of all rows leaves
each task once.  The distinct texts that remain are dealt to partitions by length and content
hash; each partition inserts the full bytes of all its texts into one compressed radix trie,
whose terminal nodes hold the row to keep, and spills subtrees where memory ends.  A text that
very many tasks have is merged in a salted round before.  Documents then look up the verdict of
the text they were merged into.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import settle, whole_text


#: What a node takes in memory besides its bytes, roughly.
NODE_BYTES = 300


def common_length(a: bytes, b: bytes) -> int:
    """How many leading bytes two byte strings share."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    """A node of a Patricia trie: the bytes that lead to it, its branches, its payload."""

    __slots__ = ("branches", "edge", "payload", "spilled")

    def __init__(self, edge: bytes, payload: Any = None):
        self.edge, self.payload = edge, payload
        self.branches: dict[int, Node] = {}
        self.spilled: Spill | None = None


class Spill:
    """Entries of one subtree, kept in a file of the task until the rest is done."""

    def __init__(self) -> None:
        # It has no name, so it is gone with its task, however that ends.
        self.file = tempfile.TemporaryFile(prefix="trie-")

    def add(self, rest: bytes, payload: Any) -> None:
        pickle.dump((rest, payload), self.file)

    def entries(self) -> Iterator[tuple[bytes, Any]]:
        self.file.seek(0)
        with self.file:
            while True:
                try:
                    yield pickle.load(self.file)
                except EOFError:
                    break


class OwnerTrie:
    """Byte strings with merged payloads, in about ``limit`` bytes of memory.

    Beyond the limit the largest subtree goes to a file; what belongs below it later follows,
    and :meth:`items` works the files off, each in a trie of its own.
    """

    def __init__(self, merge: Callable[[Any, Any], Any], limit: float = float("inf")):
        self.merge, self.limit, self.size, self.root = merge, limit, 0, Node(b"")

    def insert(self, key: bytes, payload: Any) -> Any:
        """Merge the payload into the key's terminal node and return what is there now."""
        node, at = self.root, 0
        while not node.spilled and at < len(key):
            child = node.branches.get(key[at])
            if child is None:
                child = node.branches[key[at]] = Node(key[at:])
                self.size += len(key) - at + NODE_BYTES
            elif not key.startswith(child.edge, at):
                cut = common_length(child.edge, key[at : at + len(child.edge)])
                upper = node.branches[key[at]] = Node(child.edge[:cut])
                child.edge = child.edge[cut:]
                upper.branches[child.edge[0]] = child
                self.size += NODE_BYTES
                child = upper
            node, at = child, at + len(child.edge)
        if node.spilled:
            node.spilled.add(key[at:], payload)
            return None
        node.payload = payload if node.payload is None else self.merge(node.payload, payload)
        kept = node.payload
        if self.size > self.limit:
            self._spill()
        return kept

    def _spill(self) -> None:
        """Move the largest branch below the first fork to a file."""
        fork = self.root
        while len(fork.branches) == 1 and fork.payload is None:
            fork = next(iter(fork.branches.values()))
        held = [child for child in fork.branches.values() if not child.spilled]
        if not held:
            return
        heaviest = max(held, key=lambda child: sum(NODE_BYTES + len(node.edge) for _, node in _below(child)))
        file = Spill()
        for path, node in _below(heaviest):
            self.size -= NODE_BYTES + len(node.edge)
            if node.spilled:
                for rest, payload in node.spilled.entries():
                    file.add(path + rest, payload)
            elif node.payload is not None:
                file.add(path, node.payload)
        self.size += NODE_BYTES + len(heaviest.edge)
        heaviest.branches, heaviest.payload, heaviest.spilled = {}, None, file

    def items(self) -> Iterator[tuple[bytes, Any]]:
        for path, node in _below(self.root):
            if node.spilled:
                rests = OwnerTrie(self.merge, self.limit)
                for rest, payload in node.spilled.entries():
                    rests.insert(rest, payload)
                for rest, payload in rests.items():
                    yield path + rest, payload
            elif node.payload is not None:
                yield path, node.payload


    def forks(self) -> int:
        """How many nodes branch, of those in memory."""
        return sum(len(node.branches) > 1 for _, node in _below(self.root))


def _below(top: Node) -> Iterator[tuple[bytes, Node]]:
    """The node and all below it, each with its path from ``top``."""
    stack = [(b"", top)]
    while stack:
        path, node = stack.pop()
        yield path, node
        stack.extend((path + child.edge, child) for child in node.branches.values())


LOCAL = (
    "owner long, row long, doc_id long, text_sha256 string, "
    "length long, hash long, text binary, n long, best_id long, best_row long"
)
VERDICT = "owner long, keep_id long, keep_row long, group_size long"
FOLDED = "owner long, into long, length long, hash long, text binary, n long, best_id long, best_row long"
#: What a text is inserted with.
TEXTS = ("owner", "text", "n", "best_id", "best_row")
#: Tasks that may send the same text to one partition, without a round before.
MANY = 64
KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, KINDS[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    arrays = [pa.array(values, type=field.type) for values, field in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def owners(
    docs: DataFrame,
    keep: str = "smallest",
    fold_case: bool = True,
    hash_bits: int = 64,
    memory: int = 64 << 20,
    many: int = MANY,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are, after lower-casing ``A-Z`` (with ``fold_case``).
    ``keep`` names which id of a group stays, ``smallest`` or ``largest``.  A null text is the
    empty text.  Documents without id come after all others; of rows with the same id the
    first one stays, so every group keeps exactly one row.  An empty table gives an empty
    result.  Columns other than ``doc_id`` and ``text`` are not looked at.  ``hash_bits``
    shortens the content hash, which changes no result; ``memory`` bounds a task's tries, and
    ``many`` how often a text comes to one partition without a salted round before.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    sign = -1 if keep == "largest" else 1
    local_schema, verdict_schema = _schema(LOCAL), _schema(VERDICT)

    def first(a: tuple, b: tuple) -> tuple:
        """Of two (id, row) the one to keep."""
        return min(a, b, key=lambda x: (x[0] is None, 0 if x[0] is None else sign * x[0], x[1]))

    def short_hash(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little", signed=True) & ((1 << hash_bits) - 1 if hash_bits < 64 else -1)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merge(a: tuple, b: tuple) -> tuple:
            return a[0], first(a[1], b[1]), a[2] + b[2]

        tries: dict[tuple[int, int], OwnerTrie] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            out, size = [], 0
            for (length, short), trie in tries.items():
                for data, (owner, best, n) in trie.items():
                    out.append((owner, None, None, None, length, short, data, n, *best))
                    size += length
                    if size > 4 << 20:
                        yield _batch(out, local_schema)
                        out, size = [], 0
            yield _batch(out, local_schema)
            tries.clear()

        row, held = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            light = []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for doc_id, data in zip(batch.column(0).to_pylist(), texts, strict=True):
                data = data.lower() if fold_case else data
                sha = hashlib.sha256(data)
                key = len(data), short_hash(sha.digest())
                trie = tries.setdefault(key, OwnerTrie(merge))
                before = trie.size
                owner = trie.insert(data, (row, (doc_id, row), 1))[0]
                light.append((owner, row, doc_id, sha.hexdigest(), *[None] * 6))
                row, held = row + 1, held + trie.size - before + NODE_BYTES
                if held > memory:
                    yield from flush()
                    held = 0
            yield _batch(light, local_schema)
        yield from flush()

    def together(a: tuple, b: tuple) -> tuple:
        a[0].extend(b[0])
        return a[0], first(a[1], b[1]), a[2] + b[2]

    def inserted(batches: Iterator[pa.RecordBatch]) -> OwnerTrie:
        """One trie of all texts of a partition, with the owners of each."""
        trie = OwnerTrie(together, memory)
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in map(batch.schema.get_field_index, TEXTS))
            for owner, data, n, best_id, best_row in zip(*columns, strict=True):
                trie.insert(data, (array("q", [owner]), (best_id, best_row), n))
        return trie

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, (members, best, n) in inserted(batches).items():
            out += [(owner, *best, n) for owner in members]
            if len(out) > 10_000:
                yield _batch(out, verdict_schema)
                out = []
        yield _batch(out, verdict_schema)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first owner with the text, and the other owners that go with it."""
        schema = _schema(FOLDED)
        for data, (members, best, n) in inserted(batches).items():
            rows = [(owner, members[0], *[None] * 6) for owner in members[1:]]
            yield _batch([(members[0], None, len(data), short_hash(hashlib.sha256(data).digest()), data, n, *best), *rows], schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    parts = settle(rows.mapInArrow(local, LOCAL), "exact-dedup")
    # One row for each distinct text of an input partition.
    place = ["length", "hash"]
    texts = parts.where(F.col("n").isNotNull()).select(*place, *TEXTS)
    counts = texts.groupBy(*place).agg(F.count(F.lit(1)).alias("_tasks"))
    frequent = settle(counts.where(F.col("_tasks") > many), "exact-dedup-frequent")
    salt = F.pmod(F.xxhash64("owner"), F.ceil(F.col("_tasks") / many))
    salted = texts.join(frequent, place).withColumn("_salt", salt).repartition(*place, "_salt")
    round_one = settle(salted.select(*place, *TEXTS).mapInArrow(folded, FOLDED), "exact-dedup-folded")
    whole = texts.join(frequent, place, "left_anti")
    whole = whole.unionByName(round_one.where(F.col("into").isNull()).select(*place, *TEXTS))
    verdict = settle(whole.repartition(*place).mapInArrow(merged, VERDICT), "exact-dedup-verdicts")
    others = round_one.where(F.col("into").isNotNull()).select("owner", "into")
    of_others = others.join(verdict.withColumnRenamed("owner", "into"), "into").select(verdict.columns)
    members = parts.where(F.col("row").isNotNull()).select("owner", "row", "doc_id", "text_sha256")
    return members.join(verdict.unionByName(of_others), "owner").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        "text_sha256",
    )
