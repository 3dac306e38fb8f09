"""Personal data: fixed patterns, and a skip-chain conditional random field beside them.

Words with a digit or an ``@`` are the nodes of a graph for each document.  Neighbouring nodes
share transition potentials; nodes of the same digits or the same letters share skip
potentials, however far apart they are.  Loopy belief propagation makes labels agree along
both.  What the patterns find is clamped.  Weights are fitted to counts over the whole corpus.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import whole_text

#: The kinds, in this order, and their patterns.  An address is looked for at every
#: ``@``: LOCAL characters before it, DOMAIN after it.  A match of IP can only begin where a run
#: of digits does.  So each character is looked at a bounded number of times, in any text.
KINDS = ("email", "ip", "card", "phone")
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LABELS = len(KINDS) + 1
#: A label must be as sure as this to add a span.
SURE = 0.95
ROUNDS = 20
MARKS = re.compile(r"[0-9@]+")
REST = re.compile(r"[^\x20\x09-\x0D]*")
SPACE = " \t\n\x0b\x0c\r"
TRIM = ".,;:!?()[]{}\"'#$%&*|<>="


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that do not overlap, as start and end."""
    after, at = 0, text.find("@")
    while at >= 0:
        begin = after + len(text[after:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
        after = found.end() if found else at + 1
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of what the patterns find, sorted."""
    out = []
    if "@" in text:
        out += [(start, 0, end) for start, end in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


class Graph:
    """Nodes and edges of any number of documents."""

    def __init__(self) -> None:
        self.masks: list[int] = []
        self.first: list[int] = []  # the first node of each document
        self.fixed: list[int] = []  # label by the patterns, 0 for none
        self.spans: list[tuple[int, int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, text: str, base: list[tuple[int, int, int]]) -> None:
        last_end, previous, alike, at = -1, 0, {}, 0
        self.first.append(len(self.masks))
        for m in MARKS.finditer(text):
            if m.start() < last_end:
                continue
            start, end = m.start(), REST.match(text, m.end()).end()
            while start > max(last_end, 0) and text[start - 1] not in SPACE:
                start -= 1
            raw, core = text[start:end], text[start:end].strip(TRIM)
            begin = start + raw.find(core) if core else start
            node = len(self.masks)
            beside = last_end >= 0 and not text[last_end:start].strip(SPACE)
            self.masks.append(features(raw, core, previous if beside else 0))
            while at < len(base) and base[at][2] <= begin:
                at += 1
            over, k = [], at
            while k < len(base) and base[k][0] < begin + len(core):
                over += [base[k][1]] if base[k][2] > begin else []
                k += 1
            self.fixed.append(min(over) + 1 if over else 0)
            self.spans.append((begin, begin + len(core)))
            if beside:
                self.chain.append((node - 1, node))
            digits = _digits(core)
            for form in {digits if len(digits) >= 6 else "", core.lower() if len(core) >= 6 else ""} - {""}:
                if form in alike and alike[form] != node - 1:
                    self.skip.append((alike[form], node))
                alike[form] = node
            last_end, previous = end, self.masks[-1]


#: Features of a word, one bit each.
N_FEATURES = 16


def features(raw: str, core: str, previous: int) -> int:
    digits, plain = _digits(core), core.replace("-", "").replace(" ", "")
    only = plain.isdigit() and plain.isascii()
    n = len(digits)
    letters = any(c.isalpha() for c in core)
    quad = core.split(".")
    tests = (
        True,
        "@" in core and "." in core.partition("@")[2],
        only and 12 <= n <= 19 and luhn(digits),
        only and 12 <= n <= 19 and not luhn(digits),
        only and n < 6,
        only and 6 <= n < 12,
        only and n > 19,
        len(quad) == 4 and all(p.isdigit() and p.isascii() and _small(p) for p in quad),
        "." in core and not letters and len(quad) != 4,
        raw.startswith("+") and n > 0,
        raw.startswith("(") and raw.rstrip(".,;").endswith(")") and only,
        only and "-" in core,
        letters and n > 0 and "@" not in core,
        letters and len(core) >= 32,
        bool(previous >> 9 & 1),
        bool(previous >> 10 & 1),
    )
    return sum(1 << k for k, true in enumerate(tests) if true)


def is_open(mask: int, fixed: int) -> bool:
    """Whether nothing is known of a word: the patterns took it for nothing, though by itself it
    is an address, a card with a right check digit, four small numbers, or a number after a
    plus sign."""
    number = mask >> 9 & 1 and mask & 0b101100
    return not fixed and bool(mask & 0b10000110 or number)


def _table(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(N_FEATURES) & 1).astype(float)


class Model:
    """Potentials fitted to counts: of (features, label), and of label pairs along edges."""

    def __init__(self, counts: dict[tuple[str, int, int], int]):
        words = [(a, b, n) for (what, a, b), n in counts.items() if what == "word"]
        self.weights = np.zeros((N_FEATURES, LABELS))
        self.known = bool(words)
        if words:
            masks, labels, n = (np.array(x) for x in zip(*words, strict=True))
            x, share = _table(masks), n / n.sum()
            target = np.eye(LABELS)[labels]
            for _ in range(2000):
                score = x @ self.weights
                p = np.exp(score - score.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                self.weights += 2.0 * (x.T @ ((target - p) * share[:, None]) - 1e-4 * self.weights)
        self.pairs = [self._pair(counts, what) for what in ("chain", "skip")]

    @staticmethod
    def _pair(counts: dict[tuple[str, int, int], int], what: str) -> np.ndarray:
        """Log of how much more often two labels meet than by chance, between -3 and 3."""
        table = np.full((LABELS, LABELS), 0.5) + np.eye(LABELS)
        for (kind, a, b), n in counts.items():
            if kind == what:
                table[a, b] += n
        share = table / table.sum()
        return np.clip(np.log(share / np.outer(share.sum(axis=1), share.sum(axis=0))), -3, 3)

    def posteriors(self, graph: Graph) -> np.ndarray:
        """Loopy belief propagation, with damping, over all nodes at once.

        A document's messages stop when its own hardly change, so what it gets does not depend
        on the documents beside it."""
        masks, fixed = np.array(graph.masks, dtype=np.int64), np.array(graph.fixed, dtype=np.int64)
        words = _table(masks)
        own = np.zeros((len(masks), LABELS))
        for k in range(N_FEATURES):
            own += words[:, k, None] * self.weights[k]
        own[np.arange(len(own)), fixed] += np.where(fixed > 0, 30.0, 0.0)
        a, b, pair = [], [], []
        for edges, table in ((graph.chain, self.pairs[0]), (graph.skip, self.pairs[1])):
            for i, j in edges:
                a += [i, j]
                b += [j, i]
                pair += [table, table.T]
        belief = own
        if a:
            source, to, tables = np.array(a), np.array(b), np.array(pair)
            back = np.arange(len(a)) ^ 1
            doc = np.searchsorted(np.array(graph.first), source, side="right")
            message = np.zeros((len(a), LABELS))
            live = np.arange(len(a))
            for _ in range(ROUNDS):
                before = belief[source[live]] - message[back[live]]
                new = np.logaddexp.reduce(before[:, :, None] + tables[live], axis=1)
                new -= np.logaddexp.reduce(new, axis=1)[:, None]
                change = np.zeros(len(graph.first) + 1)
                np.maximum.at(change, doc[live], np.abs(new - message[live]).max(axis=1))
                message[live] = 0.5 * message[live] + 0.5 * new
                belief = own.copy()
                np.add.at(belief, to, message)
                live = live[change[doc[live]] >= 1e-3]
                if not len(live):
                    break
        return np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None])


def added_spans(graph: Graph, p: np.ndarray, first: int, to: int) -> list[tuple[int, int, int]]:
    """What the field adds in one document: nodes of a sure label that no pattern covers.

    Neighbouring nodes of a telephone number are one span."""
    beside, out = set(graph.chain), []
    open_at = None
    for node in range(first, to):
        label = int(p[node].argmax())
        if not label or p[node, label] < SURE or graph.fixed[node] or graph.spans[node][0] == graph.spans[node][1]:
            continue
        start, end = graph.spans[node]
        if label == 4 and open_at == node - 1 and (node - 1, node) in beside:
            out[-1] = (out[-1][0], label - 1, end)
        else:
            out.append((start, label - 1, end))
        open_at = node if label == 4 else None
    return out


FOUND = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
    "base_sha256 string, spans string, n_added long"
)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the patterns' counts by kind, ``base_sha256`` over
    their spans, ``spans`` of patterns and field, and ``n_added`` by the field.

    Spans are ``kind:start:end`` in code points, the end exclusive, by start and then kind.
    A null text is empty and has none.  Equal rows get equal results; an empty table gives an
    empty result; columns other than ``doc_id`` and ``text`` are not looked at.  Only texts
    with a digit or ``@`` leave the JVM.  The weights come from counts over all documents, of
    which the driver gets one number for each set of features and label that occurs; words that
    are entities by themselves, but that the patterns joined to others and rejected, are not
    counted, so the field is not fitted to what the patterns miss.
    """
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike("[0-9@]"), text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int, int]] = Counter()
        for batch in batches:
            for text in batch.column(0):
                graph, text = Graph(), text.as_py()
                graph.add(text, base_spans(text))
                unknown = [is_open(m, f) for m, f in zip(graph.masks, graph.fixed, strict=True)]
                known = zip(graph.masks, graph.fixed, unknown, strict=True)
                counts.update(("word", m, f) for m, f, u in known if not u)
                for what, edges in (("chain", graph.chain), ("skip", graph.skip)):
                    pairs = [(i, j) for i, j in edges if not unknown[i] and not unknown[j]]
                    counts.update((what, graph.fixed[i], graph.fixed[j]) for i, j in pairs)
        what, a, b = zip(*counts, strict=True) if counts else ((), (), ())
        arrays = [pa.array(what, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts.values(), pa.int64())], names=["what", "a", "b", "n"])

    seen = rows.where(F.col("text").isNotNull()).select("text").mapInArrow(count, "what string, a long, b long, n long")
    sums = seen.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    model = Model({(r["what"], r["a"], r["b"]): r["n"] for r in sorted(sums)})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        kinds = {f"n_{kind}": pa.int64() for kind in KINDS}
        kinds |= {"base_sha256": pa.string(), "spans": pa.string(), "n_added": pa.int64()}
        for batch in batches:
            graph, cases = Graph(), {}
            for k, text in enumerate(batch.column(1)):
                if text.is_valid:
                    text, first = text.as_py(), len(graph.masks)
                    base = base_spans(text)
                    graph.add(text, base)
                    cases[k] = base, first, len(graph.masks)
            p = model.posteriors(graph) if graph.masks else np.zeros((0, LABELS))
            columns: dict[str, list] = {name: [] for name in kinds}
            for k in range(batch.num_rows):
                base, first, to = cases.get(k, ([], 0, 0))
                more = added_spans(graph, p, first, to) if to > first else []
                for number, kind in enumerate(KINDS):
                    columns[f"n_{kind}"].append(sum(s[1] == number for s in base))
                columns["base_sha256"].append(hashlib.sha256(_listed(base).encode()).hexdigest() if base else nothing)
                columns["spans"].append(_listed(sorted(base + more)))
                columns["n_added"].append(len(more))
            arrays = [batch.column(0), *(pa.array(columns[name], kind) for name, kind in kinds.items())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns])

    return rows.mapInArrow(find, FOUND)
