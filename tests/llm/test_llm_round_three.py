"""Periodic runs, alignment of tokenizers, SimHash anchors, and mends of other operators."""

import hashlib
import random
import time
from collections import Counter, defaultdict
from fractions import Fraction

import llm_models as models
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioloom.llm import (
    exact_dedup,
    jaccard_join,
    mixing,
    periodic_runs,
    pii_crf,
    simhash_anchors,
    token_alignment,
    token_counts,
    url_lists,
)

SCHEMA = "doc_id long, text string, source string, runs string, print string, block string, n string, start string"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "s", *["x"] * 5) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


# --- periodic runs ---------------------------------------------------------------------------

PERIODIC = st.lists(
    st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=5), st.integers(1, 9), st.integers(0, 40)),
    max_size=6,
).map(lambda parts: [w for unit, times, cut in parts for w in (unit * times)[: cut + 1]])


@given(st.lists(PERIODIC, max_size=4))
@settings(max_examples=300, deadline=None)
def test_runs_equal_brute_force(texts):
    assert periodic_runs.runs_of(texts) == [models.runs(words) for words in texts]


@given(PERIODIC, st.integers(4, 6), st.integers(5, 12))
@settings(max_examples=150, deadline=None)
def test_runs_of_other_lengths(words, times, least):
    assert periodic_runs.runs_of([words], times, least) == [models.runs(words, times, least)]


def test_runs_in_documents(spark):
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 80)) for _ in range(60)]
    texts += ["", None, " \t\n", "a " * 9, "a b " * 40, "x " + "p q r " * 5000, "　 a\x1cb \xa0 " * 9, "a " * 9]
    ids = [*range(len(texts) - 2), None, 5]
    found = periodic_runs.find_runs(table(spark, texts, ids).repartition(3))
    got = Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in found.collect())
    want = Counter()
    for i, text in zip(ids, texts, strict=True):
        words = models.WORDS.findall(text or "")
        runs = models.runs(words)
        want[i, tuple(runs), models.collapsed(words, runs)] += 1
    assert got == want
    planted = periodic_runs.with_planted_runs(table(spark, texts, ids))
    assert planted.columns == table(spark, texts, ids).columns
    rows = periodic_runs.digests(periodic_runs.find_runs(planted)).collect()
    want = Counter()
    for i, text in zip(ids, texts, strict=True):
        words = models.planted(i, models.WORDS.findall(text or ""))
        runs = models.runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        more = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, models.collapsed(words, runs))]
        want[(i, len(runs), *more, *digests)] += 1
    assert Counter(map(tuple, rows)) == want


def test_runs_of_a_long_text_take_no_square_of_it():
    rng = random.Random(1)
    phrase = [x for k in range(20_000) for x in (b"p", b"q", b"r", b"s", b"t", b"%d" % rng.randrange(10**9))]
    begin = time.monotonic()
    assert periodic_runs.runs_of([phrase]) == [[]]
    assert periodic_runs.runs_of([[b"a"] * 60_000]) == [[(0, 60_000, 1)]]
    assert time.monotonic() - begin < 60


# --- alignment -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabularies():
    return token_alignment.byte_level(BYTES), token_alignment.pieces(PIECES)


ODD = [
    "", None, " ", "  a  b ", "<|endoftext|> <s></s>", "ﬁ ½ é 日本  \x00y", "a ▁ b", "it's 12 3's\n\n x\r\n\ty 　z \x85 w",
    " a\xa0 b c\x1c d \n\n e  f", "İstanbul ẞ \U0001f600 \U0001f600\U0001f600", "a" * 3000, "é ́x", "(\"a\") -b– „c“ ",
]


def test_segments_have_the_tokens_of_the_text(vocabularies):
    known = token_alignment.Segments(*vocabularies, most=40)
    rng = random.Random(2)
    letters = "ab'. ,\n\t  éß日1　▁-"
    texts = [t for t in ODD if t] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    for k in range(0, len(texts), 7):  # forgets on the way
        part = texts[k : k + 7]
        numbers, sizes = known.of(part)
        at = 0
        for text, n in zip(part, sizes.tolist(), strict=True):
            a, b, _, _ = models.aligned(text, *vocabularies)
            own = numbers[at : at + n]
            assert [known.tokens(side, own)[0].tolist() for side in (0, 1)] == [a, b], text
            at += n


@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30)), max_size=6), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_lockstep_equals_sets(docs, lane):
    a, b, first, base = [], [], [], 0
    for one, two in docs:
        one, two = one[:], two[:]
        short = one if sum(one) < sum(two) else two
        short[-1] += abs(sum(one) - sum(two))  # both cover the same bytes
        first.append(len(a))
        a += (base + np.cumsum(one)).tolist()
        b += (base + np.cumsum(two)).tolist()
        base += sum(one)
    links = token_alignment.common_ends(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(first, dtype=np.int64), lane)
    both = sorted(set(a) & set(b))
    assert [a[k] for k in links[0]] == both == [b[k] for k in links[1]]


def test_alignment_equals_brute_force(spark, vocabularies):
    rng = random.Random(6)
    texts = [*ODD, *(sentence(rng, rng.randint(1, 60)) for _ in range(25))]
    texts += [texts[-1]] * 4 + [sentence(rng, 3000)]
    ids = [*range(len(texts) - 1), None]
    done = [models.aligned(t, *vocabularies) for t in texts]
    counts = Counter(link for _, _, _, links in done for link in links)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = Counter()
    for i, (a, b, groups, links) in zip(ids, done, strict=True):
        listed = ";".join(groups)
        n_best, total = sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links)
        digest = hashlib.sha256(listed.encode()).hexdigest() if listed else ""
        want[i, len(a), len(b), len(groups), len(links), n_best, total, digest, listed] += 1
    for parts in (1, 5):
        rows = token_alignment.align_tokens(table(spark, texts, ids).repartition(parts), BYTES, PIECES, with_groups=True)
        assert Counter(map(tuple, rows.collect())) == want
    plain = token_alignment.align_tokens(table(spark, texts, ids), BYTES, PIECES)
    assert plain.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


# --- SimHash ---------------------------------------------------------------------------------


def test_anchors_cover():
    rng = np.random.default_rng(5)
    prints = np.concatenate([rng.integers(0, 1 << 64, 300, dtype=np.uint64), np.array([0, (1 << 64) - 1, 1 << 63], dtype=np.uint64)])
    rows, anchors = simhash_anchors.replicas(prints)
    sent = set(zip(rows.tolist(), anchors.tolist(), strict=True))
    assert len(sent) == len(rows)
    for k, value in enumerate(prints.tolist()):
        for _ in range(60):
            bits = rng.choice(64, int(rng.integers(0, 3)), replace=False)
            other = value
            for bit in bits.tolist():
                other ^= 1 << bit
            home, _ = simhash_anchors.homes(np.array([other], dtype=np.uint64))
            assert (k, int(home[0])) in sent


def test_codes_are_perfect():
    for _, code in simhash_anchors.codes():
        assert len({int(x) for x in code.leader}) == len(code.leader)
        assert (code.syndromes(code.leader) == np.arange(len(code.leader))).all()


def test_near_prints_equal_brute_force(spark):
    rng = random.Random(12)
    prints = {}
    for k in range(40):  # clusters of several widths, one of them dense
        value = rng.getrandbits(64)
        for _ in range(60 if k == 0 else 4):
            own = value
            for _ in range(rng.randint(0, 4)):
                own ^= 1 << rng.randrange(64)
            prints[len(prints)] = own
    want = models.near_prints(prints)
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    rows = spark.createDataFrame(signed, "doc_id long, print long")
    distinct = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    for dense in (0, 3, 64):
        links = simhash_anchors.near_prints(distinct, dense).collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links)
        by_print = dict((p, i) for i, p in reversed(signed))
        top = {i: i for i in prints}

        def find(i, top=top):
            while top[i] != i:
                i = top[i]
            return i

        for r in links:
            a, b = sorted((find(by_print[r.a]), find(by_print[r.b])))
            top[b] = a
        assert {i: find(by_print[p]) for i, p in signed} == want


def test_made_rows_are_not_broadcast(spark):
    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    # The first sixty have their home in common, the others are by themselves.
    prints = [*(1 << k for k in range(60)), *(random.Random(5).getrandbits(63) for _ in range(200))]
    distinct = spark.createDataFrame([(p,) for p in prints], "print long")
    links = simhash_anchors.near_prints(distinct, dense=8)
    own = list(nodes(links._jdf.queryExecution().sparkPlan()))
    assert {"MapInArrow", "Generate"} <= {n.nodeName() for n in own}
    for join in (n for n in own if n.nodeName() == "BroadcastHashJoin"):
        held = join.left() if join.buildSide().toString() == "BuildLeft" else join.right()
        assert not {"MapInArrow", "Generate"} & {n.nodeName() for n in nodes(held)}


def test_near_documents(spark):
    rng = random.Random(7)
    words = sentence(rng, 400).split()
    texts = ["", None, " \n", "a", "A b", "a b", "a b c", "A B C", "a b c d", "x " * 300, sentence(rng, 4000)]
    for k in range(12):
        own = words[:]
        own[30 * k] = f"w{k}"
        texts += [" ".join(own), " ".join(own).upper()]
    ids = [*range(100, 100 + len(texts) - 1), None]
    rows = simhash_anchors.near_documents(table(spark, texts, ids).repartition(3)).collect()
    prints = {i: models.simhash(t) for i, t in zip(ids, texts, strict=True) if i is not None}
    want = models.near_prints(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows if r.doc_id is not None} == {
        i: (f"{p:016x}", want[i]) for i, p in prints.items()
    }
    assert len(rows) == len(texts) and prints[100] == 0 and want[101] == 100
    alone = simhash_anchors.near_documents(table(spark, ["lone text"], [None])).collect()
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)]


@pytest.mark.parametrize(
    "apply",
    [
        lambda d: periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_planted_runs(d))),
        lambda d: token_alignment.align_tokens(d, BYTES, PIECES),
        lambda d: simhash_anchors.near_documents(d),
    ],
)
def test_empty_tables(spark, apply):
    assert apply(spark.createDataFrame([], SCHEMA)).count() == 0
    assert apply(spark.createDataFrame([(None,) * 8], SCHEMA)).count() == 1


# --- mends -----------------------------------------------------------------------------------

SIGNS = st.text(alphabet="a1.@-+ (9é%", max_size=40)


@given(SIGNS)
@settings(max_examples=400, deadline=None)
def test_patterns_equal_their_plain_form(text):
    spans = pii_crf.base_spans(text)
    assert ",".join(f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in spans) == models.pii(text)[2]


@pytest.mark.parametrize("unit", ["1", "a", "1.", "a@", "@", "+1", "1 ", ".a", "a@b.", "+(", "1-"])
def test_patterns_of_long_texts(unit):
    text = unit * (2_000_000 // len(unit)) + " a@b.cd"
    begin = time.monotonic()
    spans = pii_crf.base_spans(text)
    assert time.monotonic() - begin < 20
    assert unit in ("@", "a@", "+(", ".a", "a@b.", "a", "1", "1.", "+1", "1 ", "1-") and (not spans or spans == sorted(spans))


def test_field_finds_what_the_patterns_join(spark):
    rng = random.Random(4)

    def card():
        while True:
            digits = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if pii_crf.luhn(digits):
                return digits

    texts = [f"pay with {card()} now" for _ in range(60)]
    beside = [f"cards {a} {b} on file" for a, b in ((card(), card()) for _ in range(200))]
    clean = [f"order {rng.randrange(10**9, 10**10)}{rng.randrange(10**5)} of {k} items" for k in range(100)]
    texts += beside + clean
    rows = {r.doc_id: r for r in pii_crf.find_pii(table(spark, texts)).collect()}
    # Most of the cards are rejected by the pattern, as two side by side make 32 digits.
    found = [rows[60 + k].n_added for k in range(len(beside)) if not rows[60 + k].n_card]
    assert len(found) > 100 and sum(n == 2 for n in found) > 0.9 * len(found)
    assert sum(rows[k].n_added for k in range(260, 360)) <= 2
    again = {r.doc_id: r for r in pii_crf.find_pii(table(spark, texts).repartition(7)).collect()}
    assert rows == again


def test_a_document_gets_the_same_beside_others():
    texts = ["card 4465758382889437 4465758382889437 x 17", "1.2.3.4 and 1.2.3.4. a@b.cd 99", "+49 30 1234567 +49 30 1234567"]
    counts = {("word", m, f): 7 for t in texts for m, f in zip(*_graph(t)[:2], strict=True)}
    counts |= {("skip", 3, 3): 40, ("chain", 0, 0): 40, ("chain", 4, 4): 9}
    model = pii_crf.Model(counts)
    together = pii_crf.Graph()
    for text in texts * 3:
        together.add(text, pii_crf.base_spans(text))
    whole = model.posteriors(together)
    for k, text in enumerate(texts * 3):
        alone = pii_crf.Graph()
        alone.add(text, pii_crf.base_spans(text))
        first = together.first[k]
        assert (model.posteriors(alone) == whole[first : first + len(alone.masks)]).all()


def _graph(text):
    graph = pii_crf.Graph()
    graph.add(text, pii_crf.base_spans(text))
    return graph.masks, graph.fixed, graph


def test_budgets_of_any_size():
    begin = time.monotonic()
    even = list(range(2, 4001, 2))
    for lengths, counts, budget in (
        (even, [250] * 2000, 500_000_001),
        (even, [250] * 2000, 500_000_000),
        (list(range(301, 20_000, 7)), [300] * 2815, 10**9 + 7),
        ([6, 10, 15], [10**6] * 3, 10**7 + 1),
        ([1_000_000, 999_983], [400, 400], 123_456_789),
    ):
        taken = mixing.fit_nearest(lengths, counts, budget)
        assert all(0 <= t <= n for t, n in zip(taken, counts, strict=True))
        off = abs(sum(a * b for a, b in zip(lengths, taken, strict=True)) - budget)
        assert off == mixing.least_off(lengths, counts, budget) or len(lengths) == 2 and off < 500_000
    assert time.monotonic() - begin < 60


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 6)), min_size=1, max_size=7, unique_by=lambda x: x[0]), st.data())
@settings(max_examples=100, deadline=None)
def test_exchange_is_as_near_as_can_be(parts, data):
    lengths, counts = map(list, zip(*parts, strict=True))
    budget = data.draw(st.integers(1, sum(a * b for a, b in parts) + 30))
    sums = {0}
    for length, n in parts:
        sums = {s + length * k for s in sums for k in range(n + 1)}
    taken = mixing.exchanged(lengths, counts, budget)
    assert all(0 <= t <= n for t, n in zip(taken, counts, strict=True))
    assert abs(sum(a * b for a, b in zip(lengths, taken, strict=True)) - budget) == min(abs(s - budget) for s in sums)


def test_tries_branch_and_spill(spark):
    trie = exact_dedup.OwnerTrie(lambda a, b: a + b, 30_000)
    rng = random.Random(1)
    texts = [sentence(rng, 20).encode() for _ in range(300)]
    for text in texts * 2:
        trie.insert(text, 1)
    assert any(node.spilled for _, node in exact_dedup._below(trie.root)) and trie.forks() > 0
    assert sorted(trie.items()) == sorted((t, 2) for t in texts)
    wide = exact_dedup.OwnerTrie(lambda a, b: a + b)
    for text in texts:
        wide.insert(text, 1)
    assert wide.forks() > 50


def test_a_text_that_many_tasks_have(spark):
    texts = ["hot text"] * 90 + [f"own {k}" for k in range(30)] + ["HOT text"] * 6
    want = sorted(map(tuple, exact_dedup.owners(table(spark, texts)).collect()))
    # A row to a task: the salted round merges what more than four of them send.
    found = exact_dedup.owners(table(spark, texts).repartition(96), many=4, memory=2000)
    assert sorted(map(tuple, found.collect())) == want
    assert {r[2] for r in want} == {1, 96}


def test_counts_are_asked_for_before_texts_move(spark, tmp_path):
    docs = table(spark, ["a b", "a b", None, "c"])
    cache = str(tmp_path / "cache")
    first = sorted(token_counts.count_tokens(docs, PIECES, cache=cache).collect())
    files = spark.read.parquet(cache).inputFiles()
    assert sorted(token_counts.count_tokens(docs, PIECES, cache=cache).collect()) == first
    # Every count was stored: nothing was encoded, nothing appended but the empty opening.
    assert spark.read.parquet(cache).count() == 3 and len(spark.read.parquet(cache).inputFiles()) <= len(files) + 1


def test_candidates_are_found_as_promised():
    for recall in (0.999, 0.99995, 0.999999):
        runs, least = jaccard_join.runs_and_tokens(0.8, recall)
        rng = np.random.default_rng(3)
        together = 0.8 * (1 - 0.2**jaccard_join.WIDTH) ** (jaccard_join.DEPTH - 1)
        missed = (1 - together) ** runs + (rng.binomial(64, 0.8, 400_000) < least).mean()
        assert missed <= (1 - recall) + 5e-5 and least > 30


def test_lists_over_a_long_time(spark):
    rng = random.Random(9)
    hosts = ["a.b.com", "b.com", "x.b.com", "c.org", "www.c.org", "d.net"]
    start = 1_600_000_000
    entries = [(rng.choice(hosts), rng.choice(["block", "allow", "remove"]), start + rng.randrange(10**8) * rng.choice([1, 3]), k) for k in range(300)]
    captures = [(k, f"http://{rng.choice(hosts)}/p", start + rng.randrange(3 * 10**8)) for k in range(300)]
    captures += [(1000 + k, f"http://{e[0]}/q", e[2]) for k, e in enumerate(entries)]  # at the moment of a change
    left = spark.createDataFrame(captures, "page_id long, url string, s long").selectExpr("page_id", "url", "timestamp_seconds(s) AS fetched_at")
    right = spark.createDataFrame(entries, "entry string, action string, s long, seq long").selectExpr("entry", "action", "timestamp_seconds(s) AS at", "seq")
    last = {}
    for entry, action, at, seq in entries:
        last.setdefault(entry, {})[at] = max(last.get(entry, {}).get(at, (-1, "")), (seq, action))
    for r in url_lists.judge_captures(left, right).collect():
        at, labels, best = int(r.fetched_at.timestamp()), r.host.split("."), None
        for k in range(max(1, len(labels) - 1)):
            known = {t: c for t, c in last.get(".".join(labels[k:]), {}).items() if t <= at}
            if known and known[max(known)][1] != "remove":
                best = ".".join(labels[k:]), known[max(known)][1]
                break
        assert (r.entry, r.action) == (best or (None, None)) and r.kept == (best is None or best[1] != "block")
    assert url_lists.judge_captures(left.limit(0), right).count() == 0
