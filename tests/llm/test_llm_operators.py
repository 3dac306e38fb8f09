"""Operators on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import zlib

import llm_models as models
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioloom.llm import (
    exact_dedup,
    jaccard_join,
    line_dedup,
    mixing,
    packing,
    pii_crf,
    quality_rules,
    suffix_dedup,
    token_counts,
    url_lists,
)
from folioloom.llm.components import components

SCHEMA = "doc_id long, text string, source string, kept string, n_words string, key string, size string, n string"
MODEL = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def table(spark, texts, sources=None, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or [f"s{k % 4}" for k in range(len(texts))]
    return spark.createDataFrame([(i, t, s, *["x"] * 5) for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    long = sentence(rng, 9000)
    passage = sentence(rng, 80)
    body = [sentence(rng, rng.randint(1, 200)) for _ in range(30)]
    body += [body[3], body[3], body[3].upper(), body[4] + " more", f"{body[5]} {passage}", f"{passage} {body[6]}"]
    body += ["", None, " \t\n", long, long, long + " end", "a b", "a b", "one\ntwo\none\n\n two ", "a " * 400]
    body += ["call +1 (743) 555-3824 or a.b@c.de.", "4465758382889437 4465758382889437 at 10.0.0.300, 10.0.0.30"]
    return body


def test_exact_copies(spark, texts):
    for keep, pick in (("smallest", min), ("largest", max)):
        rows = exact_dedup.owners(table(spark, texts).repartition(3), keep=keep).collect()
        groups = {}
        fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        for i, t in enumerate(texts):
            groups.setdefault((t or "").translate(fold), []).append(i)
        want = {i: (pick(g), len(g), i == pick(g)) for g in groups.values() for i in g}
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows} == want and len(rows) == len(texts)
    weak = exact_dedup.owners(table(spark, texts), hash_bits=0, memory=20_000).collect()
    assert sorted(weak) == sorted(exact_dedup.owners(table(spark, texts)).collect())


def test_exact_copies_without_or_with_equal_ids(spark):
    rows = exact_dedup.owners(table(spark, ["x", "x", "x", "y", "z", "z"], ids=[7, 7, None, None, None, None])).collect()
    assert sorted(r.group_size for r in rows) == [1, 2, 2, 3, 3, 3]
    assert sum(r.kept for r in rows) == 3
    assert {r.keep_id for r in rows if r.group_size == 3} == {7}


@given(st.lists(st.binary(max_size=12), max_size=60), st.integers(300, 4000))
@settings(max_examples=80, deadline=None)
def test_trie_equals_dict(keys, limit):
    trie, want = exact_dedup.OwnerTrie(lambda a, b: a + b, limit), {}
    for key in keys:
        trie.insert(key, 1)
        want[key] = want.get(key, 0) + 1
    found = {}
    for key, n in trie.items():
        assert key not in found
        found[key] = n
    assert found == want


def test_token_counts(spark, texts, tmp_path):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    cache = str(tmp_path / "cache")
    processor = SentencePieceProcessor(model_file=PIECES)
    for _ in range(2):  # the second time from the cache
        rows = token_counts.count_tokens(table(spark, texts), PIECES, 100, cache).collect()
        want = {i: (len((t or "").encode()), len(processor.encode(t or ""))) for i, t in enumerate(texts)}
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in rows)
        stored = token_counts.stored_counts(spark, cache, token_counts.tokenizer_version(PIECES))
        assert spark.read.parquet(cache).count() == stored.count() == len({t or "" for t in texts})
    rows = token_counts.count_tokens(table(spark, texts), MODEL, 100, cache).collect()
    tokenizer = Tokenizer.from_file(MODEL)
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r.n_tokens for r in sorted(rows)] == want


def test_quality_measures(spark, texts):
    rows = quality_rules.judged(table(spark, texts)).collect()
    for r in rows:
        want = models.quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert len(rows) == len(texts)
    good = quality_rules.good_documents(table(spark, texts))
    assert good.columns == table(spark, texts).columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in rows if r.kept}


@given(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=40))
@settings(max_examples=8, deadline=None)
def test_repeated_words(spark, words):
    text = " ".join(words)
    row = quality_rules.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_repeat_words == models.quality(text)[4]


def test_lines(spark):
    texts = [f"menu\nown {k}\n menu " for k in range(9)] + ["menu", None, "", "rare\nother", "rare\nmenu"]
    sources = ["a"] * 9 + ["a", "a", "a", "b", None]
    rows = {r.doc_id: r for r in line_dedup.clean_lines(table(spark, texts, sources), "source", 0.5, 3).collect()}
    assert rows[0].text == "own 0" and (rows[0].n_lines, rows[0].n_removed) == (3, 2)
    assert rows[9].text == "" and rows[10].text is None and rows[11].text == ""
    assert rows[12].text == texts[12] and rows[13].text == texts[13]
    assert rows[0].kept == "x" and rows[0].key == "x"


def test_lines_of_copies(spark):
    texts = ["one\ntwo"] * 5 + [f"menu\nown {k}" for k in range(10)]
    docs = table(spark, texts, ["a"] * 15)
    rows = {r.doc_id: r.text for r in line_dedup.clean_lines(docs, "source", copies=False).collect()}
    assert [rows[k] for k in range(15)] == ["one\ntwo"] * 5 + [f"own {k}" for k in range(10)]


def test_lists(spark):
    day = "2024-01-%02d %02d:00:00"
    entries = [
        ("b.com", "block", day % (2, 0), 1),
        ("b.com", "remove", day % (5, 0), 2),
        ("a.b.com", "allow", day % (3, 0), 3),
        ("a.b.com", "block", day % (3, 0), 4),  # same time, later number
        ("a.b.com", "allow", day % (4, 12), 5),
        (None, "block", day % (1, 0), 6),
        ("c.org", "other", day % (1, 0), 7),
    ]
    captures = [
        (1, "http://a.b.com/x", day % (1, 0)),
        (2, "http://u@A.B.com:80/x", day % (2, 0)),
        (3, "http://a.b.com/x", day % (3, 1)),
        (4, "http://a.b.com/x", day % (4, 12)),
        (5, "https://z.b.com", day % (4, 23)),
        (6, "https://z.b.com", day % (5, 0)),
        (7, None, day % (4, 0)),
        (8, "no host", day % (4, 0)),
        (9, "http://b.com", None),
        (9, "http://b.com", day % (4, 0)),
        (9, "http://b.com", day % (4, 0)),
        (10, "http://c.org", day % (4, 0)),
        (11, "http://com", day % (4, 0)),
    ]
    left = spark.createDataFrame(captures, "page_id long, url string, at string").selectExpr(
        "page_id", "url", "CAST(at AS timestamp) AS fetched_at", "'x' AS entry"
    )
    right = spark.createDataFrame(entries, "entry string, action string, t string, seq long").selectExpr(
        "entry", "action", "CAST(t AS timestamp) AS at", "seq"
    )
    rows = sorted((r.page_id, r.entry or "", r.kept) for r in url_lists.judge_captures(left, right).collect())
    assert rows == [
        (1, "", True),
        (2, "b.com", False),
        (3, "a.b.com", False),
        (4, "a.b.com", True),
        (5, "b.com", False),
        (6, "", True),
        (7, "", True),
        (8, "", True),
        (9, "", True),
        (9, "b.com", False),
        (9, "b.com", False),
        (10, "", True),
        (11, "", True),
    ]
    assert url_lists.judge_captures(left, right.limit(0)).where("kept").count() == len(captures)


def test_pii(spark, texts):
    odd = ["x@y", "+1" * 40, "1" * 5000, "a@b.c@d.e", "999.1.1.1 0255.0.0.1", "4465 7583 8288 9437", "é +49 30 1234567 é"]
    every = texts + odd
    for r in pii_crf.find_pii(table(spark, every)).collect():
        counts, digest, listed = models.pii(every[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == digest
        assert set(listed.split(",")) <= set(r.spans.split(","))


def test_field_makes_labels_agree():
    graph = pii_crf.Graph()
    text = "card 4465758382889437 4465758382889437 then 4465758382889437. and 17 cats, 4465758382889437x"
    graph.add(text, pii_crf.base_spans(text))
    counts = {("word", m, f): 5 for m, f in zip(graph.masks, graph.fixed, strict=True)}
    counts |= {("word", graph.masks[2], 3): 200, ("skip", 3, 3): 40, ("chain", 0, 0): 40, ("skip", 0, 0): 5}
    spans = pii_crf.added_spans(graph, pii_crf.Model(counts).posteriors(graph), 0, len(graph.masks))
    assert [(a, k) for a, k, _ in spans] == [(5, 2), (22, 2)]


def test_near_copies(spark, texts):
    rng = random.Random(9)
    words = sentence(rng, 120).split()
    for k in range(25):
        own = words[:]
        own[(7 * k) % 100] = f"w{k % 11}"
        texts = [*texts, " ".join(own)]
    docs = dict(enumerate(texts))
    want = models.near(docs)
    for small in (jaccard_join.SMALL, 3):
        rows = jaccard_join.join_near(table(spark, texts).repartition(3), small_bucket=small).collect()
        assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == want and len(rows) == len(texts)
    nulls = jaccard_join.join_near(table(spark, ["a b", "a b", None, ""], ids=[None, 4, 4, None])).collect()
    assert sorted((r.n_copies, r.n_links, r.class_id or -1) for r in nulls) == [(1, 0, -1), (1, 0, 4), (2, 1, 4), (2, 1, 4)]


def test_blocks_of_a_large_group(spark, monkeypatch):
    rng = random.Random(2)
    words = sentence(rng, 100).split()
    texts = []
    for k in range(30):
        own = words[:]
        own[k * 3] = "changed"
        texts.append(" ".join(own))
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = jaccard_join.join_near(table(spark, texts)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == models.near(dict(enumerate(texts)))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in found} == {x: find(x) for x in top if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_passages(spark, texts):
    want = models.repeats(dict(enumerate(texts)))
    rows = suffix_dedup.repeated_passages(table(spark, texts)).collect()
    found = {}
    for r in rows:
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",")]
        found[r.doc_id] = {k for a, b in spans for k in range(a, b)}
        assert r.n_repeated_words == len(found[r.doc_id]) and r.n_spans == len(spans)
    assert found == dict(want)
    twice = table(spark, [texts[0] + " x" * 60] * 2, ids=[1, 1])
    assert [r.n_spans for r in suffix_dedup.repeated_passages(twice).collect()] == [1, 1]


def test_passages_around_a_frequent_run(spark):
    # Twenty pairs share 15 words before a run of 40, which 600 texts end differently after.
    rng = random.Random(11)
    licence, texts = sentence(rng, 40), []
    for k in range(300):
        own = sentence(rng, 15)
        for _ in range(2):
            if k >= 20:
                own = sentence(rng, 15)
            texts.append(f"{sentence(rng, rng.randint(3, 40))} {own} {licence} {sentence(rng, rng.randint(3, 40))}")
    found = {}
    for r in suffix_dedup.repeated_passages(table(spark, texts)).collect():
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",")]
        found[r.doc_id] = {k for a, b in spans for k in range(a, b)}
    assert len(found) == 40 and found == dict(models.repeats(dict(enumerate(texts))))


def test_mixing(spark, texts):
    sources = [None if k % 7 == 0 else f"s{k % 5}" for k in range(len(texts))]
    rows = mixing.mix(table(spark, texts, sources)).collect()
    sizes = {}
    for t, s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len(models.WORDS.findall(t or ""))
    want, taken = models.targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.size == len(models.WORDS.findall(texts[r.doc_id] or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(rows) == len(texts)
    # One source is a single long document for the most part: its small ones, three times.
    assert all(abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]) for s in sizes if s != "s0"), (taken, want)
    assert taken["s0"] == 3 * (sizes["s0"] - 9000)
    assert sorted(rows, key=str) == sorted(mixing.mix(table(spark, texts, sources).repartition(5)).collect(), key=str)


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 5)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.data())
@settings(max_examples=60, deadline=None)
def test_budget_is_fitted(parts, data):
    lengths, counts = map(list, zip(*parts, strict=True))
    budget = data.draw(st.integers(0, sum(a * b for a, b in parts)))
    taken = mixing.fill(lengths, counts, budget)
    sums = {0}
    for length, n in parts:
        sums = {s + length * k for s in sums for k in range(n + 1)}
    assert sum(a * b for a, b in zip(lengths, taken, strict=True)) == max(s for s in sums if s <= budget)
    fitted = mixing.fit_budget(lengths, counts, budget)
    assert all(0 <= t <= n for t, n in zip(fitted, counts, strict=True))
    assert sum(a * b for a, b in zip(lengths, fitted, strict=True)) <= budget


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.data())
@settings(max_examples=60, deadline=None)
def test_nearest_sum(parts, data):
    lengths, counts = map(list, zip(*parts, strict=True))
    budget = data.draw(st.integers(1, sum(a * b for a, b in parts)))
    sums = {0}
    for length, n in parts:
        sums = {s + length * k for s in sums for k in range(n + 1)}
    for fit in (mixing.nearest, mixing.fit_nearest):
        taken = fit(lengths, counts, budget)
        assert all(0 <= t <= n for t, n in zip(taken, counts, strict=True))
        assert abs(sum(a * b for a, b in zip(lengths, taken, strict=True)) - budget) == min(abs(s - budget) for s in sums)


def test_long_documents_and_sums_above(spark):
    assert mixing.fit_nearest([24_000, 26_000], [2, 2], 48_000) == [2, 0]
    assert mixing.fit_nearest([1000], [1], 999) == [1] and mixing.fit_nearest([1000], [1], 900, 2) == [1]
    rows = mixing.mix(table(spark, ["a " * 1000, "b " * 1990], ["x", "y"])).collect()
    # The target of x is 997 words.
    assert {r.source: r.copies for r in rows} == {"x": 1, "y": 1}


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(MODEL)
    every = [*texts, "<|endoftext|> it's İ é \x1c日本 १"]
    rows = packing.pack(table(spark, every), MODEL, capacity=64, with_ids=True).collect()
    docs, sequences = {}, {}
    for r in sorted(rows):
        assert r.start == len(docs.setdefault(r.doc_id, [])) and r.length == len(r.ids) <= 64
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        docs[r.doc_id] += r.ids
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(every):
        assert docs[i] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
@settings(max_examples=80, deadline=None)
def test_plan_uses_every_piece(counts):
    used = {}
    patterns = packing.plan(counts, 40)
    for parts, times in patterns:
        assert sum(parts) <= 40 and times > 0
        for length in parts:
            used[length] = used.get(length, 0) + times
    assert used == counts


@pytest.mark.parametrize(
    "apply",
    [
        lambda d: exact_dedup.owners(d),
        lambda d: token_counts.count_tokens(d, PIECES),
        lambda d: quality_rules.judged(d),
        lambda d: line_dedup.clean_lines(d),
        lambda d: pii_crf.find_pii(d),
        lambda d: jaccard_join.join_near(d),
        lambda d: suffix_dedup.repeated_passages(d),
        lambda d: mixing.mix(d),
        lambda d: packing.pack(d, MODEL),
    ],
)
def test_empty_tables(spark, apply):
    assert apply(spark.createDataFrame([], SCHEMA)).count() == 0
    # One row of nulls is a row like any other.
    assert apply(spark.createDataFrame([(None,) * 8], SCHEMA)).count() in (0, 1)
