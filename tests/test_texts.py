"""Chunks against SQL, terms and annotation against plain Python models."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from folioloom.functions.blocks import glossary_block
from folioloom.operators import chunking, quality, terms
from folioloom.plans.catalog import ORACLES, QUERIES
from models import model_annotate, model_relevant, model_stats

GLOSSARY = "term string, target string, category string, notes string, ordinal long"


def random_text(rng):
    def sentence():
        length = rng.choice([0, 1, 10, 60, 200, 700, 1300])
        return "".join(rng.choice("abcdefgh ") for _ in range(length)) + rng.choice([".", "!", "?", "", "!?"])

    def paragraph():
        body = "".join(sentence() for _ in range(rng.choice([0, 1, 1, 2, 4, 9])))
        return body + (rng.choice(['"', "que", "nicht"]) if rng.random() < 0.45 else "")

    return "\n".join(paragraph() for _ in range(rng.randint(1, 14)))


@pytest.mark.parametrize("partitions", [1, 5])
def test_chunks_of_random_texts_equal_sql(spark, tmp_path, partitions):
    rng = random.Random(7)
    texts = [random_text(rng) for _ in range(300)] + ["", "\n", "x" * 5000, '"' * 1300 + "\n" + "a" * 300, "\n\n."]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    docs.repartition(partitions).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("greedy_chunks", "dialogue_islands", "chunk_context"):
        got = QUERIES[name](spark, str(tmp_path))
        expected = con.execute(ORACLES[name]).to_arrow_table().to_pylist()
        key = lambda r: str(sorted(r.items()))
        assert sorted((r.asDict() for r in got.collect()), key=key) == sorted(expected, key=key), name


def test_long_paragraphs_are_cut_in_one_pass(spark):
    sentence, n = "é" * 19 + ".", 100_000
    wide = "𝄞" * 2500
    docs = spark.createDataFrame([(1, sentence * n), (2, wide + "é.")], "doc_id long, text string")
    begin = time.perf_counter()
    rows = chunking.chunk_documents(docs, size=1000, separator="\n", sentence_ends=".").collect()
    # Counting characters from the beginning for each of 100,000 sentences took minutes.
    assert time.perf_counter() - begin < 30
    texts = {i: [r.main_text for r in sorted(rows, key=lambda r: r.chunk_idx) if r.doc_id == i] for i in (1, 2)}
    # The end mark leaves an empty sentence, which fits the last chunk.
    assert texts[1] == ["\n".join([sentence] * 50)] * (n // 50 - 1) + ["\n".join([sentence] * 50 + [""])]
    assert texts[2] == ["𝄞" * 1000, "𝄞" * 1000, "𝄞" * 500 + "é.", ""]


def test_chunk_examples(spark):
    long = "\n\n".join(["这是一个很长的段落。" * 50] * 5)
    three = "第一段。\n\n第二段。\n\n第三段。"
    docs = spark.createDataFrame([(1, "短"), (2, three), (3, long), (4, "")], "doc_id long, text string")
    rows = chunking.chunk_documents(docs, size=500).collect()
    by_doc = {i: [r.main_text for r in rows if r.doc_id == i] for i in (1, 2, 3, 4)}
    assert by_doc[1] == ["短"] and by_doc[2] == [three] and by_doc[4] == [""]
    assert len(by_doc[3]) > 1 and all(len(c) < 1000 for c in by_doc[3])
    assert "".join(by_doc[3]).replace("\n", "") == long.replace("\n", "")


def test_dialogue_blocks(spark):
    text = "\n\n".join(["旁白", '"一"', "短", '"二"', "长" * 120, '"三"', "短", "短"])
    rows = chunking.dialogue_islands(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.first_para, r.last_para, r.n_chars) for r in rows] == [(1, 3, 11), (5, 5, 3)]


ENTRIES = [
    ("王林", "Vương Lâm", "character", "chính", 0),
    ("王", "Vương", "general", None, 1),
    ("林", "Lâm", "misc", None, 2),
    ("an", "an", "realm", "", 3),
    ("ana", "ANA", "item", None, 4),
    ("无此", "không", "item", None, 5),
    ("a.b", "chấm", "item", None, 6),
]


def term_texts(rng, n=150):
    pieces = ["王林", "王", "林", " ", "，", "an", "ana", "x", "a.b", "axb", "<", "。"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("small", [True, False])
def test_terms_equal_model(spark, small):
    texts = term_texts(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    glossary = spark.createDataFrame(ENTRIES, GLOSSARY)
    idf, df = model_stats(texts, [e[0] for e in ENTRIES])
    fitted = terms.fit_terms(docs, glossary, "doc_id", small=small)
    stats = {r.term: (r.df, r.idf, r.n_docs) for r in fitted.collect()}
    assert {t: s[0] for t, s in stats.items()} == df
    assert all(abs(stats[t][1] - idf[t]) < 1e-12 and stats[t][2] == len(texts) for t in idf)
    matched = terms.term_match(docs, glossary, ["doc_id"], "text", small)
    got = sorted((r.doc_id, r.term, r.tf) for r in matched.collect())
    assert got == sorted((i, e[0], t.count(e[0])) for i, t in enumerate(texts) for e in ENTRIES if e[0] in t)
    ranked = terms.relevant_terms(docs, fitted, 3, "text", key=["doc_id"], small=small).collect()
    assert len(ranked) == len(texts)
    for r in ranked:
        assert [t.term for t in r.terms] == [e[0] for e in model_relevant(texts[r.doc_id], ENTRIES, idf, df, 3)]


def test_annotation_equals_model(spark):
    texts = term_texts(random.Random(5)) + ["王林 " * 9, "王林王林", "an-an an\nana"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted = terms.fit_terms(docs, spark.createDataFrame(ENTRIES, GLOSSARY), "doc_id")
    idf, df = model_stats(texts, [e[0] for e in ENTRIES])
    for r in terms.annotate_chunks(docs, fitted, 4, "text", key=["doc_id"]).collect():
        chosen = model_relevant(texts[r.doc_id], ENTRIES, idf, df, 4)
        assert r.annotated == model_annotate(texts[r.doc_id], chosen), texts[r.doc_id]


def test_glossary_block(spark):
    docs = spark.createDataFrame([(1, "王林 an 林"), (2, "x")], "doc_id long, text string")
    ranked = terms.relevant_terms(docs, spark.createDataFrame(ENTRIES, GLOSSARY), 10, "text", key=["doc_id"])
    got = {r.doc_id: r.b for r in ranked.select("doc_id", glossary_block(F.col("terms")).alias("b")).collect()}
    assert got[1] == (
        "### Nhân vật\n- 王林 → Vương Lâm (chính)\n\n### Cảnh giới\n- an → an\n\n### Thuật ngữ chung\n- 王 → Vương\n"
    )
    assert got[2] == ""


def test_title_mismatch_keeps_the_rest(spark):
    key = "book_id string, index long"
    chapters = spark.createDataFrame([("b", 1622, "第1664章 灾难级"), ("b", 2, "第2章")], f"{key}, title_cn string")
    texts = spark.createDataFrame(
        [("b", 1622, "Chương 1622: Cấp Tai Họa\n\nContent line 1\nContent line 2\n"), ("b", 2, "Chương 2: x")],
        f"{key}, text string",
    )
    fixed_rows = quality.title_mismatches(chapters, texts, ["book_id", "index"]).collect()
    assert [r.text for r in fixed_rows] == ["Chương 1664: Cấp Tai Họa\n\nContent line 1\nContent line 2\n"]
    assert "text" not in quality.title_mismatches(chapters, texts, ["book_id", "index"], dry_run=True).columns


def test_leaks_and_flags(spark):
    docs = spark.createDataFrame([(1, "anh and em or And"), (2, "The end"), (3, "sạch")], "doc_id long, text string")
    leaks = {(r.doc_id, r.word): (r.n, r.replacement) for r in quality.leak_report(docs, "doc_id").collect()}
    assert leaks == {(1, "and"): (1, "và"), (1, "or"): (1, "hoặc"), (1, "And"): (1, "Và")}
    flags = {r.doc_id: (r.n_replaced, r.n_the, r.flagged) for r in quality.flag_report(docs, "doc_id").collect()}
    assert flags == {1: (3, 0, True), 2: (0, 1, True), 3: (0, 0, False)}
    dry = quality.sanitize(docs, dry_run=True).orderBy("doc_id").collect()
    assert [(r.text, r.modified) for r in dry][:2] == [("anh and em or And", True), ("The end", False)]


def test_own_scorer_and_size_guard(spark):
    docs = spark.createDataFrame([(1, "王林 an 林")], "doc_id long, text string")
    glossary = spark.createDataFrame(ENTRIES, GLOSSARY)

    def by_length(entry, tf):
        return F.length(entry["term"])

    @F.udf("long")
    def length(term):
        return len(term)

    for small in (True, False):
        for scorer in (by_length, lambda e, tf: length(e["term"])):
            got = terms.relevant_terms(docs, glossary, 2, "text", key=["doc_id"], small=small, scorer=scorer).first()
            assert [t.term for t in got.terms] == ["王林", "an"]
    wide = spark.range(300).select(
        F.concat(F.lit("x"), F.col("id")).alias("term"), F.lit("t").alias("target"), F.lit("item").alias("category"),
        F.lit("").alias("notes"), (F.col("id") + 100).alias("ordinal"),
    )
    got = terms.relevant_terms(docs, glossary.select(wide.columns).union(wide), 2, "text", key=["doc_id"], scorer=by_length).first()
    assert [t.term for t in got.terms] == ["王林", "an"]
    many = spark.range(300).select(F.col("id").cast("string").alias("term"), F.col("id").alias("ordinal"))
    assert not terms.is_small(many)
    with pytest.raises(Exception, match="glossary rows"):
        terms.term_match(docs, many, ["doc_id"], "text", small=True).collect()


def test_listed_sequences_are_counted_like_python(spark, monkeypatch):
    import numpy as np

    from folioloom.functions import sequences

    draw = random.Random(5)
    # Stretches that share a hash are told apart by their characters.
    monkeypatch.setattr(sequences.Points, "hashes", lambda self, n, at=None: np.zeros(
        len(at) if at is not None else max(0, len(self.codes) - n + 1), np.uint64))
    for alphabet in ("ab", "aé中😀"):
        word = lambda n: "".join(draw.choice(alphabet) for _ in range(n))
        texts = [word(n) for n in (0, 1, 5, 40, 0, 300)]
        listed = {word(n) for n in range(1, 13)}
        places, lengths = sequences.places_of(sorted(listed))
        table = np.zeros(sequences.PLACES, bool)
        table[places] = True
        rows = [x for part in sequences.count_listed(texts, table, sorted(lengths)) for x in zip(*part)]
        assert len(rows) == len({(i, t) for i, t, _ in rows})
        assert {(i, t): n for i, t, n in rows if t in listed} == {
            (i, t): text.count(t) for i, text in enumerate(texts) for t in listed if t in text
        }


@pytest.mark.parametrize("collide", [True, False])
def test_texts_that_have_a_sequence_are_counted_like_python(monkeypatch, collide):
    import numpy as np

    from folioloom.functions import sequences

    draw = random.Random(6)
    if collide:
        monkeypatch.setattr(sequences.Points, "hashes", lambda self, n, at=None: np.zeros(
            len(at) if at is not None else max(0, len(self.codes) - n + 1), np.uint64))
    for alphabet in ("ab", "aé中😀"):
        word = lambda n: "".join(draw.choice(alphabet) for _ in range(n))
        texts = [word(n) for n in (0, 1, 5, 40, 0, 300, 40)]
        listed = {word(n) for n in range(1, 13)}
        places, lengths = sequences.places_of(sorted(listed))
        table = np.zeros(sequences.PLACES, bool)
        table[places] = True
        rows = [x for part in sequences.count_texts(texts, table, sorted(lengths)) for x in zip(*part)]
        assert len(rows) == len({t for t, _ in rows})
        assert {t: n for t, n in rows if t in listed} == {
            t: n for t in listed if (n := sum(t in text for text in texts))
        }


def test_no_text_is_searched_once_for_each_of_its_terms(spark):
    texts = [(1, "xaxaxa é中é中é " + "longer words " * 3), (2, ""), (3, None), (4, "aaaaa")]
    listed = ["a", "aa", "axa", "é中é", "longer words longer", "absent", ""]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    glossary = spark.createDataFrame([(t,) for t in listed], "term string")
    found = terms.term_match(docs, glossary, ["doc_id"], "text")
    assert sorted(map(tuple, found.collect())) == sorted(
        (i, t, text.count(t)) for i, text in texts if text for t in listed if t and t in text
    )
    # The text has no place beside its matches: what is joined is terms, counts and keys.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(" not in plan.lower() and plan.count("Join") == 1


def test_few_sequences_but_terms_leave_a_task():
    import numpy as np

    from folioloom.functions import sequences

    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(6, 14))) for _ in range(60_000)]
    places, lengths = sequences.places_of(words)
    table = np.zeros(sequences.PLACES, bool)
    table[places] = True
    # Beginnings of terms stand before other ends, at every length that a term has.
    texts = ["".join(draw.sample(words, 40)) for _ in range(200)]
    found = [t for part in sequences.count_texts(texts, table, sorted(lengths)) for t in part[0]]
    assert len(set(found) - set(words)) < len(found) / 100
