"""Registered queries against SQL, and the pipeline's stages, on the smallest data."""

import os

import corpus_pipeline
import duckdb
import pytest

from folioloom.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = QUERIES[name](spark, DATA).toPandas()
    want = con.execute(ORACLES[name]).fetchdf()[list(got.columns)]
    assert sorted(map(str, got.astype(object).values.tolist())) == sorted(map(str, want.astype(object).values.tolist()))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[k] = docs.count()
        if k < 4:
            assert docs.columns == columns
    assert kept[0] < spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert kept[1] == kept[0] > kept[2]
    pieces = corpus_pipeline.run(spark, DATA)
    assert pieces.columns == docs.columns and pieces.count() == kept[4]
    assert docs.select("sequence_id", "offset").distinct().count() == kept[4]


def documents(spark, rows):
    rows = [(i, text, "en", source, len(text)) for i, text, source in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_rows_with_no_or_equal_ids(spark):
    words = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcde"]
    # Two rows without id, two texts of one id, one of them a near copy of a smaller id's.
    rows = [(None, words[0], "s"), (None, words[1], "s"), (2, words[2], "s"), (5, words[2] + " x", "s"), (5, words[3], "s")]
    rows += [(None, words[3], "s"), (7, words[4], "s"), (7, words[4], "s"), (None, " ", "s"), (None, " ", "s")]
    kept = corpus_pipeline.jaccard_join(spark, documents(spark, rows), DATA).collect()
    want = [(None, words[0]), (None, words[1]), (2, words[2]), (5, words[3]), (7, words[4]), (None, " "), (None, " ")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, want))


def test_mix_of_rows_with_no_or_equal_ids(spark):
    text = " ".join(["a"] * 10)
    rows = [(None, text, "s"), (1, text, "s"), (1, text, "s"), (1, text + " b b", "s")]
    # One source: its target is its size, every row once.
    mixed = corpus_pipeline.mixing(spark, documents(spark, rows), DATA).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in mixed))) == sorted(str(r[:2]) for r in rows)


def test_stages_of_empty_tables_and_clashing_columns(spark, tmp_path):
    for name, rows in (("empty", []), ("nulls", [(None, None, None)] * 2)):
        docs = documents(spark, []) if not rows else spark.createDataFrame([(None,) * 5] * 2, documents(spark, []).schema)
        for column in ("copies", "_row", "size", "key", "n", "copy", "class_id", "_text"):
            docs = docs.selectExpr("*", f"'x' AS `{column}`")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{k}")
            stage(spark, docs, DATA).write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.count() == 0, (name, k)  # rows without words fail the quality rules
            if k < 4:
                assert docs.columns == corpus_pipeline.COLUMNS
    text = " ".join(f"w{k}" for k in range(80))
    extra = documents(spark, [(1, text, "s"), (2, text, "s")]).selectExpr("*", "'x' AS copies", "'y' AS _row", "0 AS size")
    kept = corpus_pipeline.jaccard_join(spark, extra, DATA)
    assert kept.columns == corpus_pipeline.COLUMNS and [r.doc_id for r in kept.collect()] == [1]
    mixed = corpus_pipeline.mixing(spark, extra, DATA)
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.count() == 2
