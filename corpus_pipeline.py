"""A corpus from raw documents to packed sequences, in stages.

Every stage takes the whole table its predecessor wrote and returns one; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import WORD, settle, whole_text
from folioloom.llm.jaccard_join import join_near
from folioloom.llm.line_dedup import clean_lines
from folioloom.llm.mixing import mix
from folioloom.llm.packing import pack
from folioloom.llm.quality_rules import good_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def row_key() -> Column:
    """A row's key of 128 bits, from all its columns with their nulls: only the very same rows
    share one."""
    parts = [part for c in COLUMNS for part in (F.col(c).isNull(), F.col(c))]
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in (1, 2)]
    return F.unhex(F.concat(*halves))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return good_documents(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source.

    Copies of a text count as one page: they only go in the next stage."""
    cleaned = clean_lines(docs.select(*COLUMNS), "source", copies=False)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of similar documents the one with the smallest id, an id before none;
    rows without words are all kept."""
    keyed = docs.select(*COLUMNS, row_key().alias("_row"))
    has_words = whole_text().rlike(WORD)
    worded = keyed.where(has_words)
    found = join_near(worded.select(F.col("_row").alias("doc_id"), "text"))
    classes = found.select(F.col("doc_id").alias("_row"), "class_id").distinct()
    ids = worded.select("_row", "doc_id").distinct().join(classes, "_row")
    first = ids.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    firsts = settle(first.select("first._row"), "firsts")
    kept = worded.join(firsts, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.unionByName(keyed.where(~has_words)).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them."""
    keyed = docs.select(*COLUMNS, row_key().alias("_row"))
    copies = mix(keyed, carried=("_row",)).groupBy("_row").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    taken = keyed.join(settle(copies.where(F.col("copies") > 0), "copies"), "_row")
    # The copies of rows that are the same come from one of them.
    taken = taken.where(F.col("n") == 1).union(taken.where(F.col("n") > 1).dropDuplicates(["_row"]))
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL expresses neither the choice of documents by length nor tokens nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
