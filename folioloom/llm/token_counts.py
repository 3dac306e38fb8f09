"""Token counts with a digest cache.

Counts are stored under the digest of the content and the version digest of the tokenizer.
Documents look their digest up; only distinct texts without a stored count are encoded, and
their counts are appended to the cache, from which all documents are then answered.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import in_worker, settle, whole_text
from folioloom.session import work_folder

CACHE = "version string, digest binary, n_tokens long"


def tokenizer_version(model: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    library = "tokenizers" if model.endswith(".json") else "sentencepiece"
    with open(model, "rb") as file:
        return hashlib.sha256(file.read() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def _counter(model: str):
    """A function from texts to their numbers of tokens, without any added token."""
    if model.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(model)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=model)
    return lambda texts: [len(processor.encode(text)) for text in texts]


def open_cache(spark: SparkSession, cache: str | None) -> str:
    """The folder of the cache, made if it isn't there; a new one in the work folder by default."""
    cache = cache or work_folder(spark, "token-cache")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    return cache


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Digest and count, one row each, though a repeated job may have appended some twice."""
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, cache: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``model`` is a tokenizer file: ``.json`` for tokenizers, ``.model`` for sentencepiece.
    Content is taken as it is: the libraries normalise it themselves, and any change before
    could change a count.  A null text is the empty text, of no bytes.  Rows with the same
    id or text each get their row; an empty table gives an empty result; columns other than
    ``doc_id`` and ``text`` are not looked at.  ``cache`` is a shared folder that outlives
    the call; jobs may append to it at the same time.
    """
    spark, version = docs.sparkSession, tokenizer_version(model)
    cache = open_cache(spark, cache)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = in_worker(f"counter {version}", lambda: _counter(model))
        for batch in batches:
            texts = batch.column(1)
            n_tokens = [n for k in range(0, len(texts), 64) for n in count(texts.slice(k, 64).to_pylist())]
            names = ["version", "digest", "n_tokens"]
            arrays = [pa.array([version] * len(texts), pa.string()), batch.column(0), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keyed = settle(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-digests")
    # Digests are asked for first; only texts that have no count yet are encoded.  Of the documents
    # with such a text one stands for it, so that a text of very many documents is no hot key.
    stored = settle(stored_counts(spark, cache, version), "token-counts")
    ones = keyed.groupBy("digest").agg(F.min("doc_id").alias("one"))
    misses = settle(ones.join(stored, "digest", "left_anti").withColumnRenamed("digest", "missed"), "token-misses")
    if not misses.isEmpty():
        stands = (F.col("digest") == F.col("missed")) & F.col("doc_id").eqNullSafe(F.col("one"))
        # Repeated rows are encoded as often as they are; their count is the same.
        found = texts.join(misses, stands, "left_semi").select("digest", "text")
        found.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
        # A join on an aggregate's own shuffle couldn't split a digest that many documents have.
        stored = settle(stored_counts(spark, cache, version), "token-counts")
    answered = keyed.join(stored, "digest")
    return answered.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
