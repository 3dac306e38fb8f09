"""A glossary that grows while texts arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folioloom import fixed_values as fixed
from folioloom.functions.arrays import each
from folioloom.functions.text import word_tokens
from folioloom.operators.glossary import grow_glossary
from folioloom.operators.terms import fit_terms, refit_terms
from folioloom.streaming.tables import exists, read_batches, start, write_batch

TERMS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("term", "target", "category", "notes")]
)
VERSIONS = T.StructType([T.StructField("version", T.LongType())])
Extractor = Callable[[DataFrame], DataFrame]


def frequent_words(docs: DataFrame, limit: int = fixed.NEW_TERMS_PER_TEXT, shortest: int = 6) -> DataFrame:
    """A stand-in for an extractor: the most frequent longer words of each text (doc_id, text)."""
    words = F.filter(word_tokens(F.lower("text")), lambda w: F.length(w) >= shortest)
    # Equal words are counted inside the row by sorting, so only the best leave it.
    ordered = docs.select("doc_id", F.sort_array(words).alias("_words"))

    def first_of_word(word: Column, i: Column) -> Column:
        return (i == 0) | (F.get("_words", i - 1) != word)

    placed = F.transform("_words", lambda w, i: F.when(first_of_word(w, i), i))
    starts = ordered.select("doc_id", "_words", F.filter(placed, lambda i: i.isNotNull()).alias("_starts"))

    def counted(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get("_starts", i + 1), F.size("_words"))
        return F.struct((start - end).alias("neg_n"), F.get("_words", start).alias("term"))

    best = F.slice(F.sort_array(F.transform("_starts", counted)), 1, limit)
    return starts.select("doc_id", F.posexplode(each(best)).alias("place", "_best")).select(
        F.col("_best.term").alias("term"),
        F.upper("_best.term").alias("target"),
        F.lit(fixed.DEFAULT_CATEGORY).alias("category"),
        F.lit(None).cast("string").alias("notes"),
        F.struct("doc_id", (F.col("place") + 1).alias("place")).alias("seq"),
    )


#: Batches after which all terms so far are written together.
FOLD = 16


def known_terms(spark: SparkSession, path: str, base: DataFrame, before: int | None = None) -> DataFrame:
    """Terms of the starting glossary and of all batches so far.

    Batches are folded every ``FOLD`` of them, so that however many there were, a batch reads one
    table of terms and fewer than ``FOLD`` later ones.
    """
    fields = TERMS.fieldNames()
    folded = -1 if before is None else before // FOLD * FOLD - 1
    grown = read_batches(spark, f"{path}/terms", TERMS, before)
    rows = base.select(*fields)
    if folded >= 0 and exists(spark, f"{path}/known/upto={folded}"):
        rows = spark.read.schema(TERMS).parquet(f"{path}/known/upto={folded}").select(*fields)
        grown = grown.filter(F.col("batch_id") > folded)
    return rows.unionByName(grown.select(*fields))


def fold_terms(spark: SparkSession, path: str, base: DataFrame, batch_id: int) -> None:
    """Write the terms up to a batch together, if it is the last of ``FOLD``."""
    if batch_id % FOLD == FOLD - 1:
        known_terms(spark, path, base, before=batch_id + 1 - FOLD).unionByName(
            read_batches(spark, f"{path}/terms", TERMS)
            .filter(F.col("batch_id").between(batch_id + 1 - FOLD, batch_id))
            .select(*TERMS.fieldNames())
        ).write.mode("overwrite").parquet(f"{path}/known/upto={batch_id}")


def version(spark: SparkSession, path: str, before: int | None = None) -> int:
    """Number of batches that added terms."""
    grown = read_batches(spark, f"{path}/terms", TERMS, before)
    return grown.select("batch_id").distinct().count()


def next_version(spark: SparkSession, path: str, batch_id: int, added: bool) -> int:
    """The version after a batch, from the one noted after the batch before it."""
    noted = read_batches(spark, f"{path}/versions", VERSIONS).filter(F.col("batch_id") == batch_id - 1).first()
    number = (noted["version"] if noted else version(spark, path, before=batch_id)) + int(added)
    write_batch(spark.createDataFrame([(number,)], VERSIONS).coalesce(1), f"{path}/versions", batch_id)
    return number


def run_growth(
    docs: DataFrame,
    path: str,
    checkpoint: str,
    base: DataFrame,
    extract: Extractor = frequent_words,
    all_docs: DataFrame | Callable[[], DataFrame] | None = None,
    refresh: int = fixed.SCORER_REFRESH_VERSIONS,
    seconds: int | None = None,
) -> StreamingQuery:
    """Extract terms from the texts of every batch and add those that are new.

    The table ``terms`` has one folder per batch; every batch with new terms is a version.
    When ``refresh`` versions have passed since the last fit, term statistics over
    ``all_docs``, as it is then, are written under ``stats/version=N``.
    """
    spark = docs.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        known = known_terms(spark, path, base, before=batch_id)
        fresh = grow_glossary(batch, known, extract).select(*TERMS.fieldNames())
        write_batch(fresh, f"{path}/terms", batch_id)
        fold_terms(spark, path, base, batch_id)
        if all_docs is None:
            return
        added = not read_batches(spark, f"{path}/terms", TERMS).filter(F.col("batch_id") == batch_id).isEmpty()
        current = next_version(spark, path, batch_id, added)
        if current - last_fit(spark, path) >= refresh:
            library = all_docs() if callable(all_docs) else all_docs
            write_stats(known_terms(spark, path, base, before=batch_id + 1), library, path, current)

    return start(docs.writeStream.foreachBatch(save), checkpoint, seconds)


def last_fit(spark: SparkSession, path: str, before: int | None = None) -> int:
    """Version of the newest statistics, 0 where there are none; it outlives a restart."""
    if not exists(spark, f"{path}/stats"):
        return 0
    fits = spark.read.parquet(f"{path}/stats")
    fits = fits if before is None else fits.filter(F.col("version") < before)
    return fits.agg(F.max("version")).first()[0] or 0


def write_stats(glossary: DataFrame, docs: DataFrame, path: str, number: int) -> None:
    """Term statistics of a glossary version over all documents.

    They go on from the version before: documents that it counted are searched for new terms
    alone, and new documents for all.  The ids that a version counted first are its folder of
    ``counted``.
    """
    spark, last = glossary.sparkSession, last_fit(glossary.sparkSession, path, before=number)
    if last:
        previous = spark.read.parquet(f"{path}/stats/version={last}")
        ids = spark.read.option("basePath", f"{path}/counted").parquet(f"{path}/counted")
        ids = ids.filter(F.col("version") <= last).select("doc_id")
        added = docs.join(ids, "doc_id", "left_anti")
        fitted = refit_terms(previous, docs.join(ids, "doc_id", "left_semi"), added, glossary, "doc_id")
    else:
        added, fitted = docs, fit_terms(docs, glossary, "doc_id")
    fitted.write.mode("overwrite").parquet(f"{path}/stats/version={number}")
    added.select("doc_id").write.mode("overwrite").parquet(f"{path}/counted/version={number}")


def first_glossary(
    docs: DataFrame, existing: DataFrame, make: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The starting glossary: made once from samples where there is none yet.

    An error in ``make`` leaves the existing table as it is, so the stage can be run again.
    """
    return existing if not existing.isEmpty() or docs.isEmpty() else make(docs)
