"""Pages to chunks as they arrive, with resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folioloom.operators.chunking import chunk_documents
from folioloom.operators.pages import extract_main_text
from folioloom.streaming.tables import keep_on_disk, read_batches, start, write_batch

TEXTS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)


def page_texts(pages: DataFrame, content: str, title: str, remove: list[str]) -> DataFrame:
    """Title, text and state of pages; a page without any text is in error, alone."""
    texts = extract_main_text(pages.select("page_id", "html"), content, title, remove)
    status = F.when(F.length("text") > 0, "crawled").otherwise("error")
    return texts.select("page_id", "title", "text", status.alias("status"))


def once_done(texts: DataFrame) -> DataFrame:
    """Every page that is done once, every page in error once, whatever arrives again.

    The keys are in the stream's own state, so a batch costs the same however many came before
    it, and a restart on the checkpoint knows them.
    """
    return texts.dropDuplicates(["page_id", "status"])


def run_pages(
    pages: DataFrame,
    path: str,
    checkpoint: str,
    content: str,
    title: str,
    remove: list[str],
    chunk: dict | None = None,
    seconds: int | None = None,
    between: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Turn a stream of pages into texts and chunks, tables under ``path``.

    A page that is done is skipped when it arrives again; one in error is taken again, and its
    text then goes before the error.  ``between`` is called with the batch's number after its
    texts and before its chunks are written.
    """
    spark = pages.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{path}/texts", batch_id)
        if between:
            between(batch_id)
        # Chunks are cut from the written texts: the pages are not parsed a second time.
        texts = spark.read.schema(TEXTS).parquet(f"{path}/texts/batch_id={batch_id}")
        ready = texts.filter("status = 'crawled'").select("page_id", "text")
        write_batch(chunk_documents(ready, **(chunk or {})), f"{path}/chunks", batch_id)

    keep_on_disk(spark)
    texts = once_done(page_texts(pages, content, title, remove))
    return start(texts.writeStream.foreachBatch(save), checkpoint, seconds)


def observed(rows: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Rows with counters that are filled while an action runs over them."""
    progress = Observation(name)
    counters = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "error").alias("errors")]
    return rows.observe(progress, *counters), progress


def remaining(pages: DataFrame, done: DataFrame, key: str = "page_id") -> DataFrame:
    """Rows still to be worked on."""
    return pages.join(done.select(key), key, "left_anti")


def latest_texts(spark: SparkSession, path: str) -> DataFrame:
    """One text per page: the newest that is done, else the newest error."""
    rows = read_batches(spark, f"{path}/texts", TEXTS)
    done = F.col("status") == "crawled"
    newest = F.max_by(F.struct("title", "text", "status"), F.struct(done, "batch_id"))
    return rows.groupBy("page_id").agg(newest.alias("_t")).select("page_id", "_t.*")
