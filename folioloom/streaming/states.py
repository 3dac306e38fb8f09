"""Chapter states kept by a stream of state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folioloom.streaming.tables import keep_on_disk, read_batches, start, write_batch

KEY = ["book_id", "index"]
STATES = T.StructType(
    [
        T.StructField("book_id", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("crawled_at", T.TimestampType()),
        T.StructField("translated_at", T.TimestampType()),
        T.StructField("changed_at", T.TimestampType()),
    ]
)


def chapter_states(changes: DataFrame) -> DataFrame:
    """The state of every chapter from its changes (status, error, ts, seq), batch or stream.

    The last change gives status and error message; crawled and translated have the time
    they were last reached.  Built-in aggregates: partial states are merged before the
    shuffle, so a chapter or book with very many changes is no burden.
    """
    last = F.max_by(F.struct("status", "error"), F.struct("ts", "seq"))
    reached = lambda s: F.max(F.when(F.col("status") == s, F.col("ts")))
    return changes.groupBy(*KEY).agg(
        last.alias("_last"),
        reached("crawled").alias("crawled_at"),
        reached("translated").alias("translated_at"),
        F.max("ts").alias("changed_at"),
    ).select(
        *KEY,
        F.col("_last.status").alias("status"),
        F.col("_last.error").alias("error_message"),
        "crawled_at",
        "translated_at",
        "changed_at",
    )


def run_states(
    changes: DataFrame,
    path: str,
    checkpoint: str,
    chapters: DataFrame | None = None,
    seconds: int | None = None,
) -> StreamingQuery:
    """Keep the states of a stream of changes as batches of a table.

    Changes of chapters that are not in ``chapters`` are ignored.  The state holds one row
    per chapter and is bounded by their number; it is kept on disk.
    """
    known = changes if chapters is None else changes.join(chapters.select(*KEY), KEY, "left_semi")

    def save(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    keep_on_disk(changes.sparkSession)
    return start(chapter_states(known).writeStream.outputMode("update").foreachBatch(save), checkpoint, seconds)


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every chapter."""
    rows = read_batches(spark, path, STATES)
    fields = [f for f in STATES.fieldNames() if f not in KEY]
    newest = F.max_by(F.struct(*fields), "batch_id")
    return rows.groupBy(*KEY).agg(newest.alias("_s")).select(*KEY, "_s.*")


def state_events(states: DataFrame) -> DataFrame:
    """Event rows for state changes, for the event log."""
    data = F.to_json(F.struct(F.col("index").alias("chapter_index"), "status"))
    return states.select(
        F.concat(F.lit("chapter_"), F.col("status")).alias("type"),
        data.alias("data"),
        F.col("book_id").alias("job_id"),
        F.col("changed_at").alias("ts"),
    )
