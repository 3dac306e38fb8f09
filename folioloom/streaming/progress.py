"""Progress of jobs while their streams run.

Per job: a row for every interval in which it had events, kept by a stream.  Per run: a row for
every micro-batch, with the counters observed in it, written by a listener.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from folioloom.streaming.tables import keep_on_disk, read_batches, start, write_batch

COUNTERS = ["events", "crawled", "translated", "errors"]
INTERVALS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(name, T.LongType()) for name in COUNTERS],
    ]
)
BATCHES = "run_id string, batch_id long, at string, input_rows long, counters string"


def counters(kind: Column) -> list[Column]:
    """How many events, chapters crawled and translated, and errors there are."""
    named = {"crawled": "chapter_crawled", "translated": "chapter_translated", "errors": "chapter_error"}
    return [
        F.count(F.lit(1)).alias("events"),
        *[F.count_if(kind == value).alias(name) for name, value in named.items()],
    ]


def interval_counts(events: DataFrame, interval: str, late: str | None = None) -> DataFrame:
    """Counters of every job and interval (job_id, ts: the interval's end), batch or stream.

    Events that come later than ``late`` behind the newest one are not counted any more, and
    their intervals leave the state of a stream; without it all are kept.
    """
    known = events.select(F.col("job_id").cast("string").alias("job_id"), "type", F.col("ts").cast("timestamp").alias("ts"))
    known = known.withWatermark("ts", late) if late else known
    counted = known.groupBy("job_id", F.window("ts", interval)).agg(*counters(F.col("type")))
    return counted.select("job_id", F.col("window.end").alias("ts"), *COUNTERS)


def run_progress(
    events: DataFrame, path: str, checkpoint: str, interval: str = "2 seconds", late: str | None = None,
    seconds: int | None = None,
) -> StreamingQuery:
    """Keep the counters of jobs and intervals on disk; a batch writes those that it changed."""

    def save(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    keep_on_disk(events.sparkSession)
    counted = interval_counts(events, interval, late)
    return start(counted.writeStream.outputMode("update").foreachBatch(save), checkpoint, seconds)


def progress_events(spark: SparkSession, path: str) -> DataFrame:
    """A progress event of every job and interval: what it had done by the interval's end.

    A job has one row per interval, so what is summed in order is bounded by its duration.
    """
    rows = read_batches(spark, path, INTERVALS)
    newest = F.max_by(F.struct(*COUNTERS), "batch_id").alias("_c")
    latest = rows.groupBy("job_id", "ts").agg(newest).select("job_id", "ts", "_c.*")
    so_far = Window.partitionBy("job_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    summed = latest.select("job_id", "ts", *[F.sum(c).over(so_far).alias(c) for c in COUNTERS])
    return summed.select(F.lit("progress").alias("type"), F.to_json(F.struct(*COUNTERS)).alias("data"), "job_id", "ts", *COUNTERS)


class ProgressLog(StreamingQueryListener):
    """Appends a row to a table for every micro-batch of every stream that observes ``name``."""

    def __init__(self, spark: SparkSession, path: str, name: str = "progress"):
        self.spark, self.path, self.name = spark, path, name
        self.ended: dict[str, threading.Event] = {}

    def _event(self, run_id: str) -> threading.Event:
        return self.ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:
        self._event(event.runId)

    def onQueryIdle(self, event) -> None:
        """Nothing was done, so there is nothing to write."""

    def onQueryProgress(self, event) -> None:
        done = event.progress
        observed = done.observedMetrics.get(self.name)
        if observed is None:
            return
        row = (str(done.runId), done.batchId, done.timestamp, done.numInputRows, json.dumps(observed.asDict()))
        self.spark.createDataFrame([row], BATCHES).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryTerminated(self, event) -> None:
        self._event(event.runId).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the rows of a query that has ended are written."""
        if not self._event(query.runId).wait(seconds):
            raise TimeoutError(f"no end of run {query.runId} within {seconds} seconds")


def observed_batches(rows: DataFrame, kind: Column, name: str = "progress") -> DataFrame:
    """Rows of a stream whose batches report their counters to a listener."""
    return rows.observe(name, *counters(kind))


def batch_progress(spark: SparkSession, path: str) -> DataFrame:
    """The rows that a ProgressLog wrote, with their counters."""
    fields = F.from_json("counters", ", ".join(f"{c} long" for c in COUNTERS))
    rows = spark.read.schema(BATCHES).parquet(path).withColumn("_c", fields)
    return rows.select("run_id", "batch_id", "at", "input_rows", "_c.*")
