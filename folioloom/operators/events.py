"""Feeds, labels and roll-ups over event and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom import fixed_values as fixed
from folioloom.operators.ordering import first_rows


def event_filter(events: DataFrame, job_id: str | None = None, log_view: bool = False) -> DataFrame:
    """Events of a job without heartbeats; the log view leaves out progress events too."""
    kept = events.filter(F.col("type") != "heartbeat")
    if job_id is not None:
        kept = kept.filter(F.col("job_id") == job_id)
    return kept.filter(F.col("type") != "progress") if log_view else kept


def event_label(kind: Column, data: Column) -> Column:
    """Readable text of an event with JSON data."""
    number = F.coalesce(F.get_json_object(data, "$.chapter_index"), F.lit("undefined"))
    given = F.get_json_object(data, "$.error")
    error = F.coalesce(F.nullif(given, F.lit("")), F.lit("unknown"))
    chapter = F.concat(F.lit("Ch."), number)
    return (
        F.when(kind == "chapter_translated", F.concat(chapter, F.lit(" translated")))
        .when(kind == "chapter_crawled", F.concat(chapter, F.lit(" crawled")))
        .when(kind == "chapter_error", F.concat(chapter, F.lit(" error: "), error))
        .when(kind == "job_started", "Job started")
        .when(kind == "job_completed", "Job completed")
        .when(kind == "job_failed", F.concat(F.lit("Job failed: "), error))
        .when(kind == "job_cancelled", "Job cancelled")
        .otherwise(kind)
    )


def event_level(kind: Column) -> Column:
    return (
        F.when(kind.contains("translated") | kind.contains("completed"), "success")
        .when(kind.contains("crawled") | kind.contains("started"), "warning")
        .when(kind.contains("error") | kind.contains("failed"), "error")
        .otherwise("other")
    )


def latest_progress(events: DataFrame) -> DataFrame:
    """Data of the last progress event of every job; events of one moment by their id."""
    return (
        events.filter(F.col("type") == "progress")
        .groupBy("job_id")
        .agg(F.max_by("data", F.struct("ts", "event_id")).alias("data"), F.max("ts").alias("ts"))
    )


def recent_events(events: DataFrame, limit: int = fixed.RECENT_EVENTS) -> DataFrame:
    """The last events of every job."""
    return first_rows(events, "job_id", [F.desc("ts"), F.desc("event_id")], limit)


def job_split(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("active", F.col("status").isin(*fixed.ACTIVE_JOB_STATUSES))


def jobs_newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id")


def job_progress(events: DataFrame) -> DataFrame:
    """Counters of every job from its events."""
    kind = F.col("type")
    crawl_errors = F.count_if(kind == "crawl_error")
    translate_errors = F.count_if(kind == "translate_error")
    return events.groupBy("job_id").agg(
        F.count_if(kind == "chapter_crawled").alias("n_crawled"),
        F.count_if(kind == "chapter_translated").alias("n_translated"),
        (crawl_errors + translate_errors).alias("n_errors"),
        F.max("ts").alias("last_ts"),
    )


def export_status(files: DataFrame, formats: list[str]) -> DataFrame:
    """One existing path per book and format (the first by name), null where there is none."""
    return files.groupBy("book_id").agg(
        *[F.min(F.when(F.col("format") == f, F.col("path"))).alias(f) for f in formats]
    )
