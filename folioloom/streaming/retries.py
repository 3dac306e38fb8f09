"""Rows that fail are set aside and taken up again by a later batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folioloom.streaming.tables import read_batches, start, write_batch

DONE, ERROR = "translated", "error"


def guarded(fn: Callable[..., str]) -> Callable[..., Column]:
    """A column function of (value, error) from a plain function of a row's values; what it
    raises becomes the row's error and stops nothing."""

    @F.pandas_udf("value string, error string")
    def each(*columns: pd.Series) -> pd.DataFrame:
        def one(values: tuple) -> tuple[str | None, str | None]:
            try:
                return fn(*values), None
            except Exception as failure:  # noqa: BLE001
                return None, f"{type(failure).__name__}: {failure}"

        return pd.DataFrame([one(row) for row in zip(*columns, strict=True)], columns=["value", "error"])

    return each


def attempted(rows: DataFrame, key: str, step: Callable[..., Column]) -> DataFrame:
    """(key, text, attempt) rows after one attempt: value, error and status."""
    tried = rows.withColumn("_r", step(F.col(key), F.col("text"), F.col("attempt")))
    status = F.when(F.col("_r.error").isNull(), DONE).otherwise(ERROR)
    return tried.select(key, "text", "attempt", F.col("_r.value").alias("value"), F.col("_r.error").alias("error"), status.alias("status"))


def schema(key: T.StructField) -> T.StructType:
    strings = [T.StructField(name, T.StringType()) for name in ("value", "error", "status")]
    return T.StructType([key, T.StructField("text", T.StringType()), T.StructField("attempt", T.LongType()), *strings])


def run_retrying(
    rows: DataFrame, key: str, step: Callable[..., Column], path: str, checkpoint: str, attempts: int = 3,
    seconds: int | None = None,
) -> StreamingQuery:
    """Work on a stream of (key, text); what fails waits in quarantine for the next batch.

    The tables ``done`` and ``quarantine`` have a folder per batch; quarantine has all rows that
    wait after it, so a batch reads the folder before its own and no others.  A row that failed
    ``attempts`` times is written to ``done`` with its last error.
    """
    spark, fields = rows.sparkSession, schema(rows.schema[key])

    def save(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select(key, "text", F.lit(1).cast("long").alias("attempt"))
        work_on(spark, fresh, fields, key, step, path, batch_id, attempts)

    return start(rows.writeStream.foreachBatch(save), checkpoint, seconds)


def work_on(
    spark: SparkSession, fresh: DataFrame, fields: T.StructType, key: str, step: Callable[..., Column], path: str,
    batch_id: int, attempts: int,
) -> None:
    """One batch: the new rows and those that wait.  Run again, it leaves the same tables."""
    waiting = read_batches(spark, f"{path}/quarantine", fields).filter(F.col("batch_id") == batch_id - 1)
    again = waiting.select(key, "text", (F.col("attempt") + 1).alias("attempt"))
    # The step runs once: both tables are taken from what it left.
    write_batch(attempted(fresh.unionByName(again), key, step), f"{path}/tried", batch_id)
    tried = spark.read.schema(fields).parquet(f"{path}/tried/batch_id={batch_id}")
    over = (F.col("status") == DONE) | (F.col("attempt") >= attempts)
    # What is over needs no text any more.
    write_batch(tried.filter(over).withColumn("text", F.lit(None).cast("string")), f"{path}/done", batch_id)
    write_batch(tried.filter(~over), f"{path}/quarantine", batch_id)


def retry_rest(
    spark: SparkSession, key: T.StructField, step: Callable[..., Column], path: str, attempts: int = 3
) -> None:
    """Take up what still waits when a stream has ended, until nothing does: at most
    ``attempts`` rounds, numbered on from its batches."""
    fields = schema(key)
    while True:
        batches = read_batches(spark, f"{path}/quarantine", fields)
        last = spark.read.option("basePath", f"{path}/tried").parquet(f"{path}/tried").agg(F.max("batch_id")).first()[0]
        if last is None or batches.filter(F.col("batch_id") == last).isEmpty():
            return
        none = spark.createDataFrame([], T.StructType([*fields.fields[:3]]))
        work_on(spark, none, fields, key.name, step, path, last + 1, attempts)


def results(spark: SparkSession, key: T.StructField, path: str) -> DataFrame:
    """One row for each row that is over: value or error, status and number of attempts."""
    rows = read_batches(spark, f"{path}/done", schema(key))
    return rows.select(key.name, "value", "error", "status", F.col("attempt").alias("attempts"))
