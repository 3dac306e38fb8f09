"""States of chapters as an append log with snapshots.

Every append is a folder of the log; a compaction folds the log so far into a snapshot.  The
state of a chapter is read from the newest snapshot and the appends after it, so neither an
append nor a read rewrites or rereads what is folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioloom.streaming.tables import exists, read_batches, write_batch

KEY = ["book_id", "index"]
CHANGES = T.StructType(
    [
        T.StructField("book_id", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)
STATES = T.StructType(
    [
        *CHANGES.fields[:3],
        T.StructField("error_message", T.StringType()),
        T.StructField("crawled_at", T.TimestampType()),
        T.StructField("translated_at", T.TimestampType()),
        T.StructField("changed_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)


def append_states(updates: DataFrame, path: str, number: int) -> None:
    """State changes as append ``number`` of the log; appended again it replaces itself."""
    write_batch(updates.select(*CHANGES.fieldNames()), f"{path}/log", number)


def _as_states(changes: DataFrame) -> DataFrame:
    reached = lambda status: F.when(F.col("status") == status, F.col("ts"))
    return changes.select(
        *KEY,
        "status",
        F.col("error").alias("error_message"),
        reached("crawled").alias("crawled_at"),
        reached("translated").alias("translated_at"),
        F.col("ts").alias("changed_at"),
        "seq",
    )


def merged(states: DataFrame) -> DataFrame:
    """One row per chapter: its last status with the error of it, and when it was reached last.

    Built-in aggregates, so rows of a chapter are merged in every task first."""
    order: Column = F.struct("changed_at", "seq")
    last = F.max_by(F.struct("status", "error_message", "changed_at", "seq"), order).alias("_l")
    times = [F.max(c).alias(c) for c in ("crawled_at", "translated_at")]
    return states.groupBy(*KEY).agg(last, *times).select(
        *KEY, "_l.status", "_l.error_message", "crawled_at", "translated_at", "_l.changed_at", "_l.seq"
    )


def last_snapshot(spark: SparkSession, path: str) -> int:
    """The append up to which the newest finished snapshot goes, -1 where there is none."""
    if not exists(spark, f"{path}/finished"):
        return -1
    found = spark.read.schema("upto long").parquet(f"{path}/finished").agg(F.max("upto")).first()[0]
    return -1 if found is None else found


def _unfolded(spark: SparkSession, path: str, upto: int) -> tuple[DataFrame, DataFrame]:
    """The snapshot up to an append, and the appends after it."""
    log = read_batches(spark, f"{path}/log", CHANGES).filter(F.col("batch_id") > upto)
    if upto < 0:
        return spark.createDataFrame([], STATES), log
    return spark.read.schema(STATES).parquet(f"{path}/snapshots/upto={upto}"), log


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The current state of every chapter: snapshot and later appends, merged on read."""
    snapshot, log = _unfolded(spark, path, last_snapshot(spark, path))
    return merged(snapshot.unionByName(_as_states(log).select(*STATES.fieldNames())))


def compact(spark: SparkSession, path: str) -> int:
    """Fold all appends so far into a new snapshot; says up to which one it goes.

    Readers take a snapshot only when it is listed as finished, which is written last."""
    upto = last_snapshot(spark, path)
    snapshot, log = _unfolded(spark, path, upto)
    newest = log.agg(F.max("batch_id")).first()[0]
    if newest is None:
        return upto
    folded = log.filter(F.col("batch_id") <= newest)
    states = merged(snapshot.unionByName(_as_states(folded).select(*STATES.fieldNames())))
    states.write.mode("overwrite").parquet(f"{path}/snapshots/upto={newest}")
    spark.createDataFrame([(newest,)], "upto long").coalesce(1).write.mode("append").parquet(f"{path}/finished")
    return newest
