"""Event feeds of jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioloom import fixed_values as fixed
from folioloom.operators.events import event_filter
from folioloom.streaming.tables import keep_on_disk, start


def run_event_log(
    events: DataFrame, path: str, checkpoint: str, job_id: str | None = None, seconds: int | None = None
) -> StreamingQuery:
    """Append the events of all jobs, or of one, to a table.  Needs no state and no shuffle."""
    feed = event_filter(events, job_id)
    writer = feed.writeStream.format("parquet").outputMode("append").option("path", path)
    return start(writer, checkpoint, seconds)


BEATS = T.StructType(
    [T.StructField("job_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("number", T.LongType())]
)


#: Jobs are kept in so many groups by hash, as a call for each of them costs far more than its work.
GROUPS = 4096
_KEPT = "jobs array<string>, sent array<long>, since array<long>, due array<long>"


def _beats(idle: int, forget: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Keeps per job how many heartbeats it had since its last event, when that was, and when
    the next is due; the group wakes up for the first of them."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        kept = {job: numbers for job, *numbers in zip(*state.get)} if state.exists else {}
        if not state.hasTimedOut:
            ended = {}
            for batch in rows:
                for job, ends in zip(batch["job_id"], batch["ends"]):
                    ended[job] = ended.get(job, False) or ends
            for job, ends in ended.items():
                kept.pop(job, None)
                if not ends:
                    kept[job] = [0, now, now + idle]
        beats = []
        for job, (sent, since, due) in list(kept.items()):
            if due > now:
                continue
            if now - since >= forget:
                del kept[job]
            else:
                kept[job] = [sent + 1, since, now + idle]
                beats.append((job, "heartbeat", sent + 1))
        if beats:
            yield pd.DataFrame(beats, columns=BEATS.fieldNames())
        if kept:
            state.update((list(kept), *map(list, zip(*kept.values()))))
            state.setTimeoutDuration(min(due for _, _, due in kept.values()) - now)
        elif state.exists:
            state.remove()

    return step


def heartbeats(events: DataFrame, idle_seconds: int = 30, forget_seconds: int = 24 * 3600) -> DataFrame:
    """A heartbeat row for every job that has had no event for a while, and again after each
    such while, until its next event, its end, or ``forget_seconds``.

    Only the job id and whether the job ends go through the shuffle, once per job and Arrow
    batch.  Three numbers are kept per job; they go with its end.
    """
    keep_on_disk(events.sparkSession)

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop_duplicates()

    return (
        events.select(
            F.col("job_id").cast("string").alias("job_id"),
            F.coalesce(F.col("type").isin(*fixed.LAST_EVENTS), F.lit(False)).alias("ends"),
        )
        .mapInPandas(once, "job_id string, ends boolean")
        .withColumn("group", F.pmod(F.xxhash64("job_id"), F.lit(GROUPS)))
        .groupBy("group")
        .applyInPandasWithState(
            _beats(idle_seconds * 1000, forget_seconds * 1000),
            outputStructType=BEATS,
            stateStructType=_KEPT,
            outputMode="append",
            timeoutConf=GroupStateTimeout.ProcessingTimeTimeout,
        )
    )
