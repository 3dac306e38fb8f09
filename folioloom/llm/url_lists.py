"""URL filters by dated lists: validity intervals and an as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioloom.llm.common import settle

#: What a dated list entry may do.
BLOCK, ALLOW, REMOVE = "block", "allow", "remove"


def host_of(url: Column) -> Column:
    """Host of an absolute http(s) URL in lower case, without user and port; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit("")))


def host_chain(host: Column) -> Column:
    """The host and its parent domains of two labels or more: a.b.c gives a.b.c and b.c."""
    labels = F.split(host, r"\.")
    cut = lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), ".")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0))), cut)


def changes_of(entries: DataFrame) -> DataFrame:
    """``entry, at, action``: one change of an entry at a time.

    ``entries`` has ``entry, action, at, seq``; of changes at one time the one of the highest
    ``seq`` counts.
    """
    known = F.col("entry").isNotNull() & F.col("at").isNotNull() & F.col("action").isin(BLOCK, ALLOW, REMOVE)
    return entries.where(known).groupBy("entry", "at").agg(F.max(F.struct("seq", "action"))["action"].alias("action"))


def active_entries(keys: DataFrame, changes: DataFrame) -> DataFrame:
    """``_row, entry, action, since`` for every ``_row, _key, _at`` whose key is listed then.

    An as-of join: a change opens an interval that holds its start and ends with the next change
    of the entry, and the last change up to a capture's time is that of the interval it lies in.
    Changes and captures of an entry are read together in the order of time, a change before
    captures of its moment.  Cells of a minute are read apart; what a cell leaves is carried on to
    later ones of its day, and what a day leaves to later days, by one row for each cell and day
    that has any.  So neither an entry with a third of all captures nor a long list history is in
    one task, and rows do not grow with the time that is covered.
    """
    # Only changes have these fields, so what is carried on is never a capture.
    change = F.struct("at", "action").alias("_change")
    listed = changes.select("entry", F.col("at").alias("_time"), change, F.lit(None).cast("long").alias("_row"))
    none = F.lit(None).cast(listed.schema["_change"].dataType)
    asked = keys.select(F.col("_key").alias("entry"), F.col("_at").alias("_time"), none.alias("_change"), "_row")
    rows = listed.unionByName(asked).withColumn("_cell", F.date_trunc("minute", "_time"))
    inside = Window.partitionBy("entry", "_cell").orderBy("_time", F.col("_row").asc_nulls_first())
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = rows.withColumn("_here", F.last("_change", ignorenulls=True).over(inside))
    day = F.to_date("_cell").alias("_day")
    left = rows.groupBy("entry", day, "_cell").agg(F.max("_change").alias("_left"))
    earlier = Window.unboundedPreceding, -1
    by_cell = Window.partitionBy("entry", "_day").orderBy("_cell").rowsBetween(*earlier)
    by_day = Window.partitionBy("entry").orderBy("_day").rowsBetween(*earlier)
    days = left.groupBy("entry", "_day").agg(F.max("_left").alias("_left"))
    days = days.select("entry", "_day", F.last("_left", ignorenulls=True).over(by_day).alias("_earlier"))
    cells = left.withColumn("_today", F.last("_left", ignorenulls=True).over(by_cell)).join(days, ["entry", "_day"])
    carried = cells.select("entry", "_cell", F.coalesce("_today", "_earlier").alias("_before"))
    found = read.where(F.col("_row").isNotNull()).join(carried, ["entry", "_cell"])
    last = F.coalesce("_here", "_before")
    held = found.select("_row", "entry", last["action"].alias("action"), last["at"].alias("since"))
    return held.where(F.col("action") != REMOVE)


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture: ``page_id, url, host, fetched_at, entry, action, listed_at, kept``.

    ``captures`` has ``page_id, url, fetched_at``.  Of the entries for the host and its parent
    domains that are active at the fetch time, the longest decides; it is null, and the page
    stays, where none is.  An interval holds its start, not its end.  Captures without URL,
    host or time match nothing and stay.  Repeated captures each get their row; either table
    may be empty; other columns are not looked at.
    """
    # Numbered once: the numbers are used on both sides of a join.
    pages = settle(
        captures.select(
            F.monotonically_increasing_id().alias("_row"), "page_id", "url", host_of(F.col("url")).alias("host"), "fetched_at"
        ),
        "captures",
    )
    timed = pages.where(F.col("host").isNotNull() & F.col("fetched_at").isNotNull())
    keys = timed.select("_row", F.explode(host_chain(F.col("host"))).alias("_key"), F.col("fetched_at").alias("_at"))
    changes = settle(changes_of(entries), "list-changes")
    # Most hosts are on no list; their keys go no further.
    keys = keys.join(changes.select(F.col("entry").alias("_key")).distinct(), "_key", "left_semi")
    held = active_entries(keys, changes)
    hit = F.struct(F.length("entry").alias("n"), "entry", "action", "since")
    decided = held.groupBy("_row").agg(F.max(hit).alias("_hit"))
    return pages.join(decided, "_row", "left").select(
        "page_id",
        "url",
        "host",
        "fetched_at",
        F.col("_hit.entry").alias("entry"),
        F.col("_hit.action").alias("action"),
        F.col("_hit.since").alias("listed_at"),
        F.coalesce(F.col("_hit.action") != BLOCK, F.lit(True)).alias("kept"),
    )
