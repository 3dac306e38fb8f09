"""States of books and chapters: what is done, what is left, what can be resumed.

Chapters are rows (book_id, index, status, title_cn, title_vi, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom import fixed_values as fixed
from folioloom.functions.text import non_empty, normalize_title, percent
from folioloom.operators.ordering import nearest_marked
from folioloom.schemas import RUN_SETTINGS


def chapter_range(spec: Column, last: Column) -> Column:
    """Sorted distinct numbers of a range such as ``1-5,10,15-20``.

    Ends are cut to ``last``, starts are not; reversed ranges and single numbers outside
    1..last give nothing; an empty range is everything.
    """
    parts = F.transform(F.split(spec, ","), lambda p: F.split(p, "-", 2))
    bound = lambda p, i: F.trim(F.element_at(p, i)).cast("long")

    def numbers(part: Column) -> Column:
        low = bound(part, 1)
        high = F.least(bound(part, -1), last)
        usable = F.when(F.size(part) == 1, low.between(1, last)).otherwise(low <= high)
        return F.when(usable, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    everything = F.when(last >= 1, F.sequence(F.lit(1).cast("long"), last.cast("long"))).otherwise(
        F.array().cast("array<bigint>")
    )
    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))
    return F.when(non_empty(spec).isNull(), everything).otherwise(chosen)


def in_chapter_range(index: Column, spec: str, last: Column) -> Column:
    """Whether a number belongs to a range; a plain predicate, without building the list."""
    if not spec:
        return index.between(1, last)
    found = F.lit(False)
    for part in spec.split(","):
        low, dash, high = part.partition("-")
        start = int(low)
        if dash:
            found = found | index.between(F.lit(start), F.least(F.lit(int(high)), last))
        else:
            found = found | ((index == start) & index.between(1, last))
    return found


def phase_of(status: Column) -> Column:
    """The phase a chapter waits for: crawl, translate or format; null for none."""
    phases = F.create_map(*[F.lit(x) for phase, s in fixed.PHASE_STATUS.items() for x in (s, phase)])
    return F.try_element_at(phases, status)


def pending_for(chapters: DataFrame, phase: str) -> DataFrame:
    """Chapters waiting for a phase."""
    return chapters.filter(phase_of(F.col("status")) == phase)


def work_lists(chapters: DataFrame, translate_only: bool = False) -> DataFrame:
    """Add the action of a run: crawl, translate, done, or null for none."""
    status = F.col("status")
    action = F.when(status.isin("crawled", "error"), "translate").when(status == "translated", "done")
    if not translate_only:
        action = action.when(status == "pending", "crawl")
    return chapters.withColumn("action", action)


def in_batch(status: Column, resume: bool = True) -> Column:
    """Whether a batch translation takes a chapter: crawled, without resume translated too."""
    return status.isin("crawled") if resume else status.isin("crawled", "translated")


def in_download(status: Column, resume: bool = True) -> Column:
    """Whether a download takes a chapter: pending, without resume any."""
    return status == "pending" if resume else status.isNotNull()


def force_reset(
    chapters: DataFrame, has_raw: Column, mode: str = "full", has_url: bool = False
) -> DataFrame:
    """States after a forced restart; ``mode`` is full, crawl_only or translate_only."""
    to_crawled = mode == "translate_only" or (mode == "full" and not has_url)
    status = F.when(has_raw, "crawled").otherwise(F.col("status")) if to_crawled else F.lit("pending")
    return chapters.withColumn("status", status)


def status_counts(chapters: DataFrame, group: str = "book_id") -> DataFrame:
    """Chapters per state and book, zero where there are none, with both ideas of "translated"."""
    status = F.col("status")
    counts = [F.count_if(status == s).alias(f"n_{s}") for s in fixed.STATUSES]
    done = F.count_if(status.isin(*fixed.DONE_STATUSES))
    total = F.count("status")
    return chapters.groupBy(group).agg(
        *counts,
        total.alias("n_total"),
        done.alias("n_done"),
        (total - done).alias("n_remaining"),
    )


def library_totals(counts: DataFrame) -> DataFrame:
    """One row over all books, from their counts."""
    done, total = F.sum("n_translated"), F.sum("n_total")
    return counts.agg(
        F.count(F.lit(1)).alias("n_books"),
        F.coalesce(total, F.lit(0)).alias("n_chapters"),
        F.coalesce(done, F.lit(0)).alias("n_translated"),
        percent(done, total).alias("pct"),
    )


def run_result(before: DataFrame, after: DataFrame, key: list[str], cancelled: bool = False) -> DataFrame:
    """Counters of a run per book, from the work list before and the states after it."""
    book = key[0]
    joined = before.select(*key, "action").join(after.select(*key, "status"), key, "left")
    action, status = F.col("action"), F.col("status")
    crawled = F.count_if((action == "crawl") & status.isin("crawled", "translated"))
    translated = F.count_if(action.isin("crawl", "translate") & (status == "translated"))
    target = F.count_if(action.isin("crawl", "translate"))
    idle = target == 0
    done = F.count_if(action == "done")
    total = F.count(F.lit(1))
    return joined.groupBy(book).agg(
        total.alias("n_total"),
        crawled.alias("n_crawled"),
        translated.alias("n_translated"),
        F.when(idle, total).otherwise(done + F.count_if(action == "translate")).alias("skipped_crawl"),
        F.when(idle, total).otherwise(done).alias("skipped_translate"),
        F.count_if((action == "crawl") & (status == "error")).alias("failed_crawl"),
        F.count_if((action == "translate") & (status == "error")).alias("failed_translate"),
        ((translated >= target) & F.lit(not cancelled)).alias("all_done"),
    )


def resumable(counts: DataFrame) -> DataFrame:
    """Books with chapters pending, crawled or in error."""
    return counts.filter(F.col("n_pending") + F.col("n_crawled") + F.col("n_error") > 0)


def exclude_active(books: DataFrame, jobs: DataFrame, key: str = "book_id") -> DataFrame:
    """Books without a running or pending job."""
    active = jobs.filter(F.col("status").isin(*fixed.ACTIVE_JOB_STATUSES)).select(key)
    return books.join(active, key, "left_anti")


def parse_settings(settings: DataFrame, text: str = "settings_json") -> DataFrame:
    """Run settings from JSON text; corrupt text gives nulls; last_run_at stands apart."""
    parsed = settings.withColumn(
        "_s", F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, RUN_SETTINGS))
    )
    fields = [f for f in RUN_SETTINGS.fieldNames() if f != "last_run_at"]
    return parsed.withColumn(
        "last_settings",
        F.when(F.col("_s").isNotNull(), F.struct(*[F.col(f"_s.{f}").alias(f) for f in fields])),
    ).withColumn("last_run_at", F.col("_s.last_run_at")).drop("_s", text)


def resume_report(
    chapters: DataFrame, jobs: DataFrame, settings: DataFrame, key: str = "book_id"
) -> DataFrame:
    """Books to resume with their counts and the settings of their last run."""
    books = exclude_active(resumable(status_counts(chapters, key)), jobs, key)
    return books.join(settings, key, "left")


def default_settings(counts: DataFrame, settings: DataFrame, key: str = "book_id", **defaults) -> DataFrame:
    """Settings rows for unfinished books that have none."""
    missing = resumable(counts).join(settings.select(key), key, "left_anti").select(key)
    return missing.withColumns({name: F.lit(value) for name, value in defaults.items()})


def chapter_files(chapters: DataFrame, raw: DataFrame, translated: DataFrame, key: list[str]) -> DataFrame:
    """Chapters with has_raw and has_translated."""
    raws = raw.select(*key).distinct().withColumn("has_raw", F.lit(True))
    texts = translated.select(*key).distinct().withColumn("has_translated", F.lit(True))
    return (
        chapters.join(raws, key, "left")
        .join(texts, key, "left")
        .fillna(False, subset=["has_raw", "has_translated"])
    )


def translated_chapters(chapters: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """Chapters that have a target text, with it."""
    return chapters.join(texts, key)


def adjacent_translated(chapters: DataFrame, group: str = "book_id", order: str = "index") -> DataFrame:
    """Nearest chapters before and after with a target text (column has_translated)."""
    return nearest_marked(
        chapters, group, order, F.col("has_translated"), "previous_index", "next_index"
    )


def first_readable(chapters: DataFrame, group: str = "book_id", order: str = "index") -> DataFrame:
    """First chapter that can be read, per book; 1 where there is none."""
    readable = F.col("has_translated") & F.col("status").isin(*fixed.DONE_STATUSES)
    first = F.min(F.when(readable, F.col(order)))
    return chapters.groupBy(group).agg(F.coalesce(first, F.lit(1)).cast("long").alias("first_index"))


def untitled(chapters: DataFrame) -> DataFrame:
    """Chapters with a source title and no target title."""
    return chapters.filter(
        non_empty(F.col("title_cn")).isNotNull() & non_empty(F.col("title_vi")).isNull()
    )


def recent_books(books: DataFrame, limit: int = 3) -> DataFrame:
    """Books changed last; ties by id."""
    latest = F.coalesce(F.col("updated_at"), F.col("created_at"))
    return books.orderBy(F.desc_nulls_last(latest), "book_id").limit(limit)


def book_badge(translated: Column, total: Column) -> Column:
    return (
        F.when((translated == total) & (total > 0), "Completed")
        .when(translated > 0, "Translating")
        .otherwise("Pending")
    )


def apply_chapter_updates(
    chapters: DataFrame,
    updates: DataFrame,
    now: Column,
    key: tuple[str, str] = ("book_id", "index"),
    order: str | None = None,
) -> DataFrame:
    """Chapters with the titles of the updates; an updated chapter is translated, without error.

    ``updates`` has the key, title_vi and title_cn (null where no numbering is wanted).  Of
    several updates of a chapter the last one by the column ``order`` holds; without it a
    chapter may have one update, and a second one is an error.
    """
    if order is None:
        again = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several updates of a chapter: name their order")))
        last = F.coalesce(again, F.first(F.struct("title_vi", "title_cn"))).alias("_last")
    else:
        last = F.max_by(F.struct("title_vi", "title_cn"), F.col(order)).alias("_last")
    latest = updates.groupBy(*key).agg(last).select(*key, "_last.*")
    changes = latest.select(
        *key, normalize_title(F.col("title_vi"), F.col("title_cn")).alias("_title")
    )
    hit = F.col("_title").isNotNull()
    joined = chapters.join(changes, list(key), "left")
    return (
        joined.withColumn("title_vi", F.coalesce("_title", "title_vi"))
        .withColumn("status", F.when(hit, "translated").otherwise(F.col("status")))
        .withColumn("translated_at", F.when(hit, now).otherwise(F.col("translated_at")))
        .withColumn("error_message", F.when(~hit, F.col("error_message")))
        .drop("_title")
    )


def updates_by_position(chapters: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates that give a 0-based list position, with the chapter number found there.

    ``aligned`` is false where that number is not position + 1, null where the position is
    outside the list.  Chapters come from ``scan_chapters``.
    """
    found = chapters.select("book_id", "position", "index")
    return updates.join(found, ["book_id", "position"], "left").withColumn(
        "aligned", F.col("index") == F.col("position") + 1
    )


def rejected_updates(chapters: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Updates that address no chapter."""
    return updates.join(chapters.select(*key), key, "left_anti")
