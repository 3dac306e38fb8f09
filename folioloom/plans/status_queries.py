"""Queries over the states of books and chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.functions import text as tx
from folioloom.functions.blocks import elapsed_label
from folioloom.operators import quality
from folioloom.operators import status as st
from folioloom.operators.ordering import nearest_marked, number_rows
from folioloom.plans import adapters as ad
from folioloom.plans.registry import query

_C = f"({ad.CHAPTERS_SQL})"
_COUNTS = f"""(SELECT book_id,
    count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'crawled') AS n_crawled,
    count(*) FILTER (status = 'translated') AS n_translated, count(*) FILTER (status = 'formatted') AS n_formatted,
    count(*) FILTER (status = 'exported') AS n_exported, count(*) FILTER (status = 'error') AS n_error,
    count(*) AS n_total, count(*) FILTER (status IN ('translated', 'formatted', 'exported')) AS n_done,
    count(*) - count(*) FILTER (status IN ('translated', 'formatted', 'exported')) AS n_remaining
    FROM {_C} GROUP BY book_id)"""
_RANGE = "1-5,10,15-20,40-1000,7-3"


def _counts(spark, sf_dir):
    """Counts need only books and states: no text, no numbering."""
    return st.status_counts(ad.states(spark, sf_dir))


@query(f"SELECT * FROM {_COUNTS}")
def status_counts_pivot(spark, sf_dir):
    """Chapters per state and book."""
    return _counts(spark, sf_dir)


@query(
    f"""SELECT book_id, CASE WHEN n_translated = n_total AND n_total > 0 THEN 'Completed'
               WHEN n_translated > 0 THEN 'Translating' ELSE 'Pending' END AS badge,
               CAST(floor(100.0 * n_translated / n_total + 0.5) AS BIGINT) AS pct FROM {_COUNTS}"""
)
def book_badges(spark, sf_dir):
    """Badge and percentage of every book."""
    done, total = F.col("n_translated"), F.col("n_total")
    return _counts(spark, sf_dir).select(
        "book_id", st.book_badge(done, total).alias("badge"), tx.percent(done, total).alias("pct")
    )


@query(
    f"""SELECT count(*) AS n_books, CAST(sum(n_total) AS BIGINT) AS n_chapters,
               CAST(sum(n_translated) AS BIGINT) AS n_translated,
               CAST(floor(100.0 * sum(n_translated) / sum(n_total) + 0.5) AS BIGINT) AS pct FROM {_COUNTS}"""
)
def library_totals(spark, sf_dir):
    """Totals over the library."""
    return st.library_totals(_counts(spark, sf_dir))


@query(
    f"""SELECT book_id, index, status FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM {_C})
        WHERE index BETWEEN 1 AND least(5, n) OR (index = 10 AND 10 <= n) OR index BETWEEN 15 AND least(20, n)
           OR index BETWEEN 40 AND least(1000, n)"""
)
def chapter_range(spark, sf_dir):
    """Chapters of every book inside a range, cut to its number of chapters."""
    chapters = ad.chapters(spark, sf_dir).select("book_id", "index", "status")
    sizes = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("last"))
    return (
        chapters.join(sizes, "book_id")
        .filter(st.in_chapter_range(F.col("index"), _RANGE, F.col("last")))
        .drop("last")
    )


@query(
    """SELECT o_orderkey, list_aggregate(list_sort(list_distinct(list_concat(
              range(a, least(a + 6, 40) + 1), CASE WHEN b BETWEEN 1 AND 40 THEN [b] ELSE [] END))),
              'string_agg', ',') AS chapters
       FROM (SELECT o_orderkey, o_orderkey % 45 AS a, o_custkey % 60 AS b FROM orders)"""
)
def range_numbers(spark, sf_dir):
    """Range texts, one per order, as sorted numbers."""
    orders = ad.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    start = F.col("o_orderkey") % 45
    spec = F.concat_ws(
        ", ",
        F.concat_ws("-", start.cast("string"), (start + 6).cast("string")),
        (F.col("o_custkey") % 60).cast("string"),
    )
    numbers = st.chapter_range(spec, F.lit(40).cast("long"))
    joined = F.array_join(numbers.cast("array<string>"), ",")
    return orders.select("o_orderkey", F.nullif(joined, F.lit("")).alias("chapters"))


@query(
    f"""SELECT phase, book_id, count(*) AS n FROM (
          SELECT CASE status WHEN 'pending' THEN 'crawl' WHEN 'crawled' THEN 'translate'
                 WHEN 'translated' THEN 'format' END AS phase, book_id FROM {_C}) WHERE phase IS NOT NULL
        GROUP BY phase, book_id"""
)
def pending_for_phase(spark, sf_dir):
    """Chapters waiting for each phase."""
    phased = ad.states(spark, sf_dir).select("book_id", st.phase_of(F.col("status")).alias("phase"))
    waiting = phased.filter(F.col("phase").isNotNull())
    return waiting.groupBy("phase", "book_id").agg(F.count(F.lit(1)).alias("n"))


_ACTION = """CASE WHEN status IN ('crawled', 'error') THEN 'translate' WHEN status = 'translated' THEN 'done'
                  WHEN status = 'pending' THEN 'crawl' END"""


@query(f"SELECT book_id, index, status, {_ACTION} AS action FROM {_C}")
def work_lists(spark, sf_dir):
    """What a run does with every chapter."""
    return st.work_lists(ad.chapters(spark, sf_dir)).select("book_id", "index", "status", "action")


@query(
    f"""SELECT book_id, count(*) FILTER (status = 'crawled') AS n_batch,
               count(*) FILTER (status IN ('crawled', 'translated')) AS n_batch_again,
               count(*) FILTER (status = 'pending') AS n_download, count(*) AS n_download_again
        FROM {_C} GROUP BY book_id"""
)
def batch_work(spark, sf_dir):
    """Sizes of the batch and download lists, with and without resume."""
    status = F.col("status")
    return ad.states(spark, sf_dir).groupBy("book_id").agg(
        F.count_if(st.in_batch(status)).alias("n_batch"),
        F.count_if(st.in_batch(status, resume=False)).alias("n_batch_again"),
        F.count_if(st.in_download(status)).alias("n_download"),
        F.count_if(st.in_download(status, resume=False)).alias("n_download_again"),
    )


@query(
    f"""SELECT book_id, index, CASE WHEN n_chars >= 500 THEN 'crawled' ELSE status END AS status_crawled,
               'pending' AS status_pending FROM {_C}"""
)
def force_reset(spark, sf_dir):
    """States after a forced restart, with and without source texts."""
    chapters = ad.chapters(spark, sf_dir)
    has_raw = F.col("n_chars") >= 500
    kept = st.force_reset(chapters, has_raw, "translate_only")
    again = st.force_reset(kept.withColumn("status_crawled", F.col("status")), has_raw, "crawl_only")
    return again.select("book_id", "index", "status_crawled", F.col("status").alias("status_pending"))


@query(
    f"""SELECT book_id, count(*) AS n_total,
          count(*) FILTER (action = 'crawl' AND after IN ('crawled', 'translated')) AS n_crawled,
          count(*) FILTER (action IN ('crawl', 'translate') AND after = 'translated') AS n_translated,
          count(*) FILTER (action IN ('done', 'translate')) AS skipped_crawl,
          count(*) FILTER (action = 'done') AS skipped_translate,
          count(*) FILTER (action = 'crawl' AND after = 'error') AS failed_crawl,
          count(*) FILTER (action = 'translate' AND after = 'error') AS failed_translate,
          count(*) FILTER (action IN ('crawl', 'translate') AND after = 'translated')
            >= count(*) FILTER (action IN ('crawl', 'translate')) AS all_done
        FROM (SELECT book_id, {_ACTION} AS action,
                     CASE WHEN n_chars % 11 = 0 THEN 'error' WHEN n_chars % 13 = 0 THEN 'crawled'
                          ELSE 'translated' END AS after FROM {_C}) GROUP BY book_id"""
)
def run_result(spark, sf_dir):
    """Counters of a run over all books."""
    before = st.work_lists(ad.states(spark, sf_dir))
    size = F.col("n_chars")
    after = F.when(size % 11 == 0, "error").when(size % 13 == 0, "crawled").otherwise("translated")
    done = ad.states(spark, sf_dir).withColumn("status", after)
    return st.run_result(before, done, ["book_id", "doc_id"])


def _jobs(spark, sf_dir):
    """One job per book, in the state of the last event of its users."""
    events = ad.table(spark, sf_dir, "events")
    book = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))
    kind = F.max_by("event_type", F.struct("ts", "event_id"))
    last = events.groupBy(book.alias("book_id")).agg(kind.alias("kind"), F.max("ts").alias("created_at"))
    status = (
        F.when(F.col("kind") == "view", "running")
        .when(F.col("kind") == "signup", "pending")
        .otherwise("completed")
    )
    return last.select("book_id", status.alias("status"), "created_at")


_JOBS = """(SELECT book_id, CASE kind WHEN 'view' THEN 'running' WHEN 'signup' THEN 'pending'
                   ELSE 'completed' END AS status, created_at
            FROM (SELECT 'src' || (user_id % 20) AS book_id, arg_max(event_type, ts) AS kind,
                         max(ts) AS created_at FROM events GROUP BY 1))"""


def _settings(spark, sf_dir):
    """Settings text by supplier, some of it corrupt."""
    rows = ad.table(spark, sf_dir, "supplier")
    text = F.concat(
        F.lit('{"style":"'), F.col("s_name"), F.lit('","workers":'), F.col("s_nationkey").cast("string"),
        F.lit(',"crawl_only":false,"last_run_at":"2024-01-'),
        F.lpad((F.col("s_suppkey") % 28 + 1).cast("string"), 2, "0"), F.lit('"'),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    return rows.select(
        F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("book_id"), text.alias("settings_json")
    )


@query(
    f"""SELECT c.*, CASE WHEN s.s_suppkey % 5 <> 0 THEN s.s_name END AS style,
               CASE WHEN s.s_suppkey % 5 <> 0 THEN CAST(s.s_nationkey AS VARCHAR) END AS workers,
               CASE WHEN s.s_suppkey % 5 <> 0 THEN '2024-01-' || lpad(CAST(s.s_suppkey % 28 + 1 AS VARCHAR), 2, '0')
               END AS last_run_at
        FROM {_COUNTS} c LEFT JOIN supplier s ON 'src' || s.s_suppkey = c.book_id
        WHERE n_pending + n_crawled + n_error > 0
          AND c.book_id NOT IN (SELECT book_id FROM {_JOBS} WHERE status IN ('running', 'pending'))"""
)
def resumable_books(spark, sf_dir):
    """Books to resume: unfinished, without an active job, with their last settings."""
    settings = st.parse_settings(_settings(spark, sf_dir))
    report = st.resume_report(ad.states(spark, sf_dir), _jobs(spark, sf_dir), settings)
    return report.select(
        *[c for c in report.columns if c not in ("last_settings", "last_run_at")],
        "last_settings.style",
        F.col("last_settings.workers").cast("string").alias("workers"),
        "last_run_at",
    )


@query(
    f"""SELECT book_id, 'plain' AS style, 3 AS workers FROM {_COUNTS}
        WHERE n_pending + n_crawled + n_error > 0
          AND book_id NOT IN (SELECT 'src' || s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0)"""
)
def default_settings(spark, sf_dir):
    """Settings for unfinished books without any that can be read."""
    known = st.parse_settings(_settings(spark, sf_dir)).filter("last_settings is not null")
    return st.default_settings(_counts(spark, sf_dir), known, style="plain", workers=3)


_HAS = "status IN ('translated', 'error') AS has_translated"


@query(f"SELECT book_id, index, n_chars > 0 AS has_raw, {_HAS} FROM {_C}")
def chapter_files(spark, sf_dir):
    """Which chapters have source and target texts."""
    chapters = ad.chapters(spark, sf_dir)
    key = ["book_id", "index"]
    raw = chapters.filter("n_chars > 0")
    done = chapters.filter(F.col("status").isin("translated", "error"))
    return st.chapter_files(chapters.select(*key), raw, done, key)


@query(
    f"""SELECT book_id, index, coalesce(max(CASE WHEN has_translated THEN index END) OVER (w ROWS BETWEEN UNBOUNDED
               PRECEDING AND 1 PRECEDING), 0) AS previous_index,
               coalesce(min(CASE WHEN has_translated THEN index END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED
               FOLLOWING), 0) AS next_index
        FROM (SELECT book_id, index, {_HAS} FROM {_C}) WINDOW w AS (PARTITION BY book_id ORDER BY index)"""
)
def adjacent_translated(spark, sf_dir):
    """Nearest readable chapters before and after each chapter, 0 where there is none."""
    chapters = ad.chapters(spark, sf_dir).select(
        "book_id", "index", F.col("status").isin("translated", "error").alias("has_translated")
    )
    return st.adjacent_translated(chapters).drop("has_translated").fillna(0)


@query(
    """WITH keyed AS (SELECT user_id, event_id * event_id * 7919 + event_id AS key, event_type = 'purchase' AS sold FROM events)
       SELECT user_id, key, row_number() OVER w AS place,
              max(CASE WHEN sold THEN key END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sold_before,
              min(CASE WHEN sold THEN key END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS sold_after
       FROM keyed WINDOW w AS (PARTITION BY user_id ORDER BY key)"""
)
def sparse_positions(spark, sf_dir):
    """Positions and nearest marked rows where the order column's numbers lie far apart."""
    event = F.col("event_id")
    rows = ad.table(spark, sf_dir, "events").select(
        "user_id", (event * event * 7919 + event).alias("key"), (F.col("event_type") == "purchase").alias("sold")
    )
    placed = number_rows(rows, "user_id", "key", "place", sparse=True)
    near = nearest_marked(placed, "user_id", "key", F.col("sold"), "sold_before", "sold_after", sparse=True)
    return near.drop("sold")


@query(
    f"""SELECT book_id, coalesce(min(CASE WHEN status = 'translated' AND n_chars > 1500 THEN index END), 1)
               AS first_index FROM {_C} GROUP BY book_id"""
)
def first_readable(spark, sf_dir):
    """First chapter of every book that can be read."""
    chapters = ad.chapters(spark, sf_dir).withColumn("has_translated", F.col("n_chars") > 1500)
    return st.first_readable(chapters)


@query(f"SELECT book_id, index, title_cn FROM {_C} WHERE title_vi IS NULL")
def untitled_chapters(spark, sf_dir):
    """Chapters whose title is still to be translated."""
    return st.untitled(ad.chapters(spark, sf_dir)).select("book_id", "index", "title_cn")


@query(
    """SELECT 'user' || user_id AS book_id, max(ts) AS updated_at FROM events GROUP BY user_id
       ORDER BY updated_at DESC LIMIT 3"""
)
def recent_books(spark, sf_dir):
    """The three books changed last."""
    events = ad.table(spark, sf_dir, "events")
    books = events.groupBy(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("book_id")).agg(
        F.max("ts").alias("updated_at"), F.min("ts").alias("created_at")
    )
    return st.recent_books(books).select("book_id", "updated_at")


@query(
    f"""SELECT index, book_id, status FROM {_C} WHERE index = 7"""
)
def chapter_lookup(spark, sf_dir):
    """One chapter of every book by its number."""
    return ad.chapters(spark, sf_dir).filter("index = 7").select("index", "book_id", "status")


_FIRST_LINE = "'Chương ' || CASE WHEN n_chars % 3 = 0 THEN n_chars ELSE index END || CASE WHEN n_chars % 2 = 0 THEN ': ' ELSE ' ' END || book_id"


@query(
    f"""SELECT *, new_line || chr(10) || 'body ' || index AS text FROM (
        SELECT book_id, index, first_line, 'Chương ' || index || CASE WHEN rest = '' THEN '' ELSE ': ' || rest END AS new_line
        FROM (SELECT book_id, index, n_chars, {_FIRST_LINE} AS first_line, book_id AS rest FROM {_C})
        WHERE n_chars % 3 = 0 AND n_chars <> index)"""
)
def title_mismatch(spark, sf_dir):
    """Texts whose first line has another number than the title, with the repaired line and text."""
    chapters = ad.chapters(spark, sf_dir)
    number = F.when(F.col("n_chars") % 3 == 0, F.col("n_chars")).otherwise(F.col("index"))
    joint = F.when(F.col("n_chars") % 2 == 0, F.lit(": ")).otherwise(F.lit(" "))
    line = F.concat(F.lit("Chương "), number.cast("string"), joint, F.col("book_id"))
    texts = chapters.select("book_id", "index", F.concat(line, F.lit("\nbody "), F.col("index").cast("string")).alias("text"))
    found = quality.title_mismatches(chapters, texts, ["book_id", "index"])
    return found.select("book_id", "index", "first_line", "new_line", "text")


@query(
    """SELECT doc_id, 'Chương ' || doc_id || ' ' || lang || ' ' || source AS title_vi FROM documents"""
)
def title_normalize(spark, sf_dir):
    """Titles brought into one form."""
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    number = F.col("doc_id").cast("string")
    joint = F.element_at(F.array(F.lit(":  "), F.lit(" – "), F.lit("-")), (F.col("doc_id") % 3 + 1).cast("int"))
    given = F.concat(F.lit("chương "), number, joint, F.col("lang"), F.lit("  　"), F.col("source"), F.lit(" "))
    source = F.concat(F.lit("第 "), number, F.lit(" 章 x"))
    return docs.select("doc_id", tx.normalize_title(given, source).alias("title_vi"))


@query(
    f"""SELECT book_id, index, CASE WHEN u THEN 'Chương ' || index || ' new' ELSE title_vi END AS title_vi,
               CASE WHEN u THEN 'translated' ELSE status END AS status,
               CASE WHEN u THEN TIMESTAMP '2024-02-01 00:00:00' END AS translated_at,
               CASE WHEN NOT u AND status = 'error' THEN 'failed' END AS error_message
        FROM (SELECT *, status = 'crawled' AS u FROM {_C})"""
)
def apply_chapter_updates(spark, sf_dir):
    """New titles put on the crawled chapters, which are translated then."""
    chapters = ad.chapters(spark, sf_dir)
    updates = chapters.filter("status = 'crawled'").select(
        "book_id", "index", F.lit("Chương new").alias("title_vi"), F.lit(None).cast("string").alias("title_cn")
    )
    number = F.col("index").cast("string")
    updates = updates.withColumn("title_cn", F.concat(F.lit("第"), number, F.lit("章")))
    updates = updates.withColumn("title_vi", F.concat(F.lit("Chương "), number, F.lit(" - new")))
    state = chapters.withColumn("error_message", F.when(F.col("status") == "error", "failed")).withColumn(
        "translated_at", F.lit(None).cast("timestamp")
    )
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return st.apply_chapter_updates(state, updates, now).select(
        "book_id", "index", "title_vi", "status", "translated_at", "error_message"
    )


@query(
    """SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago'
              ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm ago' END AS elapsed,
              CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago'
              WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago
       FROM (SELECT event_id, CAST(floor(1706745600 - epoch(ts)) AS BIGINT) AS s FROM events)"""
)
def elapsed_labels(spark, sf_dir):
    """Age of events in words, both forms."""
    seconds = F.lit(1706745600) - F.unix_micros(ad.utc(F.col("ts"))) / 1000000
    events = ad.table(spark, sf_dir, "events").select("event_id", seconds.alias("s"))
    return events.select(
        "event_id", elapsed_label(F.col("s")).alias("elapsed"), elapsed_label(F.col("s"), True).alias("ago")
    )


@query(
    f"""SELECT book_id, status, status IN ('running', 'pending') AS active, created_at FROM {_JOBS}
        ORDER BY created_at DESC"""
)
def job_list(spark, sf_dir):
    """Jobs, newest first, active ones marked."""
    from folioloom.operators import events as ev

    jobs = _jobs(spark, sf_dir).withColumn("job_id", F.col("book_id"))
    return ev.jobs_newest_first(ev.job_split(jobs)).drop("job_id")
