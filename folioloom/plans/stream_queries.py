"""Queries that run a stream to its end and read what it wrote."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioloom import fixed_values as fixed
from folioloom.operators.glossary import grow_glossary, sample_texts
from folioloom.operators.ordering import keep_first
from folioloom.plans import adapters as ad
from folioloom.plans.page_queries import BODY_LINES, PLAIN_ARTICLE, PLAIN_TITLE
from folioloom.plans.registry import query
from folioloom.plans.text_queries import CHUNKS_SQL
from folioloom.session import work_folder
from folioloom.streaming import chapters, feeds, glossaries, progress, retries, states
from folioloom.streaming.tables import arrivals, landed, read_batches, read_stream, start, write_batch

_KINDS = ["chapter_crawled", "chapter_translated", "chapter_error"]


def chapter_changes(events):
    """State changes of chapters from events: job = book, k = chapter."""
    rows = events.select(
        F.col("user_id").cast("string").alias("book_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        *ad.event_fields(),
    )
    return rows.filter(F.col("type").isin(*_KINDS)).select(
        "book_id",
        F.col("chapter_index").alias("index"),
        F.regexp_replace("type", "^chapter_", "").alias("status"),
        F.get_json_object("data", "$.error").alias("error"),
        "ts",
        "seq",
    )


@query(
    """SELECT CAST(job_id AS VARCHAR) AS book_id, chapter_index AS index,
              arg_max(replace(type, 'chapter_', ''), ts) AS status,
              CASE WHEN arg_max(type, ts) = 'chapter_error' THEN 'e' || chapter_index END AS error_message,
              max(ts) FILTER (type = 'chapter_crawled') AS crawled_at,
              max(ts) FILTER (type = 'chapter_translated') AS translated_at
       FROM ("""
    + ad.EVENTS_SQL
    + """) WHERE type IN ('chapter_crawled', 'chapter_translated', 'chapter_error') GROUP BY job_id, chapter_index"""
)
def status_state_stream(spark, sf_dir):
    """Chapter states kept by a stream of changes."""
    folder = work_folder(spark, "states")
    changes = chapter_changes(read_stream(spark, f"{sf_dir}/events.parquet"))
    states.run_states(changes, f"{folder}/states", f"{folder}/checkpoint").awaitTermination()
    return states.current_states(spark, f"{folder}/states").drop("changed_at")


@query(
    "SELECT job_id, type, count(*) AS n, max(ts) AS last_ts FROM ("
    + ad.EVENTS_SQL
    + ") WHERE type <> 'heartbeat' GROUP BY job_id, type"
)
def event_log_stream(spark, sf_dir):
    """Event log appended by a stream, counted per job and type."""
    folder = work_folder(spark, "events")
    events = read_stream(spark, f"{sf_dir}/events.parquet").select(
        "event_id", "ts", F.col("user_id").alias("job_id"), *ad.event_fields()
    )
    feeds.run_event_log(events, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    log = spark.read.parquet(f"{folder}/log")
    return log.groupBy("job_id", "type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


# Title and text of every page: the article, or the body where that is short.
_PAGE_TEXTS = f"""SELECT page_id, title, CASE WHEN length(article) > 100 THEN article ELSE body END AS text
    FROM (SELECT page_id, {PLAIN_TITLE} AS title, {PLAIN_ARTICLE} AS article, {BODY_LINES} AS body FROM pages)"""
_PAGES_DONE = f"""
    WITH texts AS MATERIALIZED ({_PAGE_TEXTS}),
    documents AS (SELECT page_id AS doc_id, '' AS source, text FROM texts WHERE length(text) > 0),
    chunks AS (SELECT doc_id, count(*) AS n_chunks, md5(string_agg(main_text, chr(10) ORDER BY chunk_idx)) AS chunks_md5
               FROM ({CHUNKS_SQL}) GROUP BY doc_id)
    SELECT page_id, title, length(text) AS n_chars, CASE WHEN length(text) > 0 THEN 'crawled' ELSE 'error' END AS status,
           1 AS n_rows, coalesce(n_chunks, 0) AS n_chunks, chunks_md5
    FROM texts LEFT JOIN chunks ON doc_id = page_id"""


def _page_streams(spark, sf_dir, folder):
    """Pages as they arrive, and a third of them again, at another pace."""
    place, n_files = landed(spark, f"{sf_dir}/pages.parquet", f"{folder}/landing")
    once = read_stream(spark, place, files_per_batch=-(-n_files // 5))
    again = read_stream(spark, place, files_per_batch=-(-n_files // 3)).filter("page_id % 3 = 0")
    return once.union(again)


def _run_pages(spark, folder, stream, **options):
    return chapters.run_pages(
        stream, folder, f"{folder}/checkpoint", "article", "h1", ["script", "style"], ad.CHUNK, **options
    )


def _pages_done(spark, folder):
    """Every page with its state, how often its text was written, and its chunks."""
    rows = read_batches(spark, f"{folder}/texts", chapters.TEXTS)
    times = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_rows"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_idx", "main_text")))
    chunks = spark.read.parquet(f"{folder}/chunks").groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.md5(F.array_join(F.transform(ordered, lambda c: c["main_text"]), "\n")).alias("chunks_md5"),
    )
    texts = chapters.latest_texts(spark, folder)
    return texts.join(times, "page_id").join(chunks, "page_id", "left").select(
        "page_id",
        "title",
        F.length("text").cast("long").alias("n_chars"),
        "status",
        "n_rows",
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        "chunks_md5",
    )


@query(_PAGES_DONE)
def page_stream(spark, sf_dir):
    """Pages turned into texts and chunks by a stream in which a third arrive twice."""
    folder = work_folder(spark, "pages")
    _run_pages(spark, folder, _page_streams(spark, sf_dir, folder)).awaitTermination()
    return _pages_done(spark, folder)


class Stopped(RuntimeError):
    """Raised in the middle of a batch, as if its job had been lost."""


@query(_PAGES_DONE)
def resumed_pages_stream(spark, sf_dir):
    """The same stream, lost in its third batch between two tables and started again.

    Pages that would be left over are in the result as pending."""
    folder = work_folder(spark, "resumed")
    stream = _page_streams(spark, sf_dir, folder)

    def lose(batch_id):
        if batch_id == 2:
            raise Stopped("lost")

    try:
        _run_pages(spark, folder, stream, between=lose).awaitTermination()
    except StreamingQueryException as ended:
        if "Stopped: lost" not in str(ended):
            raise
    _run_pages(spark, folder, stream).awaitTermination()
    done = _pages_done(spark, folder)
    left = chapters.remaining(ad.table(spark, sf_dir, "pages").select("page_id"), done)
    return done.unionByName(left.withColumn("status", F.lit("pending")), allowMissingColumns=True)


_INTERVAL = 6 * 3600
_KIND_COUNTS = """count(*) AS events, count(*) FILTER (type = 'chapter_crawled') AS crawled,
    count(*) FILTER (type = 'chapter_translated') AS translated, count(*) FILTER (type = 'chapter_error') AS errors"""


@query(
    f"""SELECT job_id, ts, 'progress' AS type, '{{"events":' || events || ',"crawled":' || crawled || ',"translated":' ||
               translated || ',"errors":' || errors || '}}' AS data FROM (
          SELECT job_id, ts, {", ".join(f"CAST(sum({c}) OVER (PARTITION BY job_id ORDER BY ts) AS BIGINT) AS {c}" for c in progress.COUNTERS)}
          FROM (SELECT CAST(job_id AS VARCHAR) AS job_id,
                       make_timestamp(((epoch_us(ts) // {_INTERVAL * 10**6}) + 1) * {_INTERVAL * 10**6}) AS ts, {_KIND_COUNTS}
                FROM ({ad.EVENTS_SQL}) GROUP BY ALL))"""
)
def progress_events_stream(spark, sf_dir):
    """What every job had done by the end of every interval in which it had events."""
    folder = work_folder(spark, "progress")
    events = arrivals(spark, f"{sf_dir}/events.parquet", f"{folder}/landing").select(
        F.col("user_id").alias("job_id"), ad.utc(F.col("ts")).alias("ts"), *ad.event_fields()
    )
    # Files may come in any order, so an interval stays open for all the time the events span.
    run = progress.run_progress(
        events, f"{folder}/rows", f"{folder}/checkpoint", f"{_INTERVAL} seconds", late="400 days"
    )
    run.awaitTermination()
    return progress.progress_events(spark, f"{folder}/rows").select("job_id", "ts", "type", "data")


@query(f"SELECT {_KIND_COUNTS}, count(*) AS input_rows, true AS several_batches FROM ({ad.EVENTS_SQL})")
def batch_progress_stream(spark, sf_dir):
    """The counters that every micro-batch reported while it ran, added up."""
    folder = work_folder(spark, "batches")
    events = arrivals(spark, f"{sf_dir}/events.parquet", f"{folder}/landing").select(
        "event_id", "ts", F.col("user_id").alias("job_id"), *ad.event_fields()
    )
    log = progress.ProgressLog(spark, f"{folder}/progress")
    spark.streams.addListener(log)
    try:
        seen = progress.observed_batches(events, F.col("type"))
        run = feeds.run_event_log(seen, f"{folder}/log", f"{folder}/checkpoint")
        run.awaitTermination()
        log.wait(run)
    finally:
        spark.streams.removeListener(log)
    rows = progress.batch_progress(spark, f"{folder}/progress")
    sums = [F.sum(c).alias(c) for c in [*progress.COUNTERS, "input_rows"]]
    return rows.agg(*sums, (F.countDistinct("batch_id") > 1).alias("several_batches"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS job_id, 'heartbeat' AS type FROM events WHERE user_id % 4 <> 0")
def job_heartbeats_stream(spark, sf_dir):
    """Jobs that were sent a heartbeat: all that went silent, none of those that ended."""
    folder = work_folder(spark, "beats")
    kinds = F.when(F.col("user_id") % 4 == 0, "job_completed").otherwise("progress")
    columns = [F.col("user_id").alias("job_id"), kinds.alias("type")]
    table = ad.table(spark, sf_dir, "events")
    silent = table.filter("user_id % 4 <> 0").agg(F.countDistinct("user_id")).first()[0]
    beats = feeds.heartbeats(read_stream(spark, f"{sf_dir}/events.parquet").select(*columns), idle_seconds=2)

    def save(batch, batch_id):
        write_batch(batch, f"{folder}/rows", batch_id)

    run = start(beats.writeStream.foreachBatch(save), f"{folder}/checkpoint", seconds=1)
    try:
        # However long it takes: a batch that fails ends the stream, and that is raised here.
        while not run.awaitTermination(1):
            rows = read_batches(spark, f"{folder}/rows", feeds.BEATS).select("job_id", "type").distinct()
            if rows.count() >= silent:
                break
    finally:
        run.stop()
    return read_batches(spark, f"{folder}/rows", feeds.BEATS).select("job_id", "type").distinct()


def _reply(doc_id, text, attempt):
    """Every fifth document fails once, every 35th whenever it is tried."""
    if doc_id % 35 == 0 or (doc_id % 5 == 0 and attempt == 1):
        raise ValueError("no reply")
    return f"{len(text)} characters"


@query(
    """SELECT doc_id, CASE WHEN doc_id % 35 <> 0 THEN length(text) || ' characters' END AS value,
              CASE WHEN doc_id % 35 = 0 THEN 'ValueError: no reply' END AS error,
              CASE WHEN doc_id % 35 = 0 THEN 'error' ELSE 'translated' END AS status,
              CASE WHEN doc_id % 35 = 0 THEN 3 WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS attempts FROM documents"""
)
def retry_stream(spark, sf_dir):
    """Documents worked on by a function that fails; what failed is taken up by a later batch."""
    folder = work_folder(spark, "retries")
    docs = arrivals(spark, f"{sf_dir}/documents.parquet", f"{folder}/landing").select("doc_id", "text")
    step, key = retries.guarded(_reply), docs.schema["doc_id"]
    retries.run_retrying(docs, "doc_id", step, folder, f"{folder}/checkpoint").awaitTermination()
    retries.retry_rest(spark, key, step, folder)
    return retries.results(spark, key, folder)


_DELIVERIES, _REFRESH = 5, 2


def _frequent_words(docs):
    """The extractor of these queries: SQL and Spark differ in the upper case of some letters."""
    found = glossaries.frequent_words(docs)
    return found.withColumn("target", F.concat(F.lit("VI "), F.col("term")))


def _growth(spark, sf_dir, with_stats):
    """A glossary grown while ids of documents are delivered, a fifth at a time.

    The stream carries ids alone; texts are read where they lie.  Every delivery is a run on
    the same checkpoint."""
    folder = work_folder(spark, "terms")
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", "text")
    words = ad.extracted_terms(spark, sf_dir)
    base = keep_first(words, "term", "seq").select("term", "target", "category", "notes")

    def delivered():
        return docs.join(spark.read.parquet(f"{folder}/ids"), "doc_id", "left_semi")

    for k in range(_DELIVERIES):
        ids = docs.select("doc_id").filter(F.col("doc_id") % _DELIVERIES == k)
        ids.write.mode("append").parquet(f"{folder}/ids")
        run = glossaries.run_growth(
            read_stream(spark, f"{folder}/ids"),
            folder,
            f"{folder}/checkpoint",
            base,
            extract=lambda batch: _frequent_words(docs.join(batch, "doc_id", "left_semi")),
            all_docs=delivered if with_stats else None,
            refresh=_REFRESH,
        )
        run.awaitTermination()
    return folder


_BASE_TERMS = f"(SELECT term FROM ({ad.EXTRACTED_SQL}) GROUP BY term)"
_GROWN = f"""
    (SELECT term, 'VI ' || term AS target, 'general' AS category, CAST(NULL AS VARCHAR) AS notes,
            dense_rank() OVER (ORDER BY delivery) AS version, delivery
     FROM (SELECT term, min(doc_id % {_DELIVERIES}) AS delivery FROM (
             SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS place
             FROM (SELECT doc_id, term, count(*) AS n FROM (
                     SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term
                     FROM documents) WHERE length(term) >= 6 GROUP BY doc_id, term))
           WHERE place <= {fixed.NEW_TERMS_PER_TEXT} AND term NOT IN (SELECT term FROM {_BASE_TERMS}) GROUP BY term))"""


@query(f"SELECT term, target, category, notes, version FROM {_GROWN}")
def progressive_terms_stream(spark, sf_dir):
    """New terms of every version of a glossary grown by a stream."""
    folder = _growth(spark, sf_dir, with_stats=False)
    rows = read_batches(spark, f"{folder}/terms", glossaries.TERMS)
    # One number for each batch that added terms.
    versions = rows.select("batch_id").distinct().withColumn(
        "version", F.row_number().over(Window.orderBy("batch_id")).cast("long")
    )
    return rows.join(versions, "batch_id").select("term", "target", "category", "notes", "version")


@query(
    f"""WITH grown AS MATERIALIZED (SELECT * FROM {_GROWN}),
        fits AS (SELECT version, max(delivery) AS delivery FROM grown GROUP BY version HAVING version % {_REFRESH} = 0),
        listed AS (SELECT f.version, f.delivery, t.term FROM fits f,
                   (SELECT term, 0 AS since FROM {_BASE_TERMS} UNION ALL SELECT term, version FROM grown) t WHERE since <= f.version),
        counted AS (SELECT term, doc_id % {_DELIVERIES} AS delivery, count(*) AS n
                    FROM (SELECT DISTINCT term FROM listed) JOIN documents ON contains(text, term) GROUP BY ALL),
        sizes AS (SELECT f.version, count(*) AS n_docs FROM fits f JOIN documents ON doc_id % {_DELIVERIES} <= f.delivery GROUP BY f.version),
        found AS (SELECT l.version, l.term, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS df
                  FROM listed l LEFT JOIN counted c ON c.term = l.term AND c.delivery <= l.delivery GROUP BY ALL)
        SELECT version, term, df, n_docs,
               CASE WHEN df > 0 THEN round(ln((n_docs + 1) / (df + 1)) + 1, 6) ELSE 0 END AS idf
        FROM found JOIN sizes USING (version)"""
)
def scorer_refresh_stream(spark, sf_dir):
    """Statistics of every second version of the growing glossary, each from those before."""
    folder = _growth(spark, sf_dir, with_stats=True)
    stats = spark.read.option("basePath", f"{folder}/stats").parquet(f"{folder}/stats")
    return stats.select(F.col("version").cast("long").alias("version"), "term", "df", "n_docs", F.round("idf", 6).alias("idf"))


@query(
    f"""SELECT term, 'VI ' || term AS target, 'general' AS category, CAST(NULL AS VARCHAR) AS notes FROM (
          SELECT DISTINCT term FROM (
            SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS place
            FROM (SELECT doc_id, term, count(*) AS n FROM (
                    SELECT doc_id, unnest(regexp_extract_all(lower(left(text, {fixed.SAMPLE_SIZE})), '[\\p{{L}}\\p{{N}}_]+')) AS term
                    FROM (FROM documents ORDER BY doc_id LIMIT {fixed.SAMPLE_COUNT})) WHERE length(term) >= 6 GROUP BY doc_id, term))
          WHERE place <= {fixed.NEW_TERMS_PER_TEXT})"""
)
def first_glossary_stage(spark, sf_dir):
    """The starting glossary: made from samples of the texts, as there is none yet."""

    def make(docs):
        samples = sample_texts(docs, F.col("doc_id")).select("doc_id", F.col("sample").alias("text"))
        empty = spark.createDataFrame([], glossaries.TERMS)
        return grow_glossary(samples, empty, _frequent_words).select(*glossaries.TERMS.fieldNames())

    docs = ad.table(spark, sf_dir, "documents").select("doc_id", "text")
    return glossaries.first_glossary(docs, spark.createDataFrame([], glossaries.TERMS), make)


@query(f"SELECT count(*) AS rows, count(*) FILTER (status = 'error') AS errors FROM ({ad.CHAPTERS_SQL})")
def observed_progress(spark, sf_dir):
    """Counters that a step reports while its rows are written."""
    rows, counters = chapters.observed(ad.states(spark, sf_dir))
    rows.write.parquet(f"{work_folder(spark, 'observed')}/rows")
    return spark.createDataFrame([tuple(counters.get.values())], "rows long, errors long")
