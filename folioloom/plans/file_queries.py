"""Queries that write files or tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.operators import glossary as gl
from folioloom.operators import styles as sy
from folioloom.operators.ordering import number_rows
from folioloom.plans import adapters as ad
from folioloom.plans.registry import query
from folioloom.plans.stream_queries import chapter_changes
from folioloom.session import work_folder
from folioloom.sources import readers, statelog, writers
from folioloom.sources.decode import decode_bytes, normalize_encoding
from folioloom.sources.library import Library

#: Chapters of one book folder; a source of more is several volumes.
VOLUME = 1000
_VOLUME = f"book_id || '-' || ((index - 1) // {VOLUME})"
_VOLUMES = f"(SELECT *, {_VOLUME} AS volume FROM ({ad.CHAPTERS_SQL}))"


def _volumes(spark, sf_dir, with_text=False):
    chapters = ad.chapters(spark, sf_dir, with_text=with_text)
    part = F.floor((F.col("index") - 1) / VOLUME).cast("string")
    return chapters.withColumn("book_id", F.concat_ws("-", "book_id", part))


@query(
    f"""SELECT volume AS book_id, index, length(body) AS n_chars, md5(body) AS body_md5, true AS same_by_scan
        FROM (SELECT volume, index, '# ' || title_cn || chr(10) || chr(10) || text AS body FROM {_VOLUMES})"""
)
def library_round_trip(spark, sf_dir):
    """Raw chapter files of every book written and read as a library, and by Spark's own text scan."""
    spark.dataSource.register(Library)
    library = f"{work_folder(spark, 'library')}"
    chapters = _volumes(spark, sf_dir, with_text=True)
    files = chapters.select(
        "book_id",
        writers.raw_file_name(F.col("index"), F.col("title_cn")).alias("file_name"),
        writers.raw_body(F.col("title_cn"), F.col("text")).alias("text"),
    )
    files.write.format("book_library").option("folder", "raw").mode("append").save(library)
    read = spark.read.format("book_library").option("folder", "raw").load(library)
    # Digests are made where a file is read; texts are not sorted.
    facts = [F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("body_md5")]
    keyed = readers.keyed_texts(read.select("book_id", "file_name", *facts))
    scan = readers.scan_texts(spark, library).select("book_id", "file_name", F.md5("text").alias("_scan"))
    scanned = readers.keyed_texts(scan).select("book_id", "index", "_scan")
    return keyed.join(scanned, ["book_id", "index"], "left").select(
        "book_id",
        "index",
        "n_chars",
        "body_md5",
        F.coalesce(F.col("_scan") == F.col("body_md5"), F.lit(False)).alias("same_by_scan"),
    )


@query(
    f"""SELECT volume AS book_id, index, row_number() OVER (PARTITION BY volume ORDER BY index) - 1 AS position,
               title_cn, title_vi, status, 'T ' || volume AS title FROM {_VOLUMES}"""
)
def library_books(spark, sf_dir):
    """Book files with their chapters, written and scanned."""
    spark.dataSource.register(Library)
    library = f"{work_folder(spark, 'books')}"
    fields = ["index", "title_cn", "title_vi", "status"]
    listed = F.array_sort(F.collect_list(F.struct(*fields))).alias("chapters")
    books = _volumes(spark, sf_dir).groupBy("book_id").agg(listed)
    content = F.to_json(F.struct(F.concat(F.lit("T "), F.col("book_id")).alias("title"), "chapters"))
    files = books.select("book_id", F.lit("book.json").alias("file_name"), content.alias("text"))
    files.write.format("book_library").option("folder", "").mode("append").save(library)
    scanned = readers.scan_books(spark, library)
    titles = scanned.select("book_id", "title")
    chapters = readers.scan_chapters(scanned).select("book_id", "position", *fields)
    return chapters.join(titles, "book_id").withColumn("position", F.col("position").cast("long"))


@query(
    f"""SELECT book_id, index, length(text) AS n_chars, md5(text) AS text_md5 FROM ({ad.CHAPTERS_SQL})
        WHERE status = 'translated'"""
)
def written_translations(spark, sf_dir):
    """Target texts written under their file names and read back by their keys."""
    folder = f"{work_folder(spark, 'translations')}/vi"
    chapters = ad.chapters(spark, sf_dir, with_text=True).filter("status = 'translated'")
    writers.write_translations(chapters.select("book_id", "index", "text"), folder)
    read = spark.read.parquet(folder).select("book_id", "file_name", "text")
    return readers.keyed_texts(read).select(
        "book_id", "index", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5")
    )


@query(
    """SELECT CAST(job_id AS VARCHAR) AS book_id, chapter_index AS index,
              arg_max(replace(type, 'chapter_', ''), ts) AS status,
              CASE WHEN arg_max(type, ts) = 'chapter_error' THEN 'e' || chapter_index END AS error_message,
              max(ts) FILTER (type = 'chapter_crawled') AS crawled_at,
              max(ts) FILTER (type = 'chapter_translated') AS translated_at, true AS stamped
       FROM ("""
    + ad.EVENTS_SQL
    + """) WHERE type IN ('chapter_crawled', 'chapter_translated', 'chapter_error') GROUP BY job_id, chapter_index"""
)
def state_log(spark, sf_dir):
    """Chapter states from a log of five appends with two snapshots, written as books and read."""
    folder = work_folder(spark, "state-log")
    changes = chapter_changes(ad.table(spark, sf_dir, "events"))
    for k in range(5):
        statelog.append_states(changes.filter(F.col("seq") % 5 == k), folder, k)
        if k in (1, 3):
            statelog.compact(spark, folder)
    states = statelog.read_states(spark, folder).drop("changed_at", "seq")
    books = states.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chapters"))
    writers.write_books(books, states, f"{folder}/library")
    stamps = spark.read.parquet(f"{folder}/library/books").select("book_id", F.col("updated_at").isNotNull().alias("stamped"))
    return spark.read.parquet(f"{folder}/library/chapters").join(stamps, "book_id")


@query(
    f"""SELECT term, target, category, notes, row_number() OVER (ORDER BY ordinal) AS place FROM ({ad.CORPUS_GLOSSARY_SQL})"""
)
def glossary_csv_round_trip(spark, sf_dir):
    """A glossary written as ordered CSV files and read back in its order."""
    folder = f"{work_folder(spark, 'glossary')}/csv"
    writers.write_glossary_csv(ad.corpus_glossary(spark, sf_dir), folder)
    read = readers.read_glossary_csv(spark, folder)
    # The ordinal holds file and place; the rank in it is what the list's order was.
    ranked = number_rows(read.withColumn("_all", F.lit(0)), "_all", "ordinal", "place", sparse=True)
    return ranked.select("term", "target", "category", "notes", "place")


@query(
    f"""WITH base AS ({ad.CORPUS_GLOSSARY_SQL}),
        given AS (SELECT term, target, category, notes, seq, row_number() OVER (PARTITION BY term ORDER BY seq DESC) AS newest
                  FROM ({ad.EXTRACTED_SQL}))
        SELECT term, target, category, notes FROM base WHERE term NOT IN (SELECT term FROM given)
        UNION ALL SELECT term, target, category, notes FROM given WHERE newest = 1"""
)
def glossary_import(spark, sf_dir):
    """Rows of an uploaded CSV merged into a glossary: known terms take its values."""
    folder = f"{work_folder(spark, 'import')}/csv"
    given = ad.extracted_terms(spark, sf_dir).withColumnRenamed("seq", "ordinal")
    writers.write_glossary_csv(given, folder)
    rows = readers.read_glossary_csv(spark, folder, empty_notes=True)
    merged = gl.import_rows(ad.corpus_glossary(spark, sf_dir), rows)
    return merged.select("term", "target", "category", "notes")


@query(
    """SELECT CASE WHEN p_partkey % 7 = 0 THEN 'style' || p_partkey ELSE p_name || p_partkey END AS name,
              CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS description,
              CASE WHEN p_partkey % 7 = 0 THEN '' ELSE lower(p_brand) END AS tone,
              CASE WHEN p_partkey % 7 <> 0 THEN 2 END AS n_guidelines, CASE WHEN p_partkey % 7 <> 0 THEN p_mfgr END AS mfgr
       FROM (SELECT *, p_brand AS p_mfgr FROM part)"""
)
def style_table(spark, sf_dir):
    """Styles from files of JSON; one that can't be read is listed under its file's name."""
    parts = ad.table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    body = F.to_json(
        F.struct(
            F.concat("p_name", key).alias("name"),
            F.col("p_type").alias("description"),
            F.lower("p_brand").alias("tone"),
            F.array(F.lit("a"), F.lit("b")).alias("guidelines"),
            F.create_map(F.lit("maker"), F.col("p_brand")).alias("vocabulary"),
        )
    )
    text = F.when(F.col("p_partkey") % 7 == 0, F.lit("{broken")).otherwise(body)
    files = parts.select(F.concat(F.lit("style"), key).alias("stem"), text.alias("style_json"))
    styles = sy.parse_styles(files)
    return styles.select(
        "name",
        "description",
        "tone",
        F.when(F.col("guidelines").isNotNull(), F.size("guidelines")).cast("long").alias("n_guidelines"),
        F.try_element_at("vocabulary", F.lit("maker")).alias("mfgr"),
    )


@query("SELECT doc_id, length(text) AS n_chars, md5(text) AS html_md5 FROM documents")
def page_files(spark, sf_dir):
    """Texts as page files, scanned as bytes and decoded."""
    spark.dataSource.register(Library)
    folder = work_folder(spark, "page-files")
    name = F.col("doc_id").cast("string")
    group = F.concat(F.lit("site"), (F.col("doc_id") % 16).cast("string"))
    files = ad.documents(spark, sf_dir).select(
        group.alias("book_id"), F.concat(name, F.lit(".html")).alias("file_name"), "text"
    )
    files.write.format("book_library").option("folder", "pages").mode("append").save(folder)
    pages = readers.scan_pages(spark, f"{folder}/*/pages/*.html")
    return pages.select(
        F.regexp_extract("url", r"([0-9]+)\.html$", 1).cast("long").alias("doc_id"),
        F.length("html").cast("long").alias("n_chars"),
        F.md5("html").alias("html_md5"),
    )


# Bytes (hex), label, and what they are: GBK, GB18030 only, UTF-8, Latin-1 only, each under labels
# that fit and that do not, and bytes that the label's codec takes though another was meant.
_ENCODED = [
    ("D6D0CEC4", "gb2312", "中文"),
    ("D6D0CEC4", "utf-8", "中文"),
    ("D2BB8139EE39", "gbk", "一㐀"),
    ("D2BB8139EE39", "ascii", "一㐀"),
    ("E4B8ADE69687C384E5AD97", "utf-8", "中文Ä字"),
    ("E4B8ADE69687C384E5AD97", None, "中文Ä字"),
    ("E4B8ADE69687C384E5AD97", "ascii", "中文Ä字"),
    ("E9FF74E9", "utf-8", "éÿté"),
    ("E9FF74E9", "latin-1", "éÿté"),
    ("D6D0CEC4", "latin-1", "ÖÐÎÄ"),
    ("", "gbk", ""),
    ("6162", "no such label", "ab"),
]


@query(
    "SELECT doc_id, decoded AS text FROM documents JOIN (VALUES "
    + ", ".join(f"({k}, '{text}')" for k, (_, _, text) in enumerate(_ENCODED))
    + f") AS e(k, decoded) ON k = doc_id % {len(_ENCODED)}"
)
def decoded_labels(spark, sf_dir):
    """Bytes of several encodings under right, wrong, missing and unknown labels."""
    rows = spark.createDataFrame([(k, data, label) for k, (data, label, _) in enumerate(_ENCODED)], "k long, hex string, label string")
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % len(_ENCODED)).alias("k"))
    label = normalize_encoding(F.col("label"))
    return docs.join(rows, "k").select("doc_id", decode_bytes(F.unhex("hex"), label).alias("text"))
