"""Tables from the file layouts of a book library.

``<library>/<book id>/book.json``, ``raw/NNNN_slug.txt``, ``translated/N.txt``,
``glossary.csv`` and ``last_pipeline_settings.json``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom import fixed_values as fixed
from folioloom.functions.text import non_empty
from folioloom.operators.ordering import keep_first
from folioloom.schemas import BOOK
from folioloom.session import gathered
from folioloom.sources.decode import decode_bytes, normalize_encoding


def _book_id(depth: int) -> Column:
    """Name of the folder ``depth`` levels above the file."""
    return F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1 - depth))


def scan_books(spark: SparkSession, library: str) -> DataFrame:
    """One row per book folder that has a book file; the folder name is the id."""
    books = spark.read.schema(BOOK).json(f"{library}/*/book.json", multiLine=True)
    return books.select(_book_id(1).alias("book_id"), "*")


def scan_chapters(books: DataFrame) -> DataFrame:
    """One row per chapter, with its place in the book's list."""
    return books.select("book_id", F.posexplode("chapters").alias("position", "chapter")).select(
        "book_id", "position", "chapter.*"
    )


def scan_texts(spark: SparkSession, library: str, folder: str = "raw") -> DataFrame:
    """Chapter files of a folder of every book; unreadable files are skipped.

    Folders are what is listed: a pattern that names files would make a path of each.
    """
    files = (
        spark.read.option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .option("pathGlobFilter", "*.txt")
        .text(f"{library}/*/{folder}", wholetext=True)
    )
    return gathered(files).select(
        _book_id(2).alias("book_id"),
        F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("file_name"),
        F.col("value").alias("text"),
    )


def chapter_key(file_name: Column) -> tuple[Column, Column]:
    """Chapter number of a file and the rank of its naming pattern (0 new, 1 old)."""
    new = non_empty(F.regexp_extract(file_name, r"^(0|[1-9][0-9]*)\.txt$", 1))
    old = non_empty(F.regexp_extract(file_name, r"^(\d{4,})_.*\.txt$", 1))
    return F.coalesce(new, old).cast("long"), F.when(new.isNotNull(), 0).when(old.isNotNull(), 1)


def keyed_texts(files: DataFrame) -> DataFrame:
    """One text per chapter: the file of the new pattern before one of the old."""
    index, rank = chapter_key(F.col("file_name"))
    known = files.withColumn("index", index).withColumn("_rank", rank).filter("index is not null")
    return keep_first(known, ["book_id", "index"], ["_rank", "file_name"]).drop("_rank")


def numeric_file_order(file_name: Column) -> Column:
    """Number of a file name, 999999 for other names; to sort by."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.coalesce(stem.try_cast("long"), F.lit(999999))


def scan_pages(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Page files as decoded text.

    Of a path that ends in a pattern of names, the folders are listed: as a pattern of files
    it would make a path of each.
    """
    folder, _, name = path.rpartition("/")
    reader = spark.read.format("binaryFile")
    files = reader.option("pathGlobFilter", name).load(folder) if folder and "*" in name else reader.load(path)
    return gathered(files).select(
        F.col("path").alias("url"),
        decode_bytes(F.col("content"), normalize_encoding(F.lit(encoding))).alias("html"),
    )


def read_glossary_csv(spark: SparkSession, path: str, empty_notes: bool = False) -> DataFrame:
    """Glossary rows in file order.

    A missing category column gives the default category, an empty cell stays empty.  Empty
    notes become null unless ``empty_notes``, the form for imports.  The ordinal follows the
    file name and the place in it.
    """
    rows = spark.read.option("header", "true").option("multiLine", "true").option(
        "escape", '"'
    ).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    missing = {"chinese", "vietnamese"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns missing in {path}: {sorted(missing)}")

    def column(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in rows.columns else default

    notes = column("notes", F.lit(""))
    # A quoted cell may hold line ends, so a file is read by one task and keeps its order there.
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    names = spark.read.format("binaryFile").load(path).select("_metadata.file_path")
    files = names.select("file_path", F.row_number().over(Window.orderBy("file_path")).alias("_file"))
    placed = rows.select("*", F.col("_metadata.file_path").alias("file_path"), inside.alias("_inside"))
    return placed.join(files, "file_path").select(
        F.coalesce("chinese", F.lit("")).alias("term"),
        F.coalesce("vietnamese", F.lit("")).alias("target"),
        column("category", F.lit(fixed.DEFAULT_CATEGORY)).alias("category"),
        (notes if empty_notes else non_empty(notes)).alias("notes"),
        (F.shiftleft((F.col("_file") - 1).cast("long"), 33) + F.col("_inside")).alias("ordinal"),
    )


def read_settings(spark: SparkSession, library: str) -> DataFrame:
    """Settings text of every book that has one."""
    files = spark.read.text(f"{library}/*/last_pipeline_settings.json", wholetext=True)
    return files.select(_book_id(1).alias("book_id"), F.col("value").alias("settings_json"))
