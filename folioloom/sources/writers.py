"""Files and tables from DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions.text import pad_key, slugify


def raw_file_name(index: Column, title: Column) -> Column:
    return F.concat(pad_key(index), F.lit("_"), slugify(title), F.lit(".txt"))


def raw_body(title: Column, text: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), text)


def write_raw_chapters(chapters: DataFrame, path: str) -> None:
    """Raw chapters (book_id, index, title_cn, text) as a table of keyed files, by book."""
    files = chapters.select(
        "book_id",
        "index",
        raw_file_name(F.col("index"), F.col("title_cn")).alias("file_name"),
        raw_body(F.col("title_cn"), F.col("text")).alias("text"),
    )
    files.write.mode("overwrite").partitionBy("book_id").parquet(path)


def write_translations(texts: DataFrame, path: str) -> None:
    """Target texts (book_id, index, text) under their new file names, by book."""
    files = texts.select(
        "book_id", "index", F.concat(F.col("index").cast("string"), F.lit(".txt")).alias("file_name"), "text"
    )
    files.write.mode("overwrite").partitionBy("book_id").parquet(path)


def write_glossary_csv(glossary: DataFrame, path: str, one_file: bool = False) -> None:
    """Glossary as CSV in list order, null notes empty.

    Files are ordered by name, and are read back in that order.  ``one_file`` is for lists of a
    size people edit.
    """
    rows = glossary.orderBy("ordinal").select(
        F.col("term").alias("chinese"),
        F.col("target").alias("vietnamese"),
        "category",
        F.coalesce("notes", F.lit("")).alias("notes"),
    )
    rows = rows.coalesce(1) if one_file else rows
    rows.write.mode("overwrite").option("escape", '"').option("emptyValue", "").csv(path, header=True)


def write_books(books: DataFrame, chapters: DataFrame, path: str) -> None:
    """Books with their current chapters, as tables next to each other.

    Chapters stay rows: a book with very many chapters would not fit one nested value.
    """
    books.withColumn("updated_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/books")
    chapters.write.mode("overwrite").parquet(f"{path}/chapters")


def write_parts(parts: DataFrame, path: str) -> None:
    """Segments of assembled books, ordered inside their files."""
    order = [c for c in ("path", "part", "segment") if c in parts.columns]
    parts.repartitionByRange("book_id", *order).sortWithinPartitions("book_id", *order).write.mode(
        "overwrite"
    ).parquet(path)
