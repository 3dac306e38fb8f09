"""Checks and repairs of finished texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom import fixed_values as fixed
from folioloom.functions.text import non_empty, replace_words, strip, word_tokens


def leak_report(
    docs: DataFrame, key: str, text: str = "text", words: Mapping[str, str] = fixed.LEAKED_WORDS
) -> DataFrame:
    """Matches per document and listed word, with the replacement.

    The words of a text are counted as they are: no replacement makes or breaks another
    listed word.
    """
    listed = F.array(*[F.lit(w) for w in words])
    found = docs.select(
        key,
        F.explode(F.filter(word_tokens(F.col(text)), lambda w: F.array_contains(listed, w))).alias("word"),
    )
    targets = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return (
        found.groupBy(key, "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("replacement", targets[F.col("word")])
    )


def flag_report(
    docs: DataFrame,
    key: str,
    text: str = "text",
    words: Mapping[str, str] = fixed.LEAKED_WORDS,
    flags: Sequence[str] = tuple(fixed.FLAG_WORDS),
) -> DataFrame:
    """Per document: replaced words, one count per flagged word, and whether it needs a look.

    Everything is counted inside the row; no shuffle.
    """
    listed = F.array(*[F.lit(w) for w in words])
    flagged = F.array(*[F.lit(w) for w in flags])
    # One pass keeps the few words that matter; they are then told apart.
    found = docs.select(
        key,
        F.filter(
            word_tokens(F.col(text)),
            lambda w: F.array_contains(listed, w) | F.array_contains(flagged, F.lower(w)),
        ).alias("_words"),
    )

    def count_of(word: str) -> Column:
        return F.size(F.filter("_words", lambda w: F.lower(w) == word)).cast("long")

    return found.select(
        key,
        F.size(F.filter("_words", lambda w: F.array_contains(listed, w))).cast("long").alias("n_replaced"),
        *[count_of(word).alias(f"n_{word}") for word in flags],
        (F.size("_words") > 0).alias("flagged"),
    )


def report_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if("flagged").alias("n_flagged"),
        F.sum("n_replaced").alias("n_replaced"),
    )


def sanitize(
    docs: DataFrame,
    text: str = "text",
    words: Mapping[str, str] = fixed.LEAKED_WORDS,
    dry_run: bool = False,
) -> DataFrame:
    """Texts with the listed words replaced; a dry run keeps them and only says which change."""
    done = docs.withColumn("_clean", replace_words(F.col(text), words))
    done = done.withColumn("modified", F.col("_clean") != F.col(text))
    return done.drop("_clean") if dry_run else done.withColumn(text, F.col("_clean")).drop("_clean")


def repaired_first_line(first_line: Column, title_cn: Column, word: str = fixed.CHAPTER_WORD) -> Column:
    """First line with the number of the source title; null where the numbers agree or are missing."""
    number = non_empty(F.regexp_extract(title_cn, r"第(\p{Nd}+)章", 1))
    own = non_empty(F.regexp_extract(first_line, rf"{word}[\s\p{{Z}}]+(\p{{Nd}}+)", 1))
    after_colon = F.regexp_replace(first_line, r"^[^:]*:", "")
    after_words = F.coalesce(F.get(F.split(first_line, " ", 3), F.lit(2)), F.lit(""))
    rest = strip(F.when(first_line.contains(":"), after_colon).otherwise(after_words))
    head = F.concat(F.lit(f"{word} "), number)
    return F.when(
        number != own, F.when(rest == "", head).otherwise(F.concat(head, F.lit(": "), rest))
    )


def title_mismatches(chapters: DataFrame, texts: DataFrame, key: list[str], dry_run: bool = False) -> DataFrame:
    """Texts whose first line has another chapter number than the source title, repaired."""
    joined = chapters.select(*key, "title_cn").join(texts.select(*key, "text"), key)
    raw_line = F.regexp_extract("text", r"^[^\n]*", 0)
    found = joined.withColumn("first_line", strip(raw_line))
    found = found.withColumn("new_line", repaired_first_line(F.col("first_line"), F.col("title_cn")))
    found = found.filter(F.col("new_line").isNotNull())
    if dry_run:
        return found.drop("text")
    ending = F.when(raw_line.endswith("\r"), F.lit("\r")).otherwise(F.lit(""))
    rest = F.substring(F.col("text"), F.length(raw_line) + 1, F.length("text"))
    return found.withColumn("text", F.concat(F.col("new_line"), ending, rest))
