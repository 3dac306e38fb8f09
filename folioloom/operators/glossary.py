"""Edits, merges and reports over glossary tables.

Every glossary row has an ``ordinal``: its place in the list.  Stable sorts and cuts end
with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom import fixed_values as fixed
from folioloom.functions.arrays import each
from folioloom.functions.blocks import glossary_block
from folioloom.functions.replies import parse_entries
from folioloom.operators.ordering import keep_first
from folioloom.operators.terms import category_priority

_VALUES = ["target", "category", "notes"]


def upsert(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Merge changes (with ``seq``, their order) into a glossary.

    A known term keeps its place and takes the new values, a new one is appended; where a
    term is changed more than once the last change counts.
    """
    latest = changes.groupBy("term").agg(
        F.max_by(F.struct(*_VALUES), "seq").alias("_new"), F.min("seq").alias("_seq")
    )
    # One row per term of the base: its first place takes the change.
    places = base.groupBy("term").agg(F.min("ordinal").alias("_first"), F.max("ordinal").alias("_last"))
    end = F.coalesce(places.agg(F.max("_last")).scalar(), F.lit(0))
    seats = latest.join(places, "term", "left")
    new = [F.col(f"_new.{c}").alias(c) for c in _VALUES]
    changed = seats.select("term", F.coalesce("_first", end + 1 + F.col("_seq")).alias("ordinal"), *new)
    kept = base.join(changed.select("term", "ordinal"), ["term", "ordinal"], "left_anti")
    columns = ["term", *_VALUES, "ordinal"]
    return kept.select(*columns).unionByName(changed.select(*columns))


def import_rows(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Imported rows (read with empty notes kept) merged in their order."""
    return upsert(base, rows.withColumnRenamed("ordinal", "seq"))


def delete_terms(base: DataFrame, keys: DataFrame) -> DataFrame:
    """The glossary without any row of the given terms."""
    return base.join(keys.select("term"), "term", "left_anti")


def deleted_terms(base: DataFrame, keys: DataFrame) -> DataFrame:
    """For every given term whether the glossary had it."""
    had = base.select("term").distinct().withColumn("existed", F.lit(True))
    return (
        keys.select("term").distinct().join(had, "term", "left").fillna(False, subset=["existed"])
    )


def rename_terms(base: DataFrame, renames: DataFrame) -> DataFrame:
    """Rows under new terms (columns term, new_term and seq): removed, then merged anew."""
    moved = (
        base.join(renames.select("term", "new_term", "seq"), "term")
        .select(F.col("new_term").alias("term"), *_VALUES, "seq")
    )
    return upsert(delete_terms(base, renames), moved)


def new_terms(extracted: DataFrame, base: DataFrame, order: str | list[str] = "seq") -> DataFrame:
    """First occurrence of every extracted term that the glossary does not have."""
    return keep_first(extracted, "term", order).join(base.select("term"), "term", "left_anti")


def search(base: DataFrame, query: str = "", category: str = "") -> DataFrame:
    """Rows whose term has the query, or whose target has it in any case."""
    found = F.col("term").contains(query) | F.lower("target").contains(query.lower())
    if category:
        found = found & (F.col("category") == category)
    return base.filter(found)


def by_category(base: DataFrame, category: str) -> DataFrame:
    return base.filter(F.col("category") == category)


def lookup(base: DataFrame, term: str | Column) -> DataFrame:
    """The row of a term; of several the last one."""
    return (
        base.filter(F.col("term") == term)
        .groupBy("term")
        .agg(F.max_by(F.struct(*_VALUES, "ordinal"), "ordinal").alias("row"))
        .select("term", "row.*")
    )


def category_counts(base: DataFrame) -> DataFrame:
    return base.groupBy("category").agg(F.count(F.lit(1)).alias("n_terms"))


def priority_topk(base: DataFrame, limit: int) -> DataFrame:
    """The first rows by category order, then list order."""
    return (
        base.withColumn("priority", category_priority(F.col("category")))
        .orderBy("priority", "ordinal")
        .limit(limit)
    )


def glossary_text(base: DataFrame, limit: int = fixed.GLOSSARY_TERMS) -> DataFrame:
    """One row with the first entries by category order as a block without notes.

    A glossary of no more than ``limit`` entries keeps its own order within a category.
    """
    first = priority_topk(base, limit).select("ordinal", "term", *_VALUES)
    entries = F.array_sort(F.collect_list(F.struct("ordinal", "term", *_VALUES)))
    return first.agg(glossary_block(entries, notes=False).alias("block"))


def cap_entries(base: DataFrame, limit: int = fixed.GLOSSARY_TERMS) -> DataFrame:
    """The first rows in list order."""
    return base.orderBy("ordinal").limit(limit)


def shown_and_rest(base: DataFrame, limit: int = 50) -> DataFrame:
    """The first rows in list order, each with the number of rows not shown.

    Both read the same columns, so Spark makes the glossary once for the two.
    """
    place = F.col("ordinal")
    total = base.agg(F.count(place) + F.count_if(place.isNull())).scalar()
    return cap_entries(base, limit).withColumn("n_more", F.greatest(total - limit, F.lit(0)))


def known_terms_list(base: DataFrame, limit: int = fixed.KNOWN_TERMS_SHOWN) -> DataFrame:
    """One row with the first terms joined by commas."""
    first = cap_entries(base, limit).select("ordinal", "term")
    terms = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "term"))), lambda x: x["term"])
    joined = F.array_join(terms, ", ")
    return first.agg(
        F.when(joined == "", F.lit(fixed.NO_KNOWN_TERMS)).otherwise(joined).alias("known_terms")
    )


def sample_texts(
    docs: DataFrame,
    order: Column,
    text: str = "text",
    count: int = fixed.SAMPLE_COUNT,
    size: int = fixed.SAMPLE_SIZE,
    seed: int | None = None,
) -> DataFrame:
    """The first ``count`` texts by ``order``, or a seeded random choice; each cut to size."""
    place = order if seed is None else F.rand(seed)
    return docs.orderBy(place).limit(count).withColumn("sample", F.left(text, F.lit(size)))


def batches(samples: DataFrame, group: str, position: str, text: str = "sample", size: int = 5) -> DataFrame:
    """Texts of a group in batches of ``size`` by their 1-based position, joined in order."""
    parts = samples.withColumn("batch", F.floor((F.col(position) - 1) / size).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position), F.col(text))))
    return parts.groupBy(group, "batch").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.array_join(F.transform(ordered, lambda x: x[text]), fixed.SAMPLE_SEPARATOR).alias("combined"),
    )


def entries_per_batch(n_batches: Column, min_entries: Column | int) -> Column:
    wanted = F.lit(min_entries) if isinstance(min_entries, int) else min_entries
    share = F.floor(wanted / F.greatest(n_batches, F.lit(1)))
    return F.greatest(F.lit(10), share).cast("long")


def merge_extractions(
    replies: DataFrame,
    base: DataFrame,
    batch: str = "batch",
    reply: str = "reply",
    limit: int = fixed.GLOSSARY_TERMS,
) -> DataFrame:
    """Terms of all replies merged into a glossary.

    The first occurrence of a term counts, in the order of the batches; then the first
    ``limit`` terms are kept.
    """
    entries = replies.select(
        batch, F.posexplode(parse_entries(F.col(reply))).alias("place", "entry")
    ).select(batch, "place", "entry.*")
    first = keep_first(entries, "term", [batch, "place"]).orderBy(batch, "place").limit(limit)
    # At most `limit` rows are left here, so their numbering is small work.
    ordered = F.array_sort(F.collect_list(F.struct(batch, "place", "term", *_VALUES)))
    numbered = first.agg(ordered.alias("all")).select(F.posexplode(each("all")).alias("seq", "e"))
    changes = numbered.select(
        "e.term", *[F.col(f"e.{c}") for c in _VALUES], F.col("seq").cast("long")
    )
    return upsert(base, changes)


def grow_glossary(
    docs: DataFrame,
    base: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """New terms the extractor finds in texts.

    The extractor turns documents into rows (term, target, category, notes, seq).
    """
    return new_terms(extract(docs), base)
