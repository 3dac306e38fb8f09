"""Finding glossary terms in texts, scoring and ranking them, and annotating the texts.

Terms are found by a join: the terms with those character sequences of the texts that a table
of all terms' hashes lets through, an equi-join.  This holds for glossaries of every size; the
table is made by a job of its own while the search is planned.  Who knows that a glossary is small may say so by ``small``: it
then becomes one constant array (a scalar subquery), and every text is searched inside its own
row, without join or shuffle.  Arguments and results are the same either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioloom import fixed_values as fixed
from folioloom.functions import sequences
from folioloom.functions.text import occurrences
from folioloom.operators.ordering import first_rows

SMALL_GLOSSARY = 256


def is_small(glossary: DataFrame, limit: int = SMALL_GLOSSARY) -> bool:
    """True where the glossary has at most ``limit`` rows; reads no more than that.

    This runs a job; no function here calls it.  Ask once for the plain glossary and pass the
    answer on as ``small``, also for the fitted glossary made from it.
    """
    return glossary.limit(limit + 1).count() <= limit


def category_priority(category: Column) -> Column:
    """Place of a category in the fixed order, 99 for unknown ones."""
    place = F.array_position(F.array(*[F.lit(c) for c in fixed.CATEGORIES]), category)
    return (
        F.when(place > 0, place - 1).otherwise(F.lit(fixed.UNKNOWN_CATEGORY_PRIORITY)).cast("long")
    )


def with_entries(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """Add the whole of a small glossary, in its order, as the constant array ``_entries``.

    A larger one is refused, whatever the caller said about it.
    """
    order = sorted(glossary.columns, key=lambda c: c != "ordinal")
    entries = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order])))
    too_many = F.raise_error(F.lit(f"more than {SMALL_GLOSSARY} glossary rows: pass small=False"))
    entries = F.when(F.count(F.lit(1)) > SMALL_GLOSSARY, too_many).otherwise(entries)
    # One row more than allowed is enough to refuse it: no more is gathered.
    few = glossary.limit(SMALL_GLOSSARY + 1)
    return texts.withColumn("_entries", few.agg(entries.alias("entries")).scalar())


def present(text: Column, entries: Column) -> Column:
    """The entries whose term occurs in the text."""
    return F.filter(entries, lambda e: (e["term"] != "") & F.contains(text, e["term"]))


def _texts(column: pa.Array) -> list[str]:
    """Texts of a column, null ones empty."""
    return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def listed_places(glossary: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The table of listed sequences as bits, and the lengths of the terms.

    Tasks make it, so the driver gets half a megabyte and the lengths, whatever the glossary.
    """

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lengths = np.zeros(sequences.PLACES, bool), set()
        for batch in batches:
            places, sizes = sequences.places_of(_texts(batch.column(0)))
            table[places] = True
            lengths |= sizes
        words = np.packbits(table, bitorder="little").view("<i8")
        used = np.flatnonzero(words)
        # Lengths go as negative numbers of words.
        numbers = np.r_[used, -np.array(sorted(lengths), np.int64)].astype(np.int64)
        bits = np.r_[words[used], np.zeros(len(lengths), np.int64)].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(bits)], ["word", "bits"])

    parts = glossary.filter("term != ''").select("term").mapInArrow(note, "word long, bits long")
    noted = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    numbers, bits = (noted.column(c).to_numpy() for c in ("word", "bits"))
    words = np.zeros(sequences.PLACES // 64, "<i8")
    words[numbers[numbers >= 0]] = bits[numbers >= 0]
    return words.view(np.uint8), sorted((-numbers[numbers < 0]).tolist())


def listed_pairs(texts: DataFrame, glossary: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per text and entry whose term occurs in it, with tf: (key, entry columns, tf).

    A text is read once, in the task that has it: all stretches of the lengths that terms have
    are looked up in the table of listed ones, and each that is there leaves the task as one row
    with its count.  What is shuffled grows with the matches, and no text meets its terms one by
    one.  The join with the terms by equality settles what is a term.
    """
    bits, lengths = listed_places(glossary)
    schema = T.StructType(
        [
            *[texts.schema[c] for c in key],
            T.StructField("term", T.StringType()),
            T.StructField("tf", T.LongType()),
        ]
    )
    names = schema.fieldNames()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits, bitorder="little").view(bool)
        for batch in batches:
            keys = [batch.column(i) for i in range(len(key))]
            for first, some in sequences.sliced(_texts(batch.column(len(key)))):
                for numbers, found, counts in sequences.count_listed(some, table, lengths):
                    rows = pa.array(numbers + first)
                    columns = [*[k.take(rows) for k in keys], pa.array(found, pa.string()), pa.array(counts, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    found = texts.select(*key, text).mapInArrow(search, schema)
    return found.join(glossary, "term").select(*key, *glossary.columns, "tf")


def document_counts(docs: DataFrame, glossary: DataFrame, text: str) -> DataFrame:
    """In how many documents each term occurs: (term, _df), of terms that one has.

    The search of ``listed_pairs``, but the task adds up the documents of an Arrow batch, so a
    term leaves it once for all of them.  A few sequences that no term is may be among them.
    """
    bits, lengths = listed_places(glossary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits, bitorder="little").view(bool)
        for batch in batches:
            counts: dict[str, int] = {}
            for _, some in sequences.sliced(_texts(batch.column(0))):
                for found, numbers in sequences.count_texts(some, table, lengths):
                    for term, n in zip(found, numbers.tolist()):
                        counts[term] = counts.get(term, 0) + n
            columns = [pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "n"])

    found = docs.select(text).mapInArrow(search, "term string, n long")
    return found.groupBy("term").agg(F.sum("n").alias("_df"))


def term_match(
    texts: DataFrame,
    glossary: DataFrame,
    key: list[str],
    text: str = "main_text",
    small: bool = False,
) -> DataFrame:
    """One row per text and entry whose term occurs in it, with tf, the occurrences counted
    without overlap."""
    if not small:
        return listed_pairs(texts, glossary, key, text)
    listed = with_entries(texts.select(*key, F.col(text).alias("_text")), glossary)
    found = listed.withColumn("_hits", present(F.col("_text"), F.col("_entries")))
    return found.select(
        *key,
        F.inline(
            F.transform(
                "_hits",
                lambda e: F.struct(
                    *[e[c].alias(c) for c in glossary.columns],
                    occurrences(F.col("_text"), e["term"]).alias("tf"),
                ),
            )
        ),
    )


def fit_terms(
    docs: DataFrame, glossary: DataFrame, key: str, text: str = "text", small: bool = False
) -> DataFrame:
    """The glossary with df, n_docs and idf.  A term found in no document has idf 0."""
    if small:
        hits = present(F.col(text), F.col("_entries"))
        found = with_entries(docs.select(text), glossary).select(
            F.explode(F.array_distinct(F.transform(hits, lambda e: e["term"]))).alias("term")
        )
        counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    else:
        counts = document_counts(docs, glossary, text)
    return _with_idf(glossary, counts, docs.agg(F.count(F.lit(1))).scalar())


def _with_idf(glossary: DataFrame, counts: DataFrame, n_docs: Column) -> DataFrame:
    return (
        glossary.filter("term IS NOT NULL")
        .join(counts, "term", "left")
        .withColumn("df", F.coalesce("_df", F.lit(0)).cast("long"))
        .withColumn("n_docs", n_docs)
        .withColumn("idf", idf(F.col("df"), F.col("n_docs")))
        .drop("_df")
    )


def refit_terms(
    previous: DataFrame, counted: DataFrame, added: DataFrame, glossary: DataFrame, key: str, text: str = "text"
) -> DataFrame:
    """The statistics of a glossary over ``counted`` and ``added`` documents, from those that
    ``previous`` has for some of its terms over the counted ones.

    Only added documents are searched for all terms, and only added terms in all documents;
    the result is that of ``fit_terms`` over all of them.
    """
    known = previous.groupBy("term").agg(F.max("df").alias("_df"))
    new_terms = glossary.join(known, "term", "left_anti")
    # A sequence that a hash alone let through may be a term that has its number already.
    only_new = document_counts(counted, new_terms, text).join(new_terms, "term", "left_semi")
    counts = document_counts(added, glossary, text).unionByName(only_new).unionByName(known)
    n_docs = counted.select(key).unionAll(added.select(key)).agg(F.count(F.lit(1))).scalar()
    return _with_idf(glossary, counts.groupBy("term").agg(F.sum("_df").alias("_df")), n_docs)


def idf(df: Column, n_docs: Column) -> Column:
    return F.when(df > 0, F.log((n_docs + 1) / (df + 1)) + 1).otherwise(F.lit(0.0))


_FIELDS = ["ordinal", "term", "target", "category", "notes"]


def scored(text: Column, entries: Column) -> Column:
    """Present entries with tf and score (negated), best first, ties in glossary order.

    ``entries`` come from a fitted glossary; terms without a document are left out.
    """
    hits = F.filter(entries, lambda e: (e["df"] > 0) & F.contains(text, e["term"]))
    counted = F.transform(
        hits, lambda e: F.struct(e.alias("e"), occurrences(text, e["term"]).alias("tf"))
    )
    return F.array_sort(
        F.transform(
            counted,
            lambda h: F.struct(
                (-(h["tf"] * h["e"]["idf"])).alias("neg_score"),
                *[h["e"][c].alias(c) for c in _FIELDS],
                h["tf"].alias("tf"),
            ),
        )
    )


def by_priority(text: Column, entries: Column) -> Column:
    """Present entries in the order of their categories, ties in glossary order."""
    return F.array_sort(
        F.transform(
            present(text, entries),
            lambda e: F.struct(
                category_priority(e["category"]).alias("priority"),
                *[e[c].alias(c) for c in _FIELDS],
                occurrences(text, e["term"]).alias("tf"),
            ),
        )
    )


def relevant_terms(
    chunks: DataFrame,
    glossary: DataFrame,
    limit: int = fixed.GLOSSARY_TERMS,
    text: str = "main_text",
    name: str = "terms",
    *,
    key: list[str],
    small: bool = False,
    scorer: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Add the array of the most relevant entries of each chunk; ``key`` identifies chunks.

    A fitted glossary (with df and idf) ranks by score, any other by category; terms of a
    fitted glossary that no document has are left out.  ``scorer`` replaces the ranking for
    glossaries of every size: from an entry and its tf it makes a score, the highest comes
    first, ties are in glossary order.  It sees one row per pair, so any function may be used.
    """
    fitted = "idf" in glossary.columns
    if small and scorer is None:
        rank = scored if fitted else by_priority
        ranked = F.slice(rank(F.col(text), F.col("_entries")), 1, limit)
        return with_entries(chunks, glossary).withColumn(name, ranked).drop("_entries")
    pairs = term_match(chunks, glossary.filter("df > 0") if fitted else glossary, key, text, small)
    if scorer is not None:
        first, label = -scorer(F.struct(*glossary.columns), F.col("tf")), "neg_score"
    elif fitted:
        first, label = -(F.col("tf") * F.col("idf")), "neg_score"
    else:
        first, label = category_priority(F.col("category")), "priority"
    best = first_rows(pairs.withColumn(label, first), key, [F.col(label), F.col("ordinal")], limit)
    entry = F.struct(label, *_FIELDS, "tf")
    found = best.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias(name))
    return chunks.join(found, key, "left").withColumn(name, F.coalesce(F.col(name), F.array()))


def annotate(text: Column, terms: Column, repeats: int = fixed.ANNOTATION_REPEATS) -> Column:
    """Longest terms first, ``term<target>`` at the first places where the term stands free.

    Free means: no Latin letter and no ideograph beside it.  The text is split at no more
    than ``repeats`` matches and joined again with the annotated term.
    """
    letter = r"a-zA-Z\x{4e00}-\x{9fff}"
    longest = F.array_sort(
        F.transform(
            terms,
            lambda t, i: F.struct(
                (-F.length(t["term"])).alias("neg_length"),
                i.alias("rank"),
                t["term"].alias("term"),
                t["target"].alias("target"),
            ),
        )
    )

    def step(done: Column, t: Column) -> Column:
        literal = F.concat(
            F.lit(r"\Q"), F.replace(t["term"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")
        )
        pattern = F.concat(F.lit(f"(?<![{letter}])"), literal, F.lit(f"(?![{letter}])"))
        pieces = F.split(done, pattern, repeats + 1)
        annotated = F.concat(t["term"], F.lit("<"), t["target"], F.lit(">"))
        return F.call_function("array_join", pieces, annotated)

    return F.aggregate(longest, text, step)


def annotate_chunks(
    chunks: DataFrame,
    glossary: DataFrame,
    limit: int = fixed.ANNOTATION_TERMS,
    text: str = "main_text",
    name: str = "annotated",
    *,
    key: list[str],
    small: bool = False,
) -> DataFrame:
    """Add the chunk text annotated with its most relevant terms."""
    ranked = relevant_terms(chunks, glossary, limit, text, "_relevant", key=key, small=small)
    return ranked.withColumn(name, annotate(F.col(text), F.col("_relevant"))).drop("_relevant")
