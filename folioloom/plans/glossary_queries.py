"""Queries over glossaries drawn from the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom import fixed_values as fixed
from folioloom.functions.arrays import each
from folioloom.functions.replies import parse_entries
from folioloom.operators import glossary as gl
from folioloom.operators import terms
from folioloom.plans import adapters as ad
from folioloom.plans.registry import query

_G = f"({ad.CORPUS_GLOSSARY_SQL})"
_X = f"({ad.EXTRACTED_SQL})"
_PRIORITY = (
    "coalesce(list_position(['character','realm','technique','location','item','organization','general'], "
    "category) - 1, 99)"
)
_FIRST = f"(SELECT * FROM {_X} QUALIFY row_number() OVER (PARTITION BY term ORDER BY seq) = 1)"
_LAST = f"(SELECT * FROM {_X} QUALIFY row_number() OVER (PARTITION BY term ORDER BY seq DESC) = 1)"


def _upsert_sql(base: str, changes: str) -> str:
    return f"""
        WITH base AS MATERIALIZED (SELECT * FROM {base}),
             changes AS MATERIALIZED (SELECT * FROM {changes}),
             latest AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY term ORDER BY seq DESC) = 1),
             firsts AS (SELECT term, min(seq) AS first_seq FROM changes GROUP BY term)
        SELECT b.term, CASE WHEN l.term IS NULL THEN b.target ELSE l.target END AS target,
               CASE WHEN l.term IS NULL THEN b.category ELSE l.category END AS category,
               CASE WHEN l.term IS NULL THEN b.notes ELSE l.notes END AS notes, b.ordinal
        FROM base b LEFT JOIN latest l ON l.term = b.term
        UNION ALL
        SELECT l.term, l.target, l.category, l.notes,
               coalesce((SELECT max(ordinal) FROM base), 0) + 1 + f.first_seq
        FROM latest l JOIN firsts f ON f.term = l.term
        WHERE l.term NOT IN (SELECT term FROM base)"""


def _corpus(spark, sf_dir):
    return ad.corpus_glossary(spark, sf_dir)


def _extracted(spark, sf_dir):
    return ad.extracted_terms(spark, sf_dir)


@query(_upsert_sql(_G, _X))
def glossary_upsert(spark, sf_dir):
    """Extracted terms merged into the glossary; the last change of a term counts."""
    return gl.upsert(_corpus(spark, sf_dir), _extracted(spark, sf_dir))


@query(f"SELECT * FROM {_G} WHERE term NOT IN (SELECT term FROM {_X})")
def glossary_delete(spark, sf_dir):
    """The glossary without the terms of the benchmark texts."""
    return gl.delete_terms(_corpus(spark, sf_dir), _extracted(spark, sf_dir))


@query(
    f"""SELECT t.term, t.term IN (SELECT term FROM {_G}) AS existed
        FROM (SELECT DISTINCT term FROM {_X}) t"""
)
def deleted_terms(spark, sf_dir):
    """Whether each term to delete was there."""
    return gl.deleted_terms(_corpus(spark, sf_dir), _extracted(spark, sf_dir))


_RENAMES = f"(SELECT term, term || '-' AS new_term, min(seq) AS seq FROM {_X} GROUP BY term)"


@query(
    f"""SELECT * FROM {_G} WHERE term NOT IN (SELECT term FROM {_X})
        UNION ALL
        SELECT r.new_term, g.target, g.category, g.notes,
               (SELECT max(ordinal) FROM {_G} WHERE term NOT IN (SELECT term FROM {_X})) + 1 + r.seq
        FROM {_G} g JOIN {_RENAMES} r ON r.term = g.term"""
)
def glossary_rename(spark, sf_dir):
    """Terms of the benchmark texts renamed in the glossary."""
    renames = (
        _extracted(spark, sf_dir)
        .groupBy("term")
        .agg(F.min("seq").alias("seq"))
        .withColumn("new_term", F.concat("term", F.lit("-")))
    )
    return gl.rename_terms(_corpus(spark, sf_dir), renames)


@query(f"SELECT * FROM {_FIRST} WHERE term NOT IN (SELECT term FROM {_G})")
def new_terms_antijoin(spark, sf_dir):
    """Extracted terms the glossary does not have, each once."""
    return gl.new_terms(_extracted(spark, sf_dir), _corpus(spark, sf_dir))


@query(f"SELECT * FROM {_FIRST}")
def dedup_keep_first(spark, sf_dir):
    """Extracted terms of all batches, the first occurrence of each."""
    from folioloom.operators.ordering import keep_first

    return keep_first(_extracted(spark, sf_dir), "term", "seq")


@query(
    f"""SELECT term, target, category FROM {_G}
        WHERE (contains(term, 'en') OR contains(lower(target), 'ung')) AND category = 'item'"""
)
def glossary_search(spark, sf_dir):
    """Terms that contain a query, within a category."""
    base = _corpus(spark, sf_dir)
    by_term, by_target = gl.search(base, "en", "item"), gl.search(base, "ung", "item")
    return by_term.union(by_target).select("term", "target", "category").distinct()


@query(f"SELECT category, count(*) AS n_terms FROM {_G} GROUP BY category")
def category_counts(spark, sf_dir):
    """Terms per category."""
    return gl.category_counts(_corpus(spark, sf_dir))


@query(f"SELECT * FROM {_G} WHERE category = 'character'")
def by_category(spark, sf_dir):
    """Terms of one category."""
    return gl.by_category(_corpus(spark, sf_dir), "character")


@query(
    f"SELECT term, target, category, notes, seq AS ordinal FROM {_LAST} WHERE term = "
    f"(SELECT min(term) FROM {_X})"
)
def lookup_term(spark, sf_dir):
    """The row of one term; of several the last."""
    rows = _extracted(spark, sf_dir).withColumnRenamed("seq", "ordinal")
    return gl.lookup(rows, rows.agg(F.min("term")).scalar())


@query(f"SELECT *, {_PRIORITY} AS priority FROM {_G} ORDER BY priority, ordinal LIMIT 40")
def priority_topk(spark, sf_dir):
    """The first terms by category order, a top-k report."""
    return gl.priority_topk(_corpus(spark, sf_dir), 40)


@query(f"SELECT * FROM {_G} ORDER BY ordinal LIMIT 100")
def cap_entries(spark, sf_dir):
    """The first hundred terms in list order, the cap of a generated glossary."""
    return gl.cap_entries(_corpus(spark, sf_dir))


@query(
    f"""SELECT *, greatest((SELECT count(*) FROM {_G}) - 50, 0) AS n_more FROM {_G}
        ORDER BY ordinal LIMIT 50"""
)
def limit_show(spark, sf_dir):
    """The first fifty terms and how many more there are."""
    return gl.shown_and_rest(_corpus(spark, sf_dir))


@query(
    f"""SELECT string_agg(term, ', ' ORDER BY ordinal) AS known_terms
        FROM (SELECT * FROM {_G} ORDER BY ordinal LIMIT 200)"""
)
def known_terms(spark, sf_dir):
    """The first known terms as one line."""
    return gl.known_terms_list(_corpus(spark, sf_dir))


@query(
    f"""SELECT string_agg(section, chr(10) ORDER BY priority) AS block FROM (
          SELECT priority, '### ' || any_value(heading) || chr(10) ||
                 string_agg('- ' || term || ' → ' || target, chr(10) ORDER BY ordinal) || chr(10) AS section
          FROM (SELECT *, {_PRIORITY} AS priority FROM {_G} ORDER BY priority, ordinal LIMIT 100)
          JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in fixed.CATEGORY_HEADINGS.items())}) h(name, heading)
            ON h.name = category GROUP BY priority)"""
)
def glossary_text(spark, sf_dir):
    """The first hundred terms by category as one block of text."""
    return gl.glossary_text(_corpus(spark, sf_dir))


@query(
    """SELECT source AS book_id, doc_id, left(text, 3000) AS sample FROM (
         SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r
         FROM documents) WHERE r <= 5"""
)
def sample_chapters(spark, sf_dir):
    """Five texts of every book, in the order of a hash; the sampling operator."""
    from folioloom.operators.ordering import first_rows

    docs = ad.table(spark, sf_dir, "documents")
    place = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = first_rows(docs.select("source", "doc_id"), "source", place, fixed.SAMPLE_COUNT)
    # Five rows per book remain; only their texts are fetched.
    return chosen.join(docs.select("doc_id", "text"), "doc_id").select(
        F.col("source").alias("book_id"), "doc_id", F.left("text", F.lit(fixed.SAMPLE_SIZE)).alias("sample")
    )


@query(
    """SELECT book_id, (index - 1) // 5 AS batch, count(*) AS n_samples,
              string_agg(left(text, 3000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY index)
                AS combined
       FROM (SELECT source AS book_id, text,
                    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS index FROM documents)
       GROUP BY book_id, batch"""
)
def batch_bucket(spark, sf_dir):
    """Starts of the texts of every book in batches of five."""
    docs = ad.table(spark, sf_dir, "documents")
    starts = docs.select("doc_id", F.left("text", F.lit(fixed.SAMPLE_SIZE)).alias("sample"))
    return gl.batches(ad.chapter_keys(docs).join(starts, "doc_id"), "book_id", "index")


@query(
    """SELECT source AS book_id, CAST(ceil(count(*) / 5.0) AS BIGINT) AS n_batches,
              greatest(10, 600 // greatest(1, CAST(ceil(count(*) / 5.0) AS BIGINT))) AS entries_per_batch
       FROM documents GROUP BY source"""
)
def entries_per_batch(spark, sf_dir):
    """How many entries each batch of a book is asked for."""
    docs = ad.table(spark, sf_dir, "documents")
    sized = docs.groupBy(F.col("source").alias("book_id")).agg(
        F.ceil(F.count(F.lit(1)) / 5).alias("n_batches")
    )
    return sized.select(
        "book_id", "n_batches", gl.entries_per_batch(F.col("n_batches"), 600).alias("entries_per_batch")
    )


def _replies(spark, sf_dir):
    """Replies made of the benchmark texts: a list of entries around prose, some not valid."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({ad.WORD})"), 1)
    entry = lambda w: F.concat(
        F.lit('{"chinese":"'), w, F.lit('","vietnamese":"+'), w, F.lit('"'),
        F.when(F.length(w) % 3 == 0, F.lit(',"category":"item","notes":"n"')).otherwise(F.lit("")), F.lit("}"),
    )
    body = F.array_join(F.transform(words, entry), ",")
    broken = F.when(F.col("item_id") % 7 == 3, F.lit(',{"chinese":"x"}')).otherwise(F.lit(""))
    close = F.when(F.col("item_id") % 7 == 5, F.lit("")).otherwise(F.lit("] end"))
    rows = ad.table(spark, sf_dir, "benchmark")
    return rows.select("item_id", F.concat(F.lit("Terms:\n["), body, broken, close).alias("reply"))


_ENTRIES_SQL = f"""
    SELECT item_id, place, term, '+' || term AS target,
           CASE WHEN length(term) % 3 = 0 THEN 'item' ELSE 'general' END AS category,
           CASE WHEN length(term) % 3 = 0 THEN 'n' END AS notes
    FROM (SELECT item_id, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS place
          FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}]{{6,}}') AS words FROM benchmark
                WHERE item_id % 7 NOT IN (3, 5)))
"""


@query(_ENTRIES_SQL)
def parse_entries_list(spark, sf_dir):
    """Entries of replies; a list with an invalid entry, or cut off, gives none."""
    rows = _replies(spark, sf_dir)
    return rows.select("item_id", F.posexplode(parse_entries(F.col("reply"))).alias("place", "e")).select(
        "item_id", F.col("place").cast("long"), "e.*"
    )


_MERGED = f"""(SELECT term, target, category, notes, row_number() OVER (ORDER BY item_id, place) - 1 AS seq
               FROM (SELECT * FROM ({_ENTRIES_SQL})
                     QUALIFY row_number() OVER (PARTITION BY term ORDER BY item_id, place) = 1)
               ORDER BY item_id, place LIMIT 100)"""


@query(_upsert_sql(_G, _MERGED))
def merge_extractions(spark, sf_dir):
    """Replies of all batches merged into the glossary, first occurrences, a hundred at most."""
    return gl.merge_extractions(_replies(spark, sf_dir), _corpus(spark, sf_dir), "item_id")


@query(
    f"""SELECT doc_id, rank, term FROM (
          SELECT d.doc_id, t.term,
                 row_number() OVER (PARTITION BY d.doc_id ORDER BY {_PRIORITY.replace("category", "t.category")}, t.ordinal) AS rank
          FROM documents d JOIN (SELECT term, {ad.CATEGORY_SQL.format(term="term")} AS category, min(seq) AS ordinal
                                 FROM {_X} GROUP BY term) t ON contains(d.text, t.term)) WHERE rank <= 5"""
)
def large_glossary_terms(spark, sf_dir):
    """The first terms of every document from a glossary without a size bound."""
    words = ad.benchmark_terms(spark, sf_dir).select(
        "term",
        F.upper("term").alias("target"),
        ad.category_of(F.col("term")).alias("category"),
        F.lit(None).cast("string").alias("notes"),
        "ordinal",
    )
    docs = ad.documents(spark, sf_dir)
    ranked = terms.relevant_terms(docs, words, 5, "text", key=["doc_id"])
    return ranked.select("doc_id", F.posexplode(each("terms")).alias("place", "t")).select(
        "doc_id", (F.col("place") + 1).cast("long").alias("rank"), "t.term"
    )


@query(
    f"""SELECT doc_id, rank, term, tf FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf * length(term) DESC, ordinal) AS rank FROM (
            SELECT d.doc_id, t.term, t.ordinal,
                   CAST((strlen(d.text) - strlen(replace(d.text, t.term, ''))) // strlen(t.term) AS BIGINT) AS tf
            FROM documents d JOIN (SELECT left(term, 1 + length(term) % 12) AS term, min(seq) AS ordinal
                                   FROM {_X} GROUP BY 1) t ON contains(d.text, t.term))) WHERE rank <= 5"""
)
def own_scorer_terms(spark, sf_dir):
    """The terms that cover most of every document, from a glossary of terms of 1 to 12 characters."""
    words = ad.tokens(ad.table(spark, sf_dir, "benchmark"), "item_id")
    term = F.substring("term", F.lit(1), F.length("term") % 12 + 1)
    listed = words.groupBy(term.alias("term")).agg(F.min("seq").alias("ordinal"))
    glossary = listed.select(
        "term", F.upper("term").alias("target"), F.lit("item").alias("category"), F.lit("").alias("notes"), "ordinal"
    )
    ranked = terms.relevant_terms(
        ad.documents(spark, sf_dir), glossary, 5, "text", key=["doc_id"], scorer=lambda e, tf: tf * F.length(e["term"])
    )
    return ranked.select("doc_id", F.posexplode(each("terms")).alias("place", "t")).select(
        "doc_id", (F.col("place") + 1).cast("long").alias("rank"), "t.term", "t.tf"
    )
