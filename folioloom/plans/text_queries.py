"""Queries over document texts: chunks, terms, annotation, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom import fixed_values as fixed
from folioloom.functions import text as tx
from folioloom.functions.arrays import each
from folioloom.functions.blocks import glossary_block
from folioloom.operators import chunking, quality, terms
from folioloom.operators.requests import build_requests
from folioloom.plans import adapters as ad
from folioloom.plans.registry import query

# The watch list is a constant of this package; its size is known.
SMALL = len(ad.TERMS) <= terms.SMALL_GLOSSARY

_SIZE, _GAP, _OVER = ad.CHUNK["size"], len(ad.SEPARATOR), ad.CHUNK["overlap"]
_TALK = " OR ".join(
    f"contains(p, '{w}')" for w in [*ad.DIALOGUE_MARKS, *ad.DIALOGUE_WORDS]
)

PARAS_SQL = f"""
    paras AS (SELECT doc_id, source, generate_subscripts(ps, 1) - 1 AS i, unnest(ps) AS p
              FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ps FROM documents)),
    flags AS (SELECT *, length(p) AS len, ({_TALK}) AS dlg FROM paras),
    brk AS (SELECT *, NOT dlg AND NOT (len < {fixed.SHORT_NARRATION} AND coalesce(
                lead(dlg) OVER (PARTITION BY doc_id ORDER BY i), false)) AS b FROM flags),
    isl AS (SELECT *, sum(b::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island,
                   sum(len) OVER (PARTITION BY doc_id ORDER BY i) AS reach FROM brk),
    blk AS (SELECT *, max(CASE WHEN dlg THEN i END) OVER (PARTITION BY doc_id, island) AS e FROM isl),
    par AS (SELECT a.doc_id, a.source, a.i, a.p, a.len, a.dlg, a.e,
                   CAST(z.reach - a.reach + a.len + {_GAP} * (a.e - a.i) AS BIGINT) AS blen
            FROM blk a LEFT JOIN blk z ON z.doc_id = a.doc_id AND z.i = a.e)
"""

# Rows (doc_id, source, chunk_idx, main_text).  One recursion step places one unit: a dialogue
# block, a paragraph or a sentence.  A chunk is ordered by the step that closes it, pieces of an
# over-long sentence by the step that cuts it.
CHUNKS_SQL = f"""
  WITH RECURSIVE {PARAS_SQL},
    sen AS (SELECT doc_id, i, generate_subscripts(ss, 1) AS j, len(ss) AS n, unnest(ss) AS s
            FROM (SELECT doc_id, i,
                    list_concat(flatten(list_transform(regexp_extract_all(p, '[^.!?]*[.!?]|[^.!?]+'),
                        lambda s: CASE WHEN s IN ('.', '!', '?') THEN ['', s] ELSE [s] END)),
                      CASE WHEN right(p, 1) IN ('.', '!', '?') THEN [''] ELSE [] END) AS ss
                  FROM par WHERE len > {_SIZE})),
    unit AS (SELECT par.doc_id, par.i, coalesce(sen.j, 1) AS j, sen.n, sen.s, par.p, par.len, par.dlg,
                    par.e, par.blen
             FROM par LEFT JOIN sen USING (doc_id, i)),
    walk AS (
      SELECT doc_id, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j,
             CAST(0 AS BIGINT) AS filled, false AS held, CAST(-1 AS BIGINT) AS chunk,
             CAST(NULL AS BIGINT) AS first_i, CAST(NULL AS BIGINT) AS last_i,
             CAST(NULL AS VARCHAR) AS piece, false AS closes, 'start' AS kind
      FROM documents
      UNION ALL
      SELECT doc_id, step + 1,
             CASE WHEN kind IN ('block', 'new block') THEN e + 1
                  WHEN kind IN ('para', 'new para') OR j >= n THEN i + 1 ELSE i END,
             CASE WHEN kind IN ('sent', 'new sent', 'cut') AND j < n THEN j + 1 ELSE 1 END,
             CASE kind WHEN 'block' THEN filled + blen + {_GAP} WHEN 'new block' THEN blen
                  WHEN 'para' THEN filled + len + {_GAP} WHEN 'new para' THEN len
                  WHEN 'sent' THEN filled + length(s) WHEN 'new sent' THEN length(s) ELSE filled END,
             CASE WHEN kind = 'cut' THEN held ELSE true END,
             CASE WHEN kind = 'cut' THEN chunk
                  WHEN kind IN ('new block', 'new para', 'new sent') OR NOT held THEN step + 1
                  ELSE chunk END,
             i, CASE WHEN kind IN ('block', 'new block') THEN e ELSE i END,
             CASE WHEN kind IN ('sent', 'new sent', 'cut') THEN s END,
             flush OR kind IN ('new block', 'new para', 'new sent'), kind
      FROM (
        SELECT w.doc_id, w.step, w.i, w.j, w.chunk, u.n, u.s, u.e, u.len, u.blen,
               (NOT coalesce(u.dlg AND (w.filled + u.blen + {_GAP} <= {_SIZE} OR u.blen <= {_SIZE} * 1.2), false)
                 AND u.len > {_SIZE} AND w.j = 1) AS flush,
               CASE WHEN flush THEN 0 ELSE w.filled END AS filled,
               CASE WHEN flush THEN false ELSE w.held END AS held,
               CASE WHEN u.dlg AND w.j = 1 AND w.filled + u.blen + {_GAP} <= {_SIZE} THEN 'block'
                    WHEN u.dlg AND w.j = 1 AND u.blen <= {_SIZE} * 1.2 THEN 'new block'
                    WHEN u.len <= {_SIZE} AND w.filled + u.len + {_GAP} <= {_SIZE} THEN 'para'
                    WHEN u.len <= {_SIZE} THEN 'new para'
                    WHEN length(u.s) > {_SIZE} THEN 'cut'
                    WHEN (CASE WHEN flush THEN 0 ELSE w.filled END) + length(u.s) <= {_SIZE} THEN 'sent'
                    ELSE 'new sent' END AS kind
        FROM walk w JOIN unit u ON u.doc_id = w.doc_id AND u.i = w.i AND u.j = w.j
      )
    ),
    closing AS (SELECT doc_id, step FROM walk WHERE closes),
    pieces AS (
      SELECT w.doc_id, w.chunk, w.step,
             coalesce(w.piece, (SELECT string_agg(q.p, chr(10) ORDER BY q.i) FROM par q
                                WHERE q.doc_id = w.doc_id AND q.i BETWEEN w.first_i AND w.last_i)) AS piece
      FROM walk w WHERE w.kind NOT IN ('start', 'cut')
    ),
    whole AS (
      SELECT doc_id, chunk, string_agg(piece, chr(10) ORDER BY step) AS main_text
      FROM pieces GROUP BY doc_id, chunk
    ),
    placed AS (
      SELECT doc_id, coalesce((SELECT min(c.step) FROM closing c WHERE c.doc_id = whole.doc_id
                               AND c.step > whole.chunk), 1000000000) AS closed_at, -1 AS part, main_text
      FROM whole
      UNION ALL
      SELECT doc_id, step, k, substr(piece, CAST(k * {_SIZE} + 1 AS BIGINT), {_SIZE})
      FROM (SELECT doc_id, step, piece, unnest(range(CAST(ceil(length(piece) / {_SIZE}.0) AS BIGINT))) AS k
            FROM walk WHERE kind = 'cut')
    )
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY closed_at, part) - 1 AS chunk_idx, main_text
  FROM placed
"""


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return ad.documents(spark, sf_dir, *columns)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(_docs(spark, sf_dir, "text"), **ad.CHUNK)


def _fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.fit_terms(_docs(spark, sf_dir, "text"), ad.watch_list(spark), "doc_id", small=SMALL)


_FIT_SQL = f"""
    SELECT g.*, s.df, n.n_docs,
           CASE WHEN s.df > 0 THEN ln((n.n_docs + 1) / (s.df + 1)) + 1 ELSE 0.0 END AS idf
    FROM {ad.watch_list_sql()}
    JOIN (SELECT t.term, count(d.doc_id) AS df
          FROM (SELECT term FROM {ad.watch_list_sql()}) t
          LEFT JOIN documents d ON contains(d.text, t.term) GROUP BY t.term) s ON s.term = g.term
    CROSS JOIN (SELECT count(*) AS n_docs FROM documents) n
"""
_TF = "(length({c}) - length(replace({c}, term, ''))) // length(term)"


@query(CHUNKS_SQL)
def greedy_chunks(spark, sf_dir):
    """Chunks by all rules: dialogue blocks, long paragraphs, over-long sentences."""
    return _chunks(spark, sf_dir).select("doc_id", "chunk_idx", "main_text")


@query(
    f"""SELECT doc_id, chunk_idx, right(lag(main_text) OVER (PARTITION BY doc_id ORDER BY chunk_idx), {_OVER})
               AS context_text, length(main_text) AS n_chars
        FROM ({CHUNKS_SQL})"""
)
def chunk_context(spark, sf_dir):
    """The end of the previous chunk beside each chunk."""
    return _chunks(spark, sf_dir).select(
        "doc_id", "chunk_idx", "context_text", F.length("main_text").cast("long").alias("n_chars")
    )


@query(
    f"""SELECT d.source AS book_id, count(*) AS n_chunks FROM ({CHUNKS_SQL}) c
        JOIN documents d ON d.doc_id = c.doc_id GROUP BY d.source"""
)
def total_chunks(spark, sf_dir):
    """Chunks per book; partial counts are made before the shuffle."""
    chunks = chunking.chunk_documents(_docs(spark, sf_dir, "text", "source"), **ad.CHUNK)
    return chunks.groupBy(F.col("source").alias("book_id")).agg(F.count(F.lit(1)).alias("n_chunks"))


@query(
    f"""WITH {PARAS_SQL}
        SELECT doc_id, first_para, last_para, CAST(n_chars AS BIGINT) AS n_chars FROM (
          SELECT doc_id, island, min(i) AS first_para, max(e) AS last_para,
                 max(blen) AS n_chars
          FROM (SELECT par.*, blk.island FROM par JOIN blk USING (doc_id, i)) WHERE dlg
          GROUP BY doc_id, island)"""
)
def dialogue_islands(spark, sf_dir):
    """Blocks of dialogue with short narration between."""
    return chunking.dialogue_islands(_docs(spark, sf_dir, "text"), **{k: v for k, v in ad.TEXT_RULES.items() if k != "sentence_ends"})


@query(f"SELECT term, df, n_docs, round(idf, 6) AS idf FROM ({_FIT_SQL})")
def doc_freq(spark, sf_dir):
    """Document frequencies of the glossary terms."""
    return _fitted(spark, sf_dir).select("term", "df", "n_docs", F.round("idf", 6).alias("idf"))


@query(
    f"""SELECT doc_id, term, {_TF.format(c="text")} AS tf
        FROM (SELECT doc_id, text, term FROM documents d JOIN {ad.watch_list_sql()} ON contains(d.text, g.term))"""
)
def term_match(spark, sf_dir):
    """Occurrences of every listed term in every document."""
    found = terms.term_match(_docs(spark, sf_dir, "text"), ad.watch_list(spark), ["doc_id"], "text", SMALL)
    return found.select("doc_id", "term", "tf")


@query(
    f"""SELECT doc_id, term, {_TF.format(c="text")} AS tf
        FROM (SELECT d.doc_id, d.text, t.term FROM documents d
              JOIN (SELECT DISTINCT term FROM ({ad.EXTRACTED_SQL})) t ON contains(d.text, t.term))"""
)
def ngram_term_match(spark, sf_dir):
    """The same for a glossary without a size bound, by an equi-join on character sequences."""
    found = terms.term_match(
        _docs(spark, sf_dir, "text"), ad.benchmark_terms(spark, sf_dir), ["doc_id"], "text", small=False
    )
    return found.select("doc_id", "term", "tf")


@query(
    f"""SELECT doc_id, chunk_idx, term, tf, round(tf * idf, 6) AS score
        FROM (SELECT c.doc_id, c.chunk_idx, s.term, s.idf, {_TF.format(c="c.main_text")} AS tf
              FROM ({CHUNKS_SQL}) c JOIN ({_FIT_SQL}) s ON contains(c.main_text, s.term) AND s.df > 0)"""
)
def tfidf_scores(spark, sf_dir):
    """TF-IDF of every listed term in every chunk."""
    limit = len(ad.TERMS)
    ranked = terms.relevant_terms(_chunks(spark, sf_dir), _fitted(spark, sf_dir), limit, key=["doc_id", "chunk_idx"], small=SMALL)
    return ranked.select("doc_id", "chunk_idx", F.inline(each("terms"))).select(
        "doc_id", "chunk_idx", "term", "tf", F.round(-F.col("neg_score"), 6).alias("score")
    )


@query(
    f"""SELECT doc_id, chunk_idx, rank, term, target, tf, round(score, 6) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY score DESC, ordinal) AS rank
          FROM (SELECT *, tf * idf AS score FROM (
            SELECT c.doc_id, c.chunk_idx, s.term, s.target, s.ordinal, s.idf,
                   {_TF.format(c="c.main_text")} AS tf
            FROM ({CHUNKS_SQL}) c JOIN ({_FIT_SQL}) s ON contains(c.main_text, s.term) AND s.df > 0)))
        WHERE rank <= 5"""
)
def chunk_topk_terms(spark, sf_dir):
    """The five most relevant terms of every chunk."""
    ranked = terms.relevant_terms(_chunks(spark, sf_dir), _fitted(spark, sf_dir), 5, key=["doc_id", "chunk_idx"], small=SMALL)
    return ranked.select("doc_id", "chunk_idx", F.posexplode(each("terms")).alias("place", "t")).select(
        "doc_id",
        "chunk_idx",
        (F.col("place") + 1).cast("long").alias("rank"),
        "t.term",
        "t.target",
        "t.tf",
        F.round(-F.col("t.neg_score"), 6).alias("score"),
    )


_PRIORITY = (
    "coalesce(list_position(['character','realm','technique','location','item','organization','general'], "
    "category) - 1, 99)"
)


@query(
    f"""SELECT doc_id, rank, term FROM (
          SELECT d.doc_id, g.term,
                 row_number() OVER (PARTITION BY d.doc_id ORDER BY {_PRIORITY}, g.ordinal) AS rank
          FROM documents d JOIN {ad.watch_list_sql()} ON contains(d.text, g.term)) WHERE rank <= 6"""
)
def present_terms_priority(spark, sf_dir):
    """Terms of every document by category order, the way without scores."""
    ranked = terms.relevant_terms(_docs(spark, sf_dir, "text"), ad.watch_list(spark), 6, "text", key=["doc_id"], small=SMALL)
    return ranked.select("doc_id", F.posexplode(each("terms")).alias("place", "t")).select(
        "doc_id", (F.col("place") + 1).cast("long").alias("rank"), "t.term"
    )


_BLOCK_SQL = f"""
    SELECT doc_id, string_agg(section, chr(10) ORDER BY priority) AS block FROM (
      SELECT doc_id, priority,
             '### ' || any_value(heading) || chr(10) ||
             string_agg('- ' || term || ' → ' || target || coalesce(' (' || notes || ')', ''), chr(10) ORDER BY ordinal)
             || chr(10) AS section
      FROM (SELECT d.doc_id, g.*, {_PRIORITY} AS priority FROM documents d
            JOIN {ad.watch_list_sql()} ON contains(d.text, g.term))
      JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in fixed.CATEGORY_HEADINGS.items())}) h(name, heading)
        ON h.name = category
      GROUP BY doc_id, priority) GROUP BY doc_id
"""


@query(
    f"""SELECT d.doc_id, coalesce(b.block, '') AS block FROM documents d
        LEFT JOIN ({_BLOCK_SQL}) b ON b.doc_id = d.doc_id"""
)
def term_block(spark, sf_dir):
    """Terms of every document as a block of text, grouped by category."""
    ranked = terms.relevant_terms(_docs(spark, sf_dir, "text"), ad.watch_list(spark), 100, "text", key=["doc_id"], small=SMALL)
    return ranked.select("doc_id", glossary_block(F.col("terms")).alias("block"))


_BESIDE = "'[a-zA-Z\\x{4e00}-\\x{9fff}]'"


def _annotate_sql(ranked: str, texts: str) -> str:
    """SQL that annotates ``texts`` (id, text) with ``ranked`` terms (id, term, target, r).

    For terms of letters: two occurrences that overlap are not free anyway, so splitting at
    the plain term finds all free ones.
    """
    return f"""
      WITH RECURSIVE
        texts AS ({texts}),
        longest AS (SELECT id, term, target,
                      row_number() OVER (PARTITION BY id ORDER BY length(term) DESC, r) AS k
                    FROM ({ranked}) WHERE r <= {fixed.ANNOTATION_TERMS}),
        walk AS (
          SELECT id, CAST(0 AS BIGINT) AS k, text FROM texts
          UNION ALL
          SELECT id, k, list_reduce(
              list_transform(range(1, len(ps) + 1), lambda i: ps[i] || CASE
                  WHEN i = len(ps) THEN ''
                  WHEN ok[i] AND len(list_filter(ok[1:i], lambda o: o)) <= {fixed.ANNOTATION_REPEATS}
                  THEN term || '<' || target || '>' ELSE term END),
              lambda a, b: a || b)
          FROM (SELECT *, list_transform(range(1, len(ps)), lambda i:
                    NOT regexp_matches(right(ps[i], 1), {_BESIDE})
                    AND NOT regexp_matches(left(ps[i + 1], 1), {_BESIDE})
                    AND NOT (ps[i] = '' AND i > 1) AND NOT (ps[i + 1] = '' AND i + 1 < len(ps))) AS ok
                FROM (SELECT w.id, l.k, l.term, l.target, string_split(w.text, l.term) AS ps
                      FROM walk w JOIN longest l ON l.id = w.id AND l.k = w.k + 1))
        )
      SELECT id, arg_max(text, k) AS annotated FROM walk GROUP BY id"""


_BY_PRIORITY_SQL = f"""
    SELECT doc_id AS id, term, target, row_number() OVER (PARTITION BY doc_id ORDER BY {_PRIORITY}, ordinal) AS r
    FROM documents d JOIN {ad.watch_list_sql()} ON contains(d.text, g.term)"""
_ANNOTATED_SQL = f"""
    SELECT id AS doc_id, annotated
    FROM ({_annotate_sql(_BY_PRIORITY_SQL, "SELECT doc_id AS id, text FROM documents")})"""


@query(_ANNOTATED_SQL)
def annotate_terms(spark, sf_dir):
    """Texts with their terms annotated where they stand free, five times at most."""
    done = terms.annotate_chunks(_docs(spark, sf_dir, "text"), ad.watch_list(spark), text="text", key=["doc_id"], small=SMALL)
    return done.select("doc_id", "annotated")


def _scored_sql(texts: str, column: str) -> str:
    """SQL that ranks the fitted terms of ``texts`` (id, ``column``) by score."""
    return f"""
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY tf * idf DESC, ordinal) AS r FROM (
        SELECT c.id, s.*, {_TF.format(c="c." + column)} AS tf
        FROM ({texts}) c JOIN fitted s ON contains(c.{column}, s.term) AND s.df > 0)"""


_REQUESTS_SQL = f"""
  WITH fitted AS MATERIALIZED ({_FIT_SQL}),
    chunked AS MATERIALIZED (SELECT doc_id, chunk_idx, doc_id * 100000 + chunk_idx AS id, main_text,
        right(lag(main_text) OVER (PARTITION BY doc_id ORDER BY chunk_idx), {_OVER}) AS context_text
      FROM ({CHUNKS_SQL})),
    marked AS MATERIALIZED ({_annotate_sql(_scored_sql("SELECT id, main_text FROM chunked", "main_text"),
                                            "SELECT id, main_text AS text FROM chunked")}),
    ranked AS MATERIALIZED (SELECT * FROM ({_scored_sql("SELECT id, annotated FROM marked", "annotated")})
      WHERE r <= {fixed.GLOSSARY_TERMS}),
    blocks AS (
      SELECT id, string_agg(section, chr(10) ORDER BY priority) AS block FROM (
        SELECT id, {_PRIORITY} AS priority, '### ' || any_value(heading) || chr(10) ||
               string_agg('- ' || term || ' → ' || target || coalesce(' (' || notes || ')', ''), chr(10) ORDER BY r)
               || chr(10) AS section
        FROM ranked JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in fixed.CATEGORY_HEADINGS.items())}) h(name, heading)
          ON h.name = category GROUP BY id, category) GROUP BY id)
  SELECT doc_id, chunk_idx, coalesce(block, '') AS glossary_block,
         '## Style' || chr(10) || '**Plain**' || chr(10) || CASE WHEN chunk_idx > 0 THEN chr(10) || chr(10) ||
           '## State so far' || chr(10) || '- Speaker: s' || chunk_idx ELSE '' END AS system_prompt,
         CASE WHEN block IS NOT NULL THEN '## Terms' || chr(10) || block || chr(10) || chr(10) ELSE '' END ||
         CASE WHEN context_text <> '' THEN '## Before' || chr(10) || context_text || chr(10) || chr(10) ELSE '' END ||
         '## Text' || chr(10) || annotated AS user_prompt
  FROM chunked JOIN marked USING (id) LEFT JOIN blocks USING (id)
"""


@query(_REQUESTS_SQL)
def translation_requests(spark, sf_dir):
    """One request row per chunk: annotated text, glossary block, context and prompts."""
    state = F.when(
        F.col("chunk_idx") > 0,
        F.concat(F.lit('{"speaker":"s'), F.col("chunk_idx").cast("string"), F.lit('"}')),
    ).otherwise(F.lit("{}"))
    rows = build_requests(
        _chunks(spark, sf_dir), _fitted(spark, sf_dir), F.lit("**Plain**\n"), state, key=["doc_id", "chunk_idx"], small=SMALL
    )
    return rows.select("doc_id", "chunk_idx", "glossary_block", "system_prompt", "user_prompt")


_LEAKS = ", ".join(f"('{k}', '{v}')" for k, v in fixed.LEAKED_WORDS.items())
_TOKENS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"


@query(
    f"""SELECT doc_id, word, count(*) AS n, any_value(replacement) AS replacement
        FROM (SELECT doc_id, unnest({_TOKENS}) AS word FROM documents)
        JOIN (VALUES {_LEAKS}) m(leak, replacement) ON leak = word GROUP BY doc_id, word"""
)
def leak_counts(spark, sf_dir):
    """Words of another language per document."""
    return quality.leak_report(_docs(spark, sf_dir, "text"), "doc_id")


_FLAGS = ", ".join(
    f"len(list_filter(tokens, lambda w: lower(w) = '{w}')) AS n_{w}" for w in fixed.FLAG_WORDS
)
_FLAG_SQL = f"""
    SELECT doc_id, n_replaced, {", ".join(f"n_{w}" for w in fixed.FLAG_WORDS)},
           n_replaced > 0 OR {" + ".join(f"n_{w}" for w in fixed.FLAG_WORDS)} > 0 AS flagged
    FROM (SELECT doc_id, {_FLAGS}, len(list_filter(tokens, lambda w: w IN
            ({", ".join(f"'{w}'" for w in fixed.LEAKED_WORDS)}))) AS n_replaced
          FROM (SELECT doc_id, {_TOKENS} AS tokens FROM documents))
"""


@query(_FLAG_SQL)
def flag_report(spark, sf_dir):
    """Documents with words to be checked."""
    return quality.flag_report(_docs(spark, sf_dir, "text"), "doc_id")


@query(
    f"""SELECT count(*) AS n_docs, count(*) FILTER (flagged) AS n_flagged,
               CAST(sum(n_replaced) AS BIGINT) AS n_replaced FROM ({_FLAG_SQL})"""
)
def flag_totals(spark, sf_dir):
    """Totals over all documents."""
    return quality.report_totals(quality.flag_report(_docs(spark, sf_dir, "text"), "doc_id"))


_REPLACE_SQL = "text"
for _word, _target in fixed.LEAKED_WORDS.items():
    # Twice: two neighbouring matches share the character between them.
    for _ in range(2):
        _REPLACE_SQL = (
            f"regexp_replace({_REPLACE_SQL}, '(^|[^\\p{{L}}\\p{{N}}_]){_word}([^\\p{{L}}\\p{{N}}_]|$)', "
            f"'\\1{_target}\\2', 'g')"
        )


@query(f"SELECT doc_id, clean AS text, clean <> text AS modified FROM (SELECT doc_id, text, {_REPLACE_SQL} AS clean FROM documents)")
def sanitize_documents(spark, sf_dir):
    """Texts with the leaked words replaced."""
    return quality.sanitize(_docs(spark, sf_dir, "text"))


@query(
    """SELECT doc_id, len(string_split(text, chr(10))) AS n_paragraphs,
              len(list_filter(string_split(text, chr(10)), lambda p: length(p) > 0)) AS n_filled,
              array_to_string(list_filter(list_transform(string_split(text, chr(10)),
                lambda p: trim(regexp_replace(p, '[\\s\\p{Z}]+', ' ', 'g'))), lambda p: p <> ''),
                chr(10) || chr(10)) AS normalized
       FROM documents"""
)
def normalized_lines(spark, sf_dir):
    """Lines with squeezed whitespace, as paragraphs."""
    paras = F.split("text", "\n", -1)
    return _docs(spark, sf_dir, "text").select(
        "doc_id",
        F.size(paras).cast("long").alias("n_paragraphs"),
        F.size(F.filter(paras, lambda p: p != "")).cast("long").alias("n_filled"),
        tx.lines_to_paragraphs(F.col("text")).alias("normalized"),
    )


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+'))
              + CASE WHEN right(text, 1) IN ('.', '!', '?') OR text = '' THEN 1 ELSE 0 END AS n_sentences,
              contains(text, '---') AS scene_break, left(text, 2000) AS sample
       FROM documents"""
)
def sentence_counts(spark, sf_dir):
    """Sentences per document, scene breaks and the start of each text."""
    return _docs(spark, sf_dir, "text").select(
        "doc_id",
        F.size(tx.split_sentences(F.col("text"), ad.SENTENCE_ENDS)).cast("long").alias("n_sentences"),
        tx.needs_scene_reset(F.col("text"), F.lit(1)).alias("scene_break"),
        tx.truncate(F.col("text"), fixed.EXTRACTION_SIZE).alias("sample"),
    )
