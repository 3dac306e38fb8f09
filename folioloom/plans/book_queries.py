"""Queries that assemble books, and runs of functions over documents."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from folioloom.functions.blocks import html_meta
from folioloom.functions.text import pad_key
from folioloom.operators import assemble as asm
from folioloom.operators.requests import second_pass, translate_documents
from folioloom.operators.status import translated_chapters
from folioloom.plans import adapters as ad
from folioloom.plans.registry import query
from folioloom.sources.readers import chapter_key, keyed_texts, numeric_file_order
from folioloom.sources.writers import raw_body, raw_file_name

SEGMENT = 20
_C = f"({ad.CHAPTERS_SQL})"
_STRIP = "regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


def _readable(spark, sf_dir, with_text=True, numbered=False):
    """Translated chapters with their texts."""
    return ad.chapters(spark, sf_dir, with_text, numbered).filter("status = 'translated'")


def _books(spark, sf_dir, readable=False):
    """One row per book, from the facts of its documents; all books or those to be read."""
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    status = F.lit(None)
    if readable:
        docs = docs.join(ad.table(spark, sf_dir, "labels"), "doc_id", "left")
        status = ad.status_of(F.col("quality"), F.col("toxic"))
    books = docs.groupBy(F.col("source").alias("book_id")).agg(
        F.min("lang").alias("title"),
        F.when(F.max("n_chars") % 2 == 0, F.concat(F.lit("Sách "), F.max("lang"))).otherwise(F.lit("")).alias("title_vi"),
        F.concat(F.lit("a & b "), F.min("n_chars").cast("string")).alias("author"),
        F.lit(None).cast("string").alias("author_vi"),
        F.lit("AI").alias("translator"),
        F.when(F.max("n_chars") % 3 == 0, F.lit('the "book"')).otherwise(F.lit("")).alias("description"),
        F.count_if(status == "translated").alias("n_readable"),
    )
    return (books.filter("n_readable > 0") if readable else books).drop("n_readable")


_BOOKS = """(SELECT source AS book_id,
        CASE WHEN max(n_chars) % 2 = 0 THEN 'Sách ' || max(lang) ELSE min(lang) END AS title,
        'a & b ' || min(n_chars) AS author, 'AI' AS translator,
        CASE WHEN max(n_chars) % 3 = 0 THEN 'the "book"' ELSE '' END AS description
      FROM documents GROUP BY source)"""
_META = """'<meta name="author" content="' || author || '">' || chr(10) || '    <meta name="translator" content="' ||
           translator || '">' || chr(10) || '    <meta name="language" content="vi">' ||
           CASE WHEN description <> '' THEN chr(10) || '    <meta name="description" content="' ||
                replace(description, '"', '&quot;') || '">' ELSE '' END"""


@query(f"SELECT book_id, title, author, translator, {_META} AS meta FROM {_BOOKS}")
def book_metadata(spark, sf_dir):
    """Metadata of every book with its meta tags."""
    books = asm.book_metadata(_books(spark, sf_dir))
    meta = html_meta(F.col("author"), F.col("translator"), F.lit("vi"), F.col("description"))
    return books.select("book_id", "title", "author", "translator", meta.alias("meta"))


_TITLE = "coalesce(title_vi, title_cn)"
_HTML = (
    "array_to_string(list_transform(list_filter(list_transform(string_split("
    + _strip("text")
    + ", chr(10) || chr(10)), lambda p: "
    + _strip("p")
    + "), lambda p: p <> ''), lambda p: '            <p>' || replace(p, chr(10), ' ') || '</p>'), chr(10))"
)
_TOC = f"""(SELECT book_id, (index - 1) // {SEGMENT} AS segment, count(*) AS n_parts,
              string_agg('<li><a href="#chapter-' || index || '">' || {_TITLE} || '</a></li>', chr(10) ORDER BY index) AS toc
            FROM {_C} WHERE status = 'translated' GROUP BY book_id, segment)"""
_SECTIONS = f"""(SELECT book_id, (index - 1) // {SEGMENT} AS segment,
              string_agg('<section id="chapter-' || index || '">' || chr(10) || '<h2>' || {_TITLE} || '</h2>' || chr(10)
                || {_HTML} || chr(10) || '</section>', chr(10) ORDER BY index) AS html
            FROM {_C} WHERE status = 'translated' GROUP BY book_id, segment)"""


@query(f"SELECT * FROM {_TOC}")
def toc_listagg(spark, sf_dir):
    """Tables of contents, in segments."""
    return asm.toc(_readable(spark, sf_dir), SEGMENT)


_HAS = f"book_id IN (SELECT book_id FROM {_C} WHERE status = 'translated')"


@query(
    f"""SELECT book_id, 0 AS part, 0 AS segment, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10)
          || '    <title>' || title || '</title>' || chr(10) || '    ' || {_META} || chr(10) || '</head>' || chr(10)
          || '<body>' || chr(10) || '<h1>' || title || '</h1>' || chr(10) || '<p>' || author || '</p>' || chr(10)
          || CASE WHEN translator <> '' THEN '<p>' || translator || '</p>' || chr(10) ELSE '' END
          || '<ol>' || chr(10) AS html FROM {_BOOKS} WHERE {_HAS}
        UNION ALL SELECT book_id, 1, segment, toc || chr(10) FROM {_TOC}
        UNION ALL SELECT book_id, 2, 0, '</ol>' || chr(10) FROM {_BOOKS} WHERE {_HAS}
        UNION ALL SELECT book_id, 3, segment, html || chr(10) FROM {_SECTIONS}
        UNION ALL SELECT book_id, 4, 0, '</body>' || chr(10) || '</html>' || chr(10) FROM {_BOOKS} WHERE {_HAS}"""
)
def assemble_html(spark, sf_dir):
    """HTML documents of all books, in ordered segments."""
    books = asm.book_metadata(_books(spark, sf_dir, readable=True))
    return asm.book_html(books, _readable(spark, sf_dir), SEGMENT, complete=True)


_ESC = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_XP = (
    "array_to_string(list_transform(list_filter(list_transform(string_split("
    + _strip("text")
    + ", chr(10) || chr(10)), lambda p: "
    + _strip("p")
    + "), lambda p: p <> ''), lambda p: '    <p>' || "
    + _ESC.format(x="p")
    + " || '</p>'), chr(10))"
)


@query(
    f"""SELECT book_id, 'OEBPS/chapters/chapter_' || lpad(CAST(number AS VARCHAR), 4, '0') || '.xhtml' AS path,
               '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="vi">' || chr(10)
               || '<head>' || chr(10) || '    <title>' || label || '</title>' || chr(10)
               || '    <link rel="stylesheet" href="../styles.css"/>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)
               || '<h2>' || label || '</h2>' || chr(10) || {_XP} || chr(10) || '</body>' || chr(10) || '</html>' AS content
        FROM (SELECT *, {_ESC.format(x=_TITLE)} AS label,
                     row_number() OVER (PARTITION BY book_id ORDER BY index) AS number
              FROM {_C} WHERE status = 'translated')"""
)
def ebook_chapters(spark, sf_dir):
    """Chapter files of the e-books, renumbered over the chapters that have text."""
    return asm.chapter_pages(_readable(spark, sf_dir, numbered=True)).select("book_id", "path", "content")


_NL = "chr(10)"
_NUMBERED = f"""(SELECT *, lpad(CAST(number AS VARCHAR), 4, '0') AS name, (number - 1) // {SEGMENT} AS seg FROM (
    SELECT book_id, text, {_ESC.format(x=_TITLE)} AS label, row_number() OVER (PARTITION BY book_id ORDER BY index) AS number
    FROM {_C} WHERE status = 'translated'))"""
_HEADS = f"""(SELECT book_id, {_ESC.format(x="title")} AS t, {_ESC.format(x="author")} AS a,
                'urn:folio:' || left(sha256(book_id), 16) AS uid FROM {_BOOKS} WHERE {_HAS})"""
_XML = "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || "


def _xhtml_sql(title: str, style: str, body: str) -> str:
    lines = [
        "'<html xmlns=\"http://www.w3.org/1999/xhtml\" xml:lang=\"vi\">'",
        "'<head>'",
        f"'    <title>' || {title} || '</title>'",
        f"'    <link rel=\"stylesheet\" href=\"{style}\"/>'",
        "'</head>'",
        "'<body>'",
        body,
        "'</body>'",
        "'</html>'",
    ]
    return _XML + f" || {_NL} || ".join(lines)


def _listed_sql(path: str, first: int, line: str) -> str:
    return f"""SELECT book_id, '{path}', seg + {first}, string_agg({line}, chr(10) ORDER BY number)
               FROM {_NUMBERED} GROUP BY book_id, seg"""


_OPF, _NCX = "OEBPS/content.opf", "OEBPS/toc.ncx"
_ITEM = """'    <item id="chapter' || name || '" href="chapters/chapter_' || name || '.xhtml" media-type="application/xhtml+xml"/>'"""
_POINT = """'    <navPoint id="navpoint' || number || '" playOrder="' || number || '"><navLabel><text>' || label ||
            '</text></navLabel><content src="chapters/chapter_' || name || '.xhtml"/></navPoint>'"""
_PAGE_BODY = f"'<h2>' || label || '</h2>' || {_NL} || {_XP}"
_COVER = f"""'<h1>' || t || '</h1>' || {_NL} || '<p class="author">' || a || '</p>'"""


@query(
    f"""SELECT book_id, 'OEBPS/chapters/chapter_' || name || '.xhtml' AS path, 0 AS segment,
               {_xhtml_sql("label", "../styles.css", _PAGE_BODY)} AS content FROM {_NUMBERED}
        UNION ALL SELECT book_id, '{_OPF}', 0, {_XML} '<package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="BookId">' || {_NL}
          || '  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>' || t || '</dc:title><dc:creator>' || a
          || '</dc:creator><dc:language>vi</dc:language><dc:identifier id="BookId">' || uid || '</dc:identifier></metadata>'
          || {_NL} || '  <manifest>'
          || {_NL} || '    <item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
          || {_NL} || '    <item id="styles" href="styles.css" media-type="text/css"/>'
          || {_NL} || '    <item id="titlepage" href="titlepage.xhtml" media-type="application/xhtml+xml"/>' FROM {_HEADS}
        UNION ALL {_listed_sql(_OPF, 1, _ITEM)}
        UNION ALL SELECT book_id, '{_OPF}', {1 << 40}, '  </manifest>' || {_NL} || '  <spine toc="ncx">' || {_NL}
          || '    <itemref idref="titlepage"/>' FROM {_HEADS}
        UNION ALL {_listed_sql(_OPF, (1 << 40) + 1, "'    <itemref idref=\"chapter' || name || '\"/>'")}
        UNION ALL SELECT book_id, '{_OPF}', {1 << 41}, '  </spine>' || {_NL} || '</package>' FROM {_HEADS}
        UNION ALL SELECT book_id, '{_NCX}', 0, {_XML} '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">' || {_NL}
          || '  <head><meta name="dtb:uid" content="' || uid || '"/></head>' || {_NL} || '  <docTitle><text>' || t
          || '</text></docTitle>' || {_NL} || '  <navMap>' FROM {_HEADS}
        UNION ALL {_listed_sql(_NCX, 1, _POINT)}
        UNION ALL SELECT book_id, '{_NCX}', {1 << 41}, '  </navMap>' || {_NL} || '</ncx>' FROM {_HEADS}
        UNION ALL SELECT book_id, 'OEBPS/titlepage.xhtml', 0, {_xhtml_sql("t", "styles.css", _COVER)} FROM {_HEADS}
        UNION ALL SELECT book_id, 'META-INF/container.xml', 0, '<?xml version="1.0"?>' || {_NL}
          || '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="{_OPF}" media-type="application/oebps-package+xml"/></rootfiles></container>'
          FROM {_HEADS}
        UNION ALL SELECT book_id, 'OEBPS/styles.css', 0, 'p {{ text-indent: 1.5em; }}' FROM {_HEADS}"""
)
def ebook_parts(spark, sf_dir):
    """All files of the e-books."""
    books = asm.book_metadata(_books(spark, sf_dir, readable=True))
    listed = _readable(spark, sf_dir, with_text=False, numbered=True)
    chapters = _readable(spark, sf_dir, numbered=True)
    return asm.ebook_parts(books, chapters, SEGMENT, complete=True, listed=listed)


@query(f"SELECT book_id, title FROM {_BOOKS} WHERE NOT {_HAS}")
def books_without_text(spark, sf_dir):
    """Books without a single text to assemble."""
    books = asm.book_metadata(_books(spark, sf_dir))
    return asm.books_without_text(books, _readable(spark, sf_dir)).select("book_id", "title")


@query(
    f"""SELECT book_id, index, right(p, 1000) AS previous_tail FROM (
          SELECT book_id, index, lag(text) OVER (PARTITION BY book_id ORDER BY index) AS p FROM {_C}
          WHERE status = 'translated')"""
)
def previous_chapter_tail(spark, sf_dir):
    """The end of the chapter before each translated chapter; their numbers have gaps."""
    chapters = _readable(spark, sf_dir).select("book_id", "index", "text")
    return asm.previous_tail(chapters).select("book_id", "index", "previous_tail")


@query(f"SELECT book_id, index, {_TITLE} AS title, length(text) AS n_chars FROM {_C} WHERE status = 'translated'")
def translated_list(spark, sf_dir):
    """Chapters with a target text and the title they are shown under."""
    chapters = ad.chapters(spark, sf_dir)
    texts = _readable(spark, sf_dir).select("book_id", "index", "text")
    joined = translated_chapters(chapters, texts, ["book_id", "index"])
    from folioloom.functions.text import display_title

    title = display_title(F.col("title_vi"), F.col("text"), F.col("title_cn"), F.col("index"))
    return joined.select("book_id", "index", title.alias("title"), F.length("text").cast("long").alias("n_chars"))


@query(
    f"""SELECT book_id, index, CASE WHEN index < 10000 THEN lpad(CAST(index AS VARCHAR), 4, '0')
               ELSE CAST(index AS VARCHAR) END || '_第' || index || '章-' || split_part(title_cn, ' ', 2) || '.txt' AS file_name,
               '# ' || title_cn || chr(10) || chr(10) || text AS body FROM {_C}"""
)
def raw_files(spark, sf_dir):
    """Names and contents of the raw chapter files."""
    chapters = ad.chapters(spark, sf_dir, with_text=True)
    return chapters.select(
        "book_id",
        "index",
        raw_file_name(F.col("index"), F.col("title_cn")).alias("file_name"),
        raw_body(F.col("title_cn"), F.col("text")).alias("body"),
    )


@query(
    f"""SELECT book_id, index, CASE WHEN status = 'translated' THEN index || '.txt'
               ELSE lpad(CAST(index AS VARCHAR), 4, '0') || '_old.txt' END AS file_name,
               CASE WHEN status = 'translated' THEN index ELSE 999999 END AS place FROM {_C}
        WHERE status <> 'pending'"""
)
def chapter_file_key(spark, sf_dir):
    """One file per chapter from two naming patterns, the new one first.

    Every chapter that is not pending has a file of the old pattern, a translated one also
    one of the new; files of other names have no chapter.
    """
    chapters = ad.chapters(spark, sf_dir).select("book_id", "index", "status")
    old = chapters.filter("status != 'pending'").select(
        "book_id", F.concat(pad_key(F.col("index")), F.lit("_old.txt")).alias("file_name")
    )
    new = chapters.filter("status = 'translated'").select(
        "book_id", F.concat(F.col("index").cast("string"), F.lit(".txt")).alias("file_name")
    )
    other = chapters.select("book_id", F.concat(F.lit("note"), F.col("index"), F.lit(".txt")).alias("file_name"))
    files = old.union(new).union(other)
    return keyed_texts(files).select(
        "book_id", "index", "file_name", numeric_file_order(F.col("file_name")).alias("place")
    )


def _para_list(column: str) -> str:
    return f"list_filter(list_transform(string_split({column}, chr(10)), lambda p: {_strip('p')}), lambda p: p <> '')"


@query(
    f"""SELECT conv_id, turn, place - 1 AS position, coalesce(a[place], '') AS source_para,
               coalesce(b[place], '') AS target_para
        FROM (SELECT conv_id, turn, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS place
              FROM (SELECT conv_id, turn, {_para_list("source_text")} AS a, {_para_list("draft")} AS b
                    FROM ({ad.TURN_PAIRS_SQL})))"""
)
def align_paragraphs(spark, sf_dir):
    """Lines of source and target side by side."""
    return asm.align_paragraphs(ad.turn_pairs(spark, sf_dir), "source_text", "draft", ["conv_id", "turn"], "\n")


def _echo(main: str, context: str | None, state: dict | None) -> str:
    """A stand-in for a translator: its output depends on text, context and state."""
    seen = (state or {}).get("speaker", "-")
    head = f"{len(main)}|{len(context or '')}|{seen}\n{hashlib.md5(main.encode()).hexdigest()}"
    if len(main) % 4 == 0:
        return head
    return head + '\n---STATE---\n{"speaker": "s' + str(len(main) % 7) + '"}'


_FOLD_SQL = f"""
  WITH RECURSIVE
    turns AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    walk AS (
      SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS translated,
             '{{}}' AS state, CAST(0 AS BIGINT) AS failures, true AS tracking FROM conversations
      UNION ALL
      SELECT conv_id, k, turn, translated,
             CASE WHEN NOT tracking OR failures >= 2 THEN '{{}}' WHEN contains(text, '---') AND k > 1 THEN '{{}}'
                  WHEN new_state IS NOT NULL THEN new_state ELSE state END,
             failures, tracking AND failures < 2
      FROM (SELECT *, CASE WHEN tracking THEN {_strip("head")}
                           WHEN new_state IS NULL THEN head
                           ELSE head || chr(10) || '---STATE---' || chr(10) || new_state END AS translated
            FROM (SELECT w.conv_id, t.k, t.turn, t.text, w.state, w.tracking,
                         CASE WHEN length(t.text) % 4 = 0 THEN NULL
                              ELSE '{{"speaker": "s' || (length(t.text) % 7) || '"}}' END AS new_state,
                         CASE WHEN NOT w.tracking THEN w.failures
                              WHEN length(t.text) % 4 = 0 THEN w.failures + 1 ELSE 0 END AS failures,
                         length(t.text) || '|' || length(right(coalesce(w.translated, ''), 300)) || '|' ||
                           CASE WHEN w.tracking THEN coalesce(json_extract_string(w.state, '$.speaker'), '-') ELSE '-' END
                           || chr(10) || md5(t.text) AS head
                  FROM walk w JOIN turns t ON t.conv_id = w.conv_id AND t.k = w.k + 1))
    )
  SELECT conv_id, turn, translated, state AS state_json, 'ok' AS outcome FROM walk WHERE k > 0
"""


@query(_FOLD_SQL)
def sequential_fold(spark, sf_dir):
    """Conversations run through a function turn by turn, with context and state."""
    turns = ad.table(spark, sf_dir, "conversations")
    return translate_documents(turns, _echo, "conv_id", "turn", "text")


@query(
    """SELECT conv_id, turn, CASE WHEN length(draft) % 5 = 0 THEN draft ELSE draft || '+' || length(source_text) END AS polished,
              CASE WHEN length(draft) % 5 = 0 THEN 'kept draft: no' ELSE 'ok' END AS outcome
       FROM (""" + ad.TURN_PAIRS_SQL + ")"
)
def second_pass_fallback(spark, sf_dir):
    """Drafts polished by a function; where it fails the draft stays."""

    def polish(source: str, draft: str) -> str:
        if len(draft) % 5 == 0:
            raise ValueError("no")
        return f"{draft}+{len(source)}"

    done = second_pass(ad.turn_pairs(spark, sf_dir), polish)
    return done.select("conv_id", "turn", "polished", "outcome")


@query(
    """SELECT doc_id, regexp_replace(text, '\n', chr(10) || chr(10), 'g') AS text FROM documents"""
)
def concat_ordered(spark, sf_dir):
    """Lines of every document joined again in order."""
    docs = ad.documents(spark, sf_dir)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "text"))
    return asm.concat_chunks(lines, "doc_id", "place", "text")
