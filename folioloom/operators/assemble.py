"""Finished books from chapter texts.

A book may be far larger than a row or a task.  Books are therefore written as numbered
segments of a bounded number of chapters; read in order they are the whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom import fixed_values as fixed
from folioloom.functions.blocks import html_meta
from folioloom.functions.text import (
    display_title,
    escape_markup,
    fallback,
    non_empty,
    pad_key,
    paragraphs_html,
    strip,
)
from folioloom.operators.ordering import concat_segments, nearest_marked, number_rows

SEGMENT = 100


def concat_chunks(chunks: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Chunks of each document joined in order; a document is one text, as it was one before."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    joined = F.array_join(F.transform(parts, lambda x: x[text]), fixed.PARAGRAPH_BREAK)
    return chunks.groupBy(doc).agg(joined.alias(text))


def book_metadata(
    books: DataFrame, title: str | None = None, author: str | None = None, translator: str | None = None
) -> DataFrame:
    """Title, author and translator of each book; given values win, empty ones do not count."""

    def chosen(given: str | None, found: Column) -> Column:
        return F.lit(given) if given else found

    return books.select(
        "book_id",
        chosen(title, fallback(F.col("title_vi"), F.col("title"))).alias("title"),
        chosen(author, fallback(F.col("author_vi"), F.col("author"))).alias("author"),
        chosen(translator, F.col("translator")).alias("translator"),
        "description",
    )


def _shown_title() -> Column:
    return display_title(F.col("title_vi"), F.col("text"), F.col("title_cn"), F.col("index"))


def _toc_line(title: Column) -> Column:
    number = F.col("index").cast("string")
    return F.concat(F.lit('<li><a href="#chapter-'), number, F.lit('">'), title, F.lit("</a></li>"))


def toc(chapters: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Lines of the table of contents of each book, in segments.

    Chapters have book_id, index, title_vi, title_cn and text.
    """
    lines = chapters.select("book_id", "index", _toc_line(_shown_title()).alias("toc"))
    return concat_segments(lines, "book_id", "index", "toc", size)


def _section(title: Column) -> Column:
    """One section of HTML for a chapter."""
    return F.concat(
        F.lit('<section id="chapter-'),
        F.col("index").cast("string"),
        F.lit('">\n<h2>'),
        title,
        F.lit("</h2>\n"),
        paragraphs_html(F.col("text")),
        F.lit("\n</section>"),
    )


def _with_chapters(books: DataFrame, chapters: DataFrame, complete: bool) -> DataFrame:
    """Books that have chapters; ``complete`` says that all of them do."""
    return books if complete else books.join(chapters.select("book_id").distinct(), "book_id", "left_semi")


def book_html(
    books: DataFrame, chapters: DataFrame, size: int = SEGMENT, complete: bool = False
) -> DataFrame:
    """The HTML document of each book with chapters, as rows (book_id, part, segment, html).

    Parts: 0 head, 1 contents, 2 end of the contents, 3 chapters, 4 end.  In the order of part
    and segment the rows make up the document.  Contents and chapters of a segment come from
    one grouping, so chapters are read once.  Where ``books`` holds books with chapters only,
    say so by ``complete``; chapters are then not read to find that out.
    """
    meta = html_meta(F.col("author"), F.col("translator"), F.lit("vi"), F.col("description"))
    head = F.concat(
        F.lit("<!DOCTYPE html>\n<html>\n<head>\n    <title>"),
        F.col("title"),
        F.lit("</title>\n    "),
        meta,
        F.lit("\n</head>\n<body>\n<h1>"),
        F.col("title"),
        F.lit("</h1>\n<p>"),
        F.col("author"),
        F.lit("</p>\n"),
        F.coalesce(F.concat(F.lit("<p>"), non_empty(F.col("translator")), F.lit("</p>\n")), F.lit("")),
        F.lit("<ol>\n"),
    )

    def part(number: int, segment: Column, text: Column) -> Column:
        return F.struct(
            F.lit(number).alias("part"), segment.cast("long").alias("segment"), text.alias("html")
        )

    def joined(field: str) -> Column:
        return F.concat(F.array_join(F.transform("_entries", lambda e: e[field]), "\n"), F.lit("\n"))

    once = F.lit(0)
    ends = F.array(
        part(0, once, head), part(2, once, F.lit("</ol>\n")), part(4, once, F.lit("</body>\n</html>\n"))
    )
    titled = chapters.withColumn("_title", _shown_title())
    lines = titled.select(
        "book_id",
        F.floor((F.col("index") - 1) / size).alias("segment"),
        F.struct(
            "index", _toc_line(F.col("_title")).alias("toc"), _section(F.col("_title")).alias("html")
        ).alias("_entry"),
    )
    grouped = lines.groupBy("book_id", "segment").agg(F.array_sort(F.collect_list("_entry")).alias("_entries"))
    segments = F.array(part(1, F.col("segment"), joined("toc")), part(3, F.col("segment"), joined("html")))
    return (
        _with_chapters(books, chapters, complete)
        .select("book_id", F.inline(ends))
        .unionByName(grouped.select("book_id", F.inline(segments)))
    )


def books_without_text(books: DataFrame, chapters: DataFrame) -> DataFrame:
    return books.join(chapters.select("book_id"), "book_id", "left_anti")


# Language of assembled books.
LANGUAGE = "vi"
_XHTML_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n'
    f'<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="{LANGUAGE}">\n<head>'
)


def _xhtml(title: Column, style: str, body: Column) -> Column:
    return F.concat(
        F.lit(f"{_XHTML_HEAD}\n    <title>"),
        title,
        F.lit(f'</title>\n    <link rel="stylesheet" href="{style}"/>\n</head>\n<body>\n'),
        body,
        F.lit("\n</body>\n</html>"),
    )


def renumbered(chapters: DataFrame) -> DataFrame:
    """Chapters numbered 1..n over those there are, per book; texts take no part in it.

    Chapters that have a ``number`` keep it.
    """
    if "number" in chapters.columns:
        return chapters
    keys = number_rows(chapters.select("book_id", "index"), "book_id", "index", "number")
    return chapters.join(keys, ["book_id", "index"])


def _part(path: Column | str, segment: Column | int, content: Column | str) -> Column:
    """One file, or one segment of a file."""
    lit = lambda value: value if isinstance(value, Column) else F.lit(value)
    return F.struct(
        lit(path).alias("path"), lit(segment).cast("long").alias("segment"), lit(content).alias("content")
    )


OPF, NCX = "OEBPS/content.opf", "OEBPS/toc.ncx"
# Segments of the package list: head 0, files from 1 on, then the reading order, then the end.
SPINE, END = 1 << 40, 1 << 41
CONTAINER = (
    '<?xml version="1.0"?>\n'
    '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles>'
    f'<rootfile full-path="{OPF}" media-type="application/oebps-package+xml"/></rootfiles></container>'
)
STYLES = "p { text-indent: 1.5em; }"
# Files of every book: id, place and type in the package list.
FILES = [
    ("ncx", "toc.ncx", "application/x-dtbncx+xml"),
    ("styles", "styles.css", "text/css"),
    ("titlepage", "titlepage.xhtml", "application/xhtml+xml"),
]


def _fixed_parts(heads: DataFrame) -> DataFrame:
    """Parts that every book has once, all from one row of the book."""
    title, author = F.col("_title"), F.col("_author")
    identifier = F.concat(F.lit("urn:folio:"), F.left(F.sha2("book_id", 256), F.lit(16)))
    opf_head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" '),
        F.lit('version="2.0" unique-identifier="BookId">\n'),
        F.lit('  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>'),
        title,
        F.lit("</dc:title><dc:creator>"),
        author,
        F.lit(f'</dc:creator><dc:language>{LANGUAGE}</dc:language><dc:identifier id="BookId">'),
        identifier,
        F.lit("</dc:identifier></metadata>\n  <manifest>"),
        *[F.lit(f'\n    <item id="{i}" href="{place}" media-type="{kind}"/>') for i, place, kind in FILES],
    )
    ncx_head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" '),
        F.lit('version="2005-1">\n  <head><meta name="dtb:uid" content="'),
        identifier,
        F.lit('"/></head>\n  <docTitle><text>'),
        title,
        F.lit("</text></docTitle>\n  <navMap>"),
    )
    spine = '  </manifest>\n  <spine toc="ncx">\n    <itemref idref="titlepage"/>'
    cover = F.concat(F.lit("<h1>"), title, F.lit('</h1>\n<p class="author">'), author, F.lit("</p>"))
    parts = [
        _part(OPF, 0, opf_head),
        _part(OPF, SPINE, spine),
        _part(OPF, END, "  </spine>\n</package>"),
        _part(NCX, 0, ncx_head),
        _part(NCX, END, "  </navMap>\n</ncx>"),
        _part("OEBPS/titlepage.xhtml", 0, _xhtml(title, "styles.css", cover)),
        _part("META-INF/container.xml", 0, CONTAINER),
        _part("OEBPS/styles.css", 0, STYLES),
    ]
    return heads.select("book_id", F.inline(F.array(*parts)))


def _listed_parts(named: DataFrame, size: int) -> DataFrame:
    """Segments of the package list, the reading order and the navigation.

    All three come from one ordered collection per segment, without the texts.
    """
    entries = F.array_sort(F.collect_list(F.struct("number", "_name", "_label")))
    grouped = (
        named.withColumn("segment", F.floor((F.col("number") - 1) / size))
        .groupBy("book_id", "segment")
        .agg(entries.alias("_entries"))
    )

    fields = {"{number}": "number", "{name}": "_name", "{label}": "_label"}

    def lines(*shape: str) -> Column:
        def line(e: Column) -> Column:
            return F.concat(*[e[fields[p]].cast("string") if p in fields else F.lit(p) for p in shape])

        return F.array_join(F.transform("_entries", line), "\n")

    item = lines(
        '    <item id="chapter', "{name}", '" href="chapters/chapter_', "{name}",
        '.xhtml" media-type="application/xhtml+xml"/>',
    )
    itemref = lines('    <itemref idref="chapter', "{name}", '"/>')
    point = lines(
        '    <navPoint id="navpoint', "{number}", '" playOrder="', "{number}", '"><navLabel><text>',
        "{label}", '</text></navLabel><content src="chapters/chapter_', "{name}", '.xhtml"/></navPoint>',
    )
    place = F.col("segment") + 1
    parts = F.array(_part(OPF, place, item), _part(OPF, place + SPINE, itemref), _part(NCX, place, point))
    return grouped.select("book_id", F.inline(parts))


def _named(chapters: DataFrame, *columns: str) -> DataFrame:
    """Numbered chapters with the name of their file and their label."""
    label = escape_markup(
        F.coalesce(
            non_empty(F.col("title_vi")),
            non_empty(F.col("title_cn")),
            F.concat(F.lit(f"{fixed.CHAPTER_WORD} "), F.col("number").cast("string")),
        )
    )
    return renumbered(chapters).select(
        "book_id", "number", *columns, pad_key(F.col("number")).alias("_name"), label.alias("_label")
    )


def chapter_pages(chapters: DataFrame) -> DataFrame:
    """Rows (book_id, path, segment, content) of the chapter files alone."""
    body = F.concat(
        F.lit("<h2>"), F.col("_label"), F.lit("</h2>\n"), paragraphs_html(F.col("text"), "    ", escaped=True)
    )
    path = F.concat(F.lit("OEBPS/chapters/chapter_"), F.col("_name"), F.lit(".xhtml"))
    page = _part(path, 0, _xhtml(F.col("_label"), "../styles.css", body))
    return _named(chapters, "text").select("book_id", page.alias("_p")).select("book_id", "_p.*")


def ebook_parts(
    books: DataFrame,
    chapters: DataFrame,
    size: int = SEGMENT,
    complete: bool = False,
    listed: DataFrame | None = None,
) -> DataFrame:
    """Rows (book_id, path, segment, content) for every file of an e-book.

    Long files (package list and navigation) come in segments; the first has their head and
    the last their end.  ``complete`` says that all ``books`` have chapters.  Lists take titles
    and numbers only; ``listed`` may give the same chapters without texts, which saves the
    join with them.
    """
    title = escape_markup(F.coalesce(non_empty(F.col("title")), F.lit("Untitled")))
    author = escape_markup(F.coalesce(non_empty(F.col("author")), F.lit("Unknown")))
    heads = _with_chapters(books, chapters, complete).select(
        "book_id", title.alias("_title"), author.alias("_author")
    )
    lists = _listed_parts(_named(chapters if listed is None else listed), size)
    return chapter_pages(chapters).unionByName(lists).unionByName(_fixed_parts(heads))


def previous_tail(chapters: DataFrame, key: tuple[str, str] = ("book_id", "index"), size: int = 1000) -> DataFrame:
    """Add the end of the text of the chapter before: the one with the nearest lower number.

    That number is found over keys alone; the tail comes by an equi-join on it.
    """
    book, index = key
    near = nearest_marked(chapters.select(*key), book, index, F.lit(True), "_earlier", "_later")
    tails = chapters.select(book, F.col(index).alias("_earlier"), F.right("text", F.lit(size)).alias("previous_tail"))
    placed = chapters.join(near.drop("_later"), list(key))
    return placed.join(tails, [book, "_earlier"], "left").drop("_earlier")


def align_paragraphs(pairs: DataFrame, source: str, target: str, key: list[str], separator: str = "\n\n+") -> DataFrame:
    """Paragraphs of two texts side by side by position; the missing side is empty."""
    def paragraphs(text: str) -> Column:
        parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), separator, -1), strip)
        return F.filter(parts, lambda p: p != "")

    zipped = F.zip_with(
        paragraphs(source),
        paragraphs(target),
        lambda a, b: F.struct(
            F.coalesce(a, F.lit("")).alias("source_para"), F.coalesce(b, F.lit("")).alias("target_para")
        ),
    )
    return pairs.select(*key, F.posexplode(zipped).alias("position", "pair")).select(
        *key, F.col("position").cast("long"), "pair.source_para", "pair.target_para"
    )
