"""Links and main text of web pages.

Only reading the markup happens in Python, batch by batch; filters, URL rules, thresholds
and line rules are Spark expressions on what it returns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom import fixed_values as fixed
from folioloom.functions.arrays import each, let
from folioloom.functions.slices import sliced
from folioloom.functions.text import lines_to_paragraphs, strip
from folioloom.functions.urls import chapter_id, resolve_url
from folioloom.operators import markup


def _anchors(selector: str):
    kind = pa.list_(pa.struct([("href", pa.string()), ("title", pa.string())]))

    @F.arrow_udf("array<struct<href:string,title:string>>")
    def read(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(html: str) -> list[dict[str, str]]:
            return [
                {"href": a.attrs.get("href", ""), "title": markup.stripped_strings(a)}
                for a in markup.select(markup.parse(html or ""), selector)
            ]

        for batch in pages:
            for piece in sliced(batch):
                yield pa.array([one(h) for h in batch[piece].to_pylist()], kind)

    return read


def usable_link(href: Column) -> Column:
    """Neither empty nor a place on the page nor a script."""
    return (href != "") & ~href.startswith("#") & ~href.startswith("javascript:")


def extract_links(
    pages: DataFrame, selector: str, html: str = "html", url: str = "url", key: str = "page_id"
) -> DataFrame:
    """Links of every page: absolute URL once, numbered from 1 in page order.

    Repeated URLs are dropped inside the row by sorting, so no shuffle is needed.
    """
    read = pages.select(key, url, _anchors(selector)(F.col(html)).alias("_anchors"))
    resolved = read.select(
        key,
        F.transform(
            F.filter("_anchors", lambda a: usable_link(a["href"])),
            lambda a, i: F.struct(
                resolve_url(F.col(url), a["href"]).alias("url"),
                i.alias("place"),
                a["href"].alias("href"),
                a["title"].alias("title"),
            ),
        ).alias("_links"),
    )
    ordered = resolved.select(key, F.array_sort("_links").alias("_links"))

    def first_of_url(link: Column, i: Column) -> Column:
        before = F.element_at("_links", F.greatest(i, F.lit(1)))
        return (i == 0) | (before["url"] != link["url"])

    kept = ordered.select(
        key,
        F.array_sort(
            F.transform(
                F.filter("_links", first_of_url),
                lambda x: F.struct(x["place"], x["url"], x["href"], x["title"]),
            )
        ).alias("_links"),
    )
    return kept.select(key, F.posexplode(each("_links")).alias("_at", "link")).select(
        key,
        (F.col("_at") + 1).cast("long").alias("index"),
        chapter_id(F.col("link.href")).alias("id"),
        F.col("link.title").alias("title"),
        F.col("link.url").alias("url"),
    )


def _contents(content: str, title: str, remove: Sequence[str]):
    names = ["title", "main", "body"]

    @F.arrow_udf("title string, main string, body string")
    def read(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(html: str) -> tuple[str, str | None, str | None]:
            root = markup.parse(html or "")
            heading = next(iter(markup.select(root, title)), None)
            name = markup.stripped_strings(heading) if heading else ""
            for selector in remove:
                for node in markup.select(root, selector):
                    node.gone = True
            found = next(iter(markup.select(root, content)), None)
            main = markup.text_of(found, breaks=True) if found else None
            body = next(iter(markup.select(root, "body")), None)
            if body is None:
                return name, main, None
            for node in markup.select(body, "header, footer, nav, aside"):
                node.gone = True
            if heading:
                heading.gone = True
            return name, main, markup.text_of(body, breaks=True)

        for batch in pages:
            for piece in sliced(batch):
                fields = zip(*[one(h) for h in batch[piece].to_pylist()], strict=True)
                yield pa.StructArray.from_arrays([pa.array(f, pa.string()) for f in fields], names)

    return read


def without_boilerplate(
    text: Column,
    words: Sequence[str] = tuple(fixed.NAVIGATION_WORDS),
    shortest: int = fixed.MIN_LINE,
    separator: str = fixed.PARAGRAPH_BREAK,
) -> Column:
    """Paragraphs that are long enough and have no navigation word."""

    def kept(line: Column) -> Column:
        found = F.length(strip(line)) >= shortest
        for word in words:
            found = found & ~line.contains(word)
        return found

    return F.array_join(F.filter(F.split(text, separator, -1), kept), separator)


def extract_main_text(
    pages: DataFrame,
    content: str,
    title: str,
    remove: Sequence[str] = (),
    html: str = "html",
    navigation: Sequence[str] = tuple(fixed.NAVIGATION_WORDS),
    shortest: int = fixed.MIN_MAIN_TEXT,
) -> DataFrame:
    """Title and text of every page, and whether the content element was good enough.

    A content text of more than ``shortest`` characters is taken; otherwise the body without
    headers, footers, navigation and title, less its boilerplate lines.
    """
    others = [c for c in pages.columns if c != html]
    read = pages.withColumn("_page", _contents(content, title, list(remove))(F.col(html)))
    body = without_boilerplate(lines_to_paragraphs(F.col("_page.body")), navigation)

    def choose(main: Column) -> Column:
        good = F.coalesce(F.length(main) > shortest, F.lit(False))
        text = F.when(good, main).otherwise(F.coalesce(body, main, F.lit("")))
        return F.struct(text.alias("text"), good.alias("from_content"))

    chosen = let(lines_to_paragraphs(F.col("_page.main")), choose)
    return read.select(
        *others, F.col("_page.title").alias("title"), F.inline(F.array(chosen))
    )


def analysis_html(pages: DataFrame, html: str = "html", size: int = fixed.HTML_SIZE) -> DataFrame:
    """Markup without scripts and styles, cut to the size an analysis takes."""
    clean = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    return pages.withColumn(html, F.left(clean, F.lit(size)))
