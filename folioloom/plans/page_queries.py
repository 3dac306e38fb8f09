"""Queries over pages, links, bytes and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.functions import replies, text as tx, urls
from folioloom.operators import pages as pg
from folioloom.plans import adapters as ad
from folioloom.plans.registry import query
from folioloom.sources.decode import decode_bytes, normalize_encoding

_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
_LINKS = f"""
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place) AS index, id, title, url FROM (
      SELECT page_id, place, href AS title_href, title, {_ORIGIN} || href AS url,
             CASE WHEN regexp_matches(href, '[0-9]+\\.html?$') THEN regexp_extract(href, '([0-9]+)\\.html?$', 1)
                  ELSE regexp_extract(href, '([^/]*)$', 1) END AS id
      FROM (SELECT page_id, url, unnest(hrefs) AS href, unnest(titles) AS title, generate_subscripts(hrefs, 1) AS place
            FROM (SELECT page_id, url,
                         regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
                         regexp_extract_all(nav, '<a href="([^"]*)">([^<]*)</a>', 2) AS titles
                  FROM (SELECT page_id, url, split_part(split_part(html, '<nav>', 2), '</nav>', 1) AS nav FROM pages)))
      WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:')
      QUALIFY row_number() OVER (PARTITION BY page_id, {_ORIGIN} || href ORDER BY place) = 1)
"""


@query(_LINKS)
def link_extract(spark, sf_dir):
    """Links of the navigation of every page, once each, numbered."""
    return pg.extract_links(ad.pages(spark, sf_dir, "url", "html"), "nav a")


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©")]


def _plain(html: str) -> str:
    """SQL that turns markup into squeezed lines."""
    text = f"regexp_replace({html}, '<br>', chr(10), 'g')"
    text = f"regexp_replace({text}, '</?p>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<!--.*?-->', '', 'gs')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for entity, mark in _ENTITIES:
        text = f"replace({text}, '{entity}', '{mark}')"
    # HTML also knows this entity without its semicolon, as cut-off pages have it.
    text = f"regexp_replace({text}, '&amp;?', '&', 'g')"
    line = "trim(regexp_replace(l, '[\\s\\p{Z}]+', ' ', 'g'))"
    return (
        f"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda l: {line}), "
        "lambda l: l <> ''), chr(10) || chr(10))"
    )


PLAIN_TITLE = _plain("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")
PLAIN_ARTICLE = _plain(
    "replace(split_part(split_part(html, '<article>', 2), '</article>', 1), '</h1><p>', '')"
)


@query(
    f"""SELECT page_id, title, body AS text, true AS from_content FROM (
          SELECT page_id, {PLAIN_TITLE} AS title, {PLAIN_ARTICLE} AS body FROM pages)
        WHERE length(body) > 100"""
)
def main_text(spark, sf_dir):
    """Title and main text of the pages whose content element is good enough."""
    pages = ad.pages(spark, sf_dir, "html")
    return pg.extract_main_text(pages, "article", "h1", ["script", "style"]).filter("from_content")


_BODY = "regexp_replace(split_part(html, '<body>', 2), '<(nav|footer|header|aside)>.*?</(nav|footer|header|aside)>', '', 'gs')"
_BODY = f"regexp_replace({_BODY}, '<h1>.*?</h1>', '', 's')"
_BODY = f"regexp_replace({_BODY}, '<article>\\s*<p>', '')"


BODY_LINES = f"""array_to_string(list_filter(string_split({_plain(_BODY)}, chr(10) || chr(10)),
               lambda l: length(l) >= 10), chr(10) || chr(10))"""


@query(f"SELECT page_id, {PLAIN_TITLE} AS title, {BODY_LINES} AS text, false AS from_content FROM pages")
def main_text_fallback(spark, sf_dir):
    """Text of every page by the way for pages without a content element."""
    pages = ad.pages(spark, sf_dir, "html")
    return pg.extract_main_text(pages, "#content", "h1", ["script", "style"])


@query(
    """SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l:
              length(trim(l)) >= 10 AND NOT contains(l, 'vipa') AND NOT contains(l, 'dans')
              AND NOT contains(l, 'nicht')), chr(10)) AS text FROM documents"""
)
def nav_line_filter(spark, sf_dir):
    """Texts without short lines and lines with navigation words."""
    docs = ad.documents(spark, sf_dir)
    kept = pg.without_boilerplate(F.col("text"), ["vipa", "dans", "nicht"], separator="\n")
    return docs.select("doc_id", kept.alias("text"))


@query(
    """SELECT page_id, left(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gs'),
              '<style[^>]*>.*?</style>', '', 'gs'), 15000) AS html FROM pages"""
)
def analysis_html(spark, sf_dir):
    """Markup without scripts and styles, cut to the size for an analysis."""
    return pg.analysis_html(ad.pages(spark, sf_dir, "html"))


@query(
    """SELECT doc_id, CASE WHEN t = '' THEN 'unknown-book' ELSE left(lower(t), 50) END AS slug FROM (
         SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\s\\p{Z}-]', '', 'g'),
                '[\\s\\p{Z}_]+', '-', 'g'), '-') AS t FROM documents)"""
)
def slugify(spark, sf_dir):
    """Texts as slugs."""
    docs = ad.documents(spark, sf_dir)
    return docs.select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query(
    """SELECT page_id, regexp_replace(array_to_string(parts[-2:], '-'), '[^\\p{L}\\p{N}_-]', '', 'g') AS book_slug,
              CASE WHEN regexp_matches(url, '[0-9]+\\.html?$') THEN regexp_extract(url, '([0-9]+)\\.html?$', 1)
                   WHEN trim(path, '/') = '' THEN url ELSE parts[-1] END AS chapter_id,
              origin || regexp_extract(path, '^(.*/)', 1) || 'n' || page_id || '.html' AS next_url
       FROM (SELECT *, string_split(trim(path, '/'), '/') AS parts FROM (
         SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin,
                CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
                     ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS path FROM pages))"""
)
def url_parts(spark, sf_dir):
    """Slug, id and a resolved neighbour of every page URL."""
    pages = ad.table(spark, sf_dir, "pages").select("page_id", "url")
    link = F.concat(F.lit("./x/../n"), F.col("page_id").cast("string"), F.lit(".html"))
    return pages.select(
        "page_id",
        urls.book_slug(F.col("url")).alias("book_slug"),
        urls.chapter_id(F.col("url")).alias("chapter_id"),
        urls.resolve_url(F.col("url"), link).alias("next_url"),
    )


@query("SELECT doc_id, text, CASE WHEN lang = 'es' THEN 'gbk' ELSE 'utf-8' END AS encoding FROM documents")
def decode_utf8(spark, sf_dir):
    """Bytes of the texts decoded again, the fast way for valid UTF-8, and normal labels."""
    docs = ad.documents(spark, sf_dir, "text", "lang")
    label = normalize_encoding(F.when(F.col("lang") == "es", "GB2312"))
    content = F.encode("text", "UTF-8")
    text = decode_bytes(content, F.lit("utf-8"))
    return docs.select("doc_id", text.alias("text"), label.alias("encoding"))


@query()
def decode_bytes_chain(spark, sf_dir):
    """Bytes of the texts decoded under a label that does not fit all of them."""
    docs = ad.documents(spark, sf_dir)
    return docs.select("doc_id", decode_bytes(F.encode("text", "UTF-8"), F.lit("ascii")).alias("text"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN '{}' ELSE '{"n":' || n_chars || ',"s":"' || source || '"}' END
              AS json FROM documents"""
)
def lenient_json(spark, sf_dir):
    """JSON of replies: plain, fenced, among prose, and missing."""
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    body = F.concat(F.lit('{"n":'), F.col("n_chars").cast("string"), F.lit(',"s":"'), F.col("source"), F.lit('"}'))
    kind = F.col("doc_id") % 4
    reply = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone")))
        .when(kind == 2, F.concat(F.lit("It is "), body, F.lit(" so")))
        .otherwise(F.concat(F.lit("{broken"), F.col("source")))
    )
    return docs.select("doc_id", replies.lenient_json(reply).alias("json"))


@query(
    """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN b WHEN 1 THEN b ELSE b || chr(10) || '---STATE---' || chr(10) || '{"speaker' END
              AS text,
              CASE turn % 3 WHEN 1 THEN '{"speaker":"' || role || '"}' ELSE '{}' END AS state_json,
              CASE turn % 3 WHEN 1 THEN role END AS speaker
       FROM (SELECT conv_id, turn, role, regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS b FROM conversations)"""
)
def state_parse(spark, sf_dir):
    """Replies split at their state: none, good, and broken ones."""
    turns = ad.table(spark, sf_dir, "conversations")
    kind = F.col("turn") % 3
    block = F.when(kind == 1, F.concat(F.lit('{"speaker":"'), F.col("role"), F.lit('"}\n'))).otherwise(
        F.lit('{"speaker')
    )
    reply = F.when(kind == 0, F.col("text")).otherwise(
        F.concat(F.col("text"), F.lit("\n---STATE---\n"), block)
    )
    parsed = turns.select("conv_id", "turn", replies.parse_state(reply).alias("p"))
    return parsed.select(
        "conv_id", "turn", "p.text", "p.state_json",
        replies.state_fields(F.col("p.state_json"))["speaker"].alias("speaker"),
    )
