"""Column functions against known values."""

import pytest
from pyspark.sql import functions as F

from folioloom.functions import blocks, replies, text, urls
from folioloom.operators.quality import repaired_first_line
from folioloom.operators.status import chapter_range


@pytest.mark.parametrize(
    ("spec", "last", "expected"),
    [
        ("1-3,5,8-10", 100, [1, 2, 3, 5, 8, 9, 10]),
        ("1-1000", 50, list(range(1, 51))),
        ("100", 50, []),
        ("", 10, list(range(1, 11))),
        ("5-3", 10, []),
        ("0-3", 10, [0, 1, 2, 3]),
        (" 2 , 4 - 5 ,2", 10, [2, 4, 5]),
    ],
)
def test_chapter_range(value, spec, last, expected):
    assert value(chapter_range(F.col("s"), F.col("n").cast("long")), s=spec, n=last) == expected


@pytest.mark.parametrize(
    ("title", "slug"),
    [
        ("Hello World", "hello-world"),
        ("剑来 Chapter 1", "剑来-chapter-1"),
        ("  a_b  c!? ", "a-b-c"),
        ("!!!", "unknown-book"),
        ("x" * 80, "x" * 50),
        ("éa", "ea"),
    ],
)
def test_slugify(value, title, slug):
    assert value(text.slugify(F.col("t")), t=title) == slug


@pytest.mark.parametrize(
    ("href", "expected"),
    [
        ("/html/8/8717/5588734.html", "5588734"),
        ("5588734.htm", "5588734"),
        ("/book/chapter-one/", "chapter-one"),
        ("/", "/"),
        ("http://e.com/a/b?x=1", "b"),
        ("http://e.com/a/b?x=1.html", "1"),
    ],
)
def test_chapter_id(value, href, expected):
    assert value(urls.chapter_id(F.col("h")), h=href) == expected


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("http://e.com/html/8/8717/index.html", "8717-indexhtml"),
        ("http://e.com/book", "book"),
        ("http://e.com/", ""),
        ("http://e.com", ""),
        ("http://e.com/a/b/c/", "b-c"),
    ],
)
def test_book_slug(value, url, expected):
    assert value(urls.book_slug(F.col("u")), u=url) == expected


# The examples of section 5.4 of RFC 3986, base http://a/b/c/d;p?q, and absolute forms.
RFC = [
    ("g", "http://a/b/c/g"),
    ("./g", "http://a/b/c/g"),
    ("g/", "http://a/b/c/g/"),
    ("/g", "http://a/g"),
    ("//g", "http://g"),
    ("?y", "http://a/b/c/d;p?y"),
    ("g?y", "http://a/b/c/g?y"),
    ("#s", "http://a/b/c/d;p?q#s"),
    ("g#s", "http://a/b/c/g#s"),
    ("g?y#s", "http://a/b/c/g?y#s"),
    ("", "http://a/b/c/d;p?q"),
    (".", "http://a/b/c/"),
    ("./", "http://a/b/c/"),
    ("..", "http://a/b/"),
    ("../g", "http://a/b/g"),
    ("../..", "http://a/"),
    ("../../g", "http://a/g"),
    ("../../../g", "http://a/g"),
    ("/./g", "http://a/g"),
    ("/../g", "http://a/g"),
    ("g.", "http://a/b/c/g."),
    ("./../g", "http://a/b/g"),
    ("g/./h", "http://a/b/c/g/h"),
    ("g/../h", "http://a/b/c/h"),
    ("mailto:x@y", "mailto:x@y"),
    ("https://b/c", "https://b/c"),
]


def test_resolve_url(spark):
    rows = spark.createDataFrame(RFC, "ref string, expected string")
    found = rows.select("ref", "expected", urls.resolve_url(F.lit("http://a/b/c/d;p?q"), F.col("ref")).alias("url"))
    assert [r for r in found.collect() if r.url != r.expected] == []


@pytest.mark.parametrize(
    "given",
    ["Chương 1715:  Thiên Ma Truyền Thuyết  ", "Chương 1715 – Thiên Ma Truyền Thuyết", "Thiên Ma Truyền Thuyết",
     "chương 1715　—- Thiên  Ma Truyền Thuyết"],
)
def test_normalize_title(value, given):
    got = value(text.normalize_title(F.col("v"), F.col("c")), v=given, c="第1715章 天魔传说")
    assert got == "Chương 1715 Thiên Ma Truyền Thuyết"


def test_normalize_title_without_number(value):
    assert value(text.normalize_title(F.col("v"), F.col("c")), v=" a  b", c="序章") == " a  b"


@pytest.mark.parametrize(
    ("line", "title", "expected"),
    [
        ("Chương 1622: Cấp Tai Họa", "第1664章 灾难级", "Chương 1664: Cấp Tai Họa"),
        ("Chương 1664: Cấp Tai Họa", "第1664章 灾难级", None),
        ("Chương 3 Tên Mới", "第4章", "Chương 4: Tên Mới"),
        ("Chương 3", "第4章", "Chương 4"),
        ("Mở đầu", "第4章", None),
        ("Chương 3: x", "序章", None),
    ],
)
def test_repaired_first_line(value, line, title, expected):
    assert value(repaired_first_line(F.col("l"), F.col("t")), l=line, t=title) == expected


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        ('{"a": 1}', '{"a": 1}'),
        ('Here:\n```json\n{"a": 1}\n```\nbye', '{"a": 1}'),
        ('```\n{"a": 2}\n```', '{"a": 2}'),
        ('I think {"a": {"b": 3}} is it', '{"a": {"b": 3}}'),
        ("no json at all", "{}"),
        ("{broken", "{}"),
        ('{"a": 1} {"b": 2}', "{}"),
        ("", "{}"),
    ],
)
def test_lenient_json(value, reply, expected):
    assert value(replies.lenient_json(F.col("r")), r=reply) == expected


@pytest.mark.parametrize(
    ("reply", "text_part", "state"),
    [
        ("  plain \n", "plain", "{}"),
        ('out\n---STATE---\n{"speaker": "A"}', "out", '{"speaker": "A"}'),
        ("out\n---STATE---\n{bad", "out\n---STATE---\n{bad", "{}"),
        ("out\n---STATE---\n[1]", "out", "{}"),
        ("out\n---STATE---\n", "out\n---STATE---", "{}"),
        ('a---STATE---{"x":1}---STATE---', 'a---STATE---{"x":1}---STATE---', "{}"),
    ],
)
def test_parse_state(value, reply, text_part, state):
    got = value(replies.parse_state(F.col("r")), r=reply)
    assert (got["text"], got["state_json"]) == (text_part, state)


def test_parse_entries(value):
    good = 'x [{"chinese": "王林", "vietnamese": "Vương Lâm", "category": "character", "notes": "n"}, {"chinese": "a", "vietnamese": "b"}] y'
    got = value(replies.parse_entries(F.col("r")), r=good)
    assert [tuple(e) for e in got] == [("王林", "Vương Lâm", "character", "n"), ("a", "b", "general", None)]
    limited = value(replies.parse_entries(F.col("r"), 1), r=good)
    assert len(limited) == 1
    for bad in (
        '[{"chinese": "a", "vietnamese": "b"}, {"chinese": "c"}]',
        '[{"chinese": 1, "vietnamese": "b"}]',
        '[{"chinese": "a", "vietnamese": "b", "category": null}]',
        '["a"]',
        "[oops]",
        "nothing",
    ):
        assert value(replies.parse_entries(F.col("r")), r=bad) == [], bad
    late = '[{"chinese": "a", "vietnamese": "b"}, {"chinese": "c"}]'
    assert len(value(replies.parse_entries(F.col("r"), 1), r=late)) == 1


def test_whitespace_is_unicode(value):
    assert value(text.strip(F.col("t")), t="　 a b \n") == "a b"
    assert value(text.lines_to_paragraphs(F.col("t")), t=" a　　b \r\n\n  \n c\td  e ") == "a b\n\nc d e"


def test_sentences_keep_marks(value):
    assert value(text.split_sentences(F.col("t")), t="一。二！？三") == ["一。", "二！", "？", "三"]
    assert value(text.split_sentences(F.col("t")), t="一。") == ["一。", ""]


def test_dialogue_markers(value):
    talk = text.is_dialogue(F.col("t"))
    assert value(talk, t='他"好"') and value(talk, t="「好」") and value(talk, t="他笑道")
    assert not value(talk, t="他走了") and not value(talk, t="“好”")
    assert value(text.is_dialogue(F.col("t"), ["“", "”"]), t="“好”")


def test_replace_words(value):
    got = value(text.replace_words(F.col("t")), t="And or, android order_of of!  But 和and and")
    assert got == "Và hoặc, android order_of của!  Nhưng 和and và"


def test_small_scalars(value):
    assert value(text.percent(F.col("a"), F.col("b")), a=1, b=8) == 13
    assert value(text.percent(F.col("a"), F.col("b")), a=1, b=0) == 0
    assert value(text.pad_key(F.col("a")), a=7) == "0007"
    assert value(text.pad_key(F.col("a")), a=12345) == "12345"
    assert value(text.occurrences(F.col("t"), F.col("w")), t="aaaa é", w="aa") == 2
    assert value(text.fallback(F.col("a"), F.col("b")), a="", b="x") == "x"


@pytest.mark.parametrize(
    ("title_vi", "body", "title_cn", "expected"),
    [
        ("Tên", "# Khác\n\nx", "第一章", "Tên"),
        ("", "# Giới thiệu\n\nĐây", "第一章", "Giới thiệu"),
        (None, "Đây", "第一章", "第一章"),
        (None, "Đây", "", "Chương 4"),
        (None, "##\nx", "第一章", ""),
    ],
)
def test_display_title(spark, title_vi, body, title_cn, expected):
    row = spark.createDataFrame([(title_vi, body, title_cn, 4)], "v string, t string, c string, i long")
    title = text.display_title(F.col("v"), F.col("t"), F.col("c"), F.col("i"))
    assert row.select(title.alias("x")).first().x == expected


def test_paragraphs_html(value):
    body = "# Title\n\nĐây là\nđoạn <đầu>.\n\n\n\n  Hai & ba "
    plain = value(text.paragraphs_html(F.col("t"), ""), t=body)
    assert plain == "<p>Đây là đoạn <đầu>.</p>\n<p>Hai & ba</p>"
    escaped = value(text.paragraphs_html(F.col("t"), "", escaped=True), t=body)
    assert escaped == "<p># Title</p>\n<p>Đây là\nđoạn &lt;đầu&gt;.</p>\n<p>Hai &amp; ba</p>"


def test_naming_rules(spark):
    rows = spark.createDataFrame(
        [("s", ["Dịch TÊN riêng", "Giữ nhịp"]), ("t", ["Giữ nhịp"]), ("u", [])], "n string, g array<string>"
    )
    got = [r.x for r in rows.select(blocks.naming_rules(F.col("n"), F.col("g")).alias("x")).collect()]
    assert got[0].endswith("'s':**\n- Dịch TÊN riêng")
    assert got[1] == got[2] and got[1].startswith("**Quy tắc dịch tên**")


@pytest.mark.parametrize(
    ("seconds", "panel", "listed"),
    [(59.9, "59s ago", "59s ago"), (60.0, "1m ago", "1m ago"), (3661.0, "1h 1m ago", "1h ago"), (90000.0, "25h 0m ago", "1d ago")],
)
def test_elapsed_label(value, seconds, panel, listed):
    assert value(blocks.elapsed_label(F.col("s")), s=seconds) == panel
    assert value(blocks.elapsed_label(F.col("s"), days=True), s=seconds) == listed
