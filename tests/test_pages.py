"""Pages, bytes, files and assembled books."""

import json
import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from folioloom.operators import assemble, pages
from folioloom.plans.catalog import QUERIES
from folioloom.sources import decode, readers, writers

PAGE = "page_id long, url string, html string"


def test_links_of_a_list(spark):
    html = """<section class="parts"><p><a href="27.html">Dawn 1</a></p><p><a href="28.html"> <i>Noon</i> 2</a>
      <p><a href="#up">x</a><a href="javascript:void(0)">y</a><a>z</a><a href="./27.html">once more</a>
      <p><a href="31.html">Dusk 3</a></section><a href="40.html">elsewhere</a>"""
    rows = spark.createDataFrame([(1, "http://tales.test/", html)], PAGE)
    got = [tuple(r) for r in pages.extract_links(rows, ".parts a").orderBy("index").collect()]
    assert got == [
        (1, 1, "27", "Dawn 1", "http://tales.test/27.html"),
        (1, 2, "28", "Noon2", "http://tales.test/28.html"),
        (1, 3, "31", "Dusk 3", "http://tales.test/31.html"),
    ]
    assert pages.extract_links(rows, "section.parts p a, #none a").count() == 3


LONG = "这是一段足够长的正文内容。" * 12


@pytest.mark.parametrize(
    ("html", "title", "text", "from_content"),
    [
        (f"<body><h1> T </h1><div id=c><p>a  b<br>c</p><script>x</script>{LONG}</div></body>", "T", f"a b\n\nc\n\n{LONG}", True),
        (f"<body><h1>T</h1><nav>menu</nav><div id=c>short</div><br><p>{LONG}<p>下一章 is here for you<p>tiny<footer>f</footer></body>", "T", LONG, False),
        (f"<body><h1>T</h1><p>{LONG}</p></body>", "T", LONG, False),
        (f"<body><div id=c><p>{LONG}</p><p>第二</div></body>", "", f"{LONG}\n\n第二", True),
        (f"<body><div id=c>&lt;a&gt; &amp; {LONG}<!-- no --></div>", "", f"<a> & {LONG}", True),
        ("", "", "", False),
    ],
)
def test_main_text(spark, html, title, text, from_content):
    rows = spark.createDataFrame([(1, "u", html)], PAGE)
    got = pages.extract_main_text(rows, "#c", "h1", ["script", "", "style"]).first()
    assert (got.title, got.text, got.from_content) == (title, text, from_content)


def test_decode_equals_the_chain(spark):
    samples = [
        ("中文内容".encode("gbk"), "gbk", "中文内容"),
        ("中文内容".encode(), "utf-8", "中文内容"),
        ("中文内容".encode("gbk"), "utf-8", "中文内容"),
        ("café".encode("latin-1"), "ascii", "café"),
        ("𠀀中".encode("gb18030"), "utf-8", "𠀀中"),
        (b"plain", "no-such-code", "plain"),
        (b"", "utf-8", ""),
    ]
    rows = spark.createDataFrame([(i, bytearray(b), e) for i, (b, e, _) in enumerate(samples)], "i long, b binary, e string")
    got = [r.t for r in rows.orderBy("i").select(decode.decode_bytes(F.col("b"), F.col("e")).alias("t")).collect()]
    assert got == [t for _, _, t in samples]
    labels = spark.createDataFrame([("GB2312",), ("gb18030",), (None,), ("big5",)], "e string")
    assert [r.x for r in labels.select(decode.normalize_encoding(F.col("e")).alias("x")).collect()] == ["gbk", "gbk", "utf-8", "big5"]


def test_library_files(spark, tmp_path):
    for name, status in (("b-one", "translated"), ("a two", "pending")):
        folder = tmp_path / name
        (folder / "raw").mkdir(parents=True)
        (folder / "translated").mkdir()
        book = {"url": "u", "title": name, "chapters": [{"index": 2, "title_cn": "二", "status": status}, {"index": 1, "title_cn": "一"}]}
        (folder / "book.json").write_text(json.dumps(book, indent=1), encoding="utf-8")
        (folder / "raw" / "0001_第一章.txt").write_text("# 第一章\n\nx", encoding="utf-8")
        (folder / "translated" / "0002_old.txt").write_text("old", encoding="utf-8")
        (folder / "translated" / "2.txt").write_text("new", encoding="utf-8")
        (folder / "translated" / "0003_x.txt").write_text("three", encoding="utf-8")
        (folder / "translated" / "notes.txt").write_text("no key", encoding="utf-8")
    (tmp_path / "empty").mkdir()
    (tmp_path / "b-one" / "last_pipeline_settings.json").write_text('{"style": "s"}')
    library = str(tmp_path)
    books = readers.scan_books(spark, library)
    assert sorted(r.book_id for r in books.collect()) == ["a two", "b-one"]
    listed = readers.scan_chapters(books).filter("book_id = 'b-one'").orderBy("position").collect()
    assert [(r["index"], r.status) for r in listed] == [(2, "translated"), (1, None)]
    raw = readers.scan_texts(spark, library)
    assert sorted((r.book_id, r.file_name) for r in raw.collect()) == [("a two", "0001_第一章.txt"), ("b-one", "0001_第一章.txt")]
    keyed = readers.keyed_texts(readers.scan_texts(spark, library, "translated")).filter("book_id = 'b-one'")
    assert sorted((r["index"], r.text) for r in keyed.collect()) == [(2, "new"), (3, "three")]
    assert [r.book_id for r in readers.read_settings(spark, library).collect()] == ["b-one"]


def test_glossary_csv_round_trip(spark, tmp_path):
    source = tmp_path / "g.csv"
    source.write_text('chinese,vietnamese,category,notes\n王林,"Vương, ""Lâm""",character,Main\n练气,Luyện Khí,,\n王林,b,item,"two\nlines"\n', encoding="utf-8")
    read = readers.read_glossary_csv(spark, str(source))
    first = [tuple(r)[:4] for r in read.orderBy("ordinal").collect()]
    assert first == [("王林", 'Vương, "Lâm"', "character", "Main"), ("练气", "Luyện Khí", "", None), ("王林", "b", "item", "two\nlines")]
    writers.write_glossary_csv(read, str(tmp_path / "out"))
    again = readers.read_glossary_csv(spark, str(tmp_path / "out"), empty_notes=True)
    assert [tuple(r)[:4] for r in again.orderBy("ordinal").collect()] == [(*r[:3], r[3] or "") for r in first]
    folder = tmp_path / "several"
    folder.mkdir()
    (folder / "a.csv").write_text("chinese,vietnamese\na0,x\n", encoding="utf-8")
    (folder / "b.csv").write_text("chinese,vietnamese\n" + "".join(f"b{i},x\n" for i in range(50)), encoding="utf-8")
    several = readers.read_glossary_csv(spark, str(folder)).orderBy("ordinal").collect()
    assert [r.term for r in several] == ["a0"] + [f"b{i}" for i in range(50)]
    short = tmp_path / "s.csv"
    short.write_text("chinese,vietnamese\na,b\n", encoding="utf-8")
    assert readers.read_glossary_csv(spark, str(short)).first().category == "general"
    bad = tmp_path / "bad.csv"
    bad.write_text("chinese,other\na,b\n", encoding="utf-8")
    with pytest.raises(ValueError):
        readers.read_glossary_csv(spark, str(bad))


CHAPTER = "book_id string, index long, title_vi string, title_cn string, text string"
BOOK = "book_id string, title string, title_vi string, author string, author_vi string, translator string, description string"


def books_and_chapters(spark):
    books = spark.createDataFrame([("b", "书", "Sách <1>", "作者", "", "AI", 'a "b"'), ("none", "n", "", "", "", "AI", "")], BOOK)
    chapters = spark.createDataFrame(
        [("b", 3, "", "第三章", "# Ba\n\nMột\n\nHai & ba"), ("b", 1, "Giới thiệu", "第一章", "Đây"), ("b", 7, None, "", "x")], CHAPTER
    )
    return assemble.book_metadata(books), chapters


@pytest.mark.parametrize("size", [1, 2, 100])
def test_book_html_in_segments(spark, size):
    books, chapters = books_and_chapters(spark)
    parts = assemble.book_html(books, chapters, size).orderBy("part", "segment").collect()
    assert {r.book_id for r in parts} == {"b"}
    html = "".join(r.html for r in parts)
    assert html.startswith("<!DOCTYPE html>") and html.endswith("</html>\n")
    assert '<meta name="description" content="a &quot;b&quot;">' in html
    assert "<p>AI</p>" in html and html.count("<ol>") == html.count("</ol>") == 1
    assert html.index("</ol>") < html.index("<section")
    assert assemble.book_html(books.filter("book_id = 'b'"), chapters, size, complete=True).orderBy("part", "segment").collect() == parts
    toc = ['<li><a href="#chapter-1">Giới thiệu</a></li>', '<li><a href="#chapter-3">Ba</a></li>', '<li><a href="#chapter-7">Chương 7</a></li>']
    assert "\n".join(toc) in html
    assert html.index('id="chapter-1"') < html.index('id="chapter-3"') < html.index('id="chapter-7"')
    assert [r.book_id for r in assemble.books_without_text(books, chapters).collect()] == ["none"]


@pytest.mark.parametrize("size", [1, 100])
def test_ebook_parts(spark, size):
    books, chapters = books_and_chapters(spark)
    files = {}
    for r in assemble.ebook_parts(books, chapters, size).orderBy("path", "segment").collect():
        files[r.path] = files[r.path] + "\n" + r.content if r.path in files else r.content
    assert sorted(p for p in files if "chapters/" in p) == [f"OEBPS/chapters/chapter_000{i}.xhtml" for i in (1, 2, 3)]
    assert "<p># Ba</p>\n    <p>Một</p>\n    <p>Hai &amp; ba</p>" in files["OEBPS/chapters/chapter_0002.xhtml"]
    opf = files["OEBPS/content.opf"]
    assert "Sách &lt;1&gt;" in opf and opf.index('item id="chapter0003"') < opf.index('itemref idref="chapter0001"')
    assert opf.endswith("</package>") and files["OEBPS/toc.ncx"].count("<navPoint") == 3
    assert "META-INF/container.xml" in files and "OEBPS/titlepage.xhtml" in files
    check_ebook(files)


def check_ebook(files):
    """Every part parses, every reference has its item, and every item its file."""
    trees = {p: ElementTree.fromstring(text.encode()) for p, text in files.items() if not p.endswith(".css")}
    opf = trees["OEBPS/content.opf"]
    found = lambda name, key: [e.get(key) for e in opf.iter() if e.tag.endswith("}" + name)]
    ids, places = found("item", "id"), found("item", "href")
    assert len(set(ids)) == len(ids) and set(found("itemref", "idref") + found("spine", "toc")) <= set(ids)
    assert {f"OEBPS/{p}" for p in places} == set(files) - {"OEBPS/content.opf", "META-INF/container.xml"}
    assert opf.find(".//{http://purl.org/dc/elements/1.1/}language").text == "vi"
    points = [e.get("src") for e in trees["OEBPS/toc.ncx"].iter() if e.tag.endswith("}content")]
    assert points and set(points) <= set(places)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_ebooks_of_the_tables(spark):
    books = {}
    for r in QUERIES["ebook_parts"](spark, "/root/testdata/sf0.001").orderBy("book_id", "path", "segment").collect():
        files = books.setdefault(r.book_id, {})
        files[r.path] = files[r.path] + "\n" + r.content if r.path in files else r.content
    assert books
    for files in books.values():
        check_ebook(files)


def test_written_chapters(spark, tmp_path):
    _, chapters = books_and_chapters(spark)
    writers.write_raw_chapters(chapters, str(tmp_path / "raw"))
    raw = {r.file_name: r.text for r in spark.read.parquet(str(tmp_path / "raw")).collect()}
    assert raw["0001_第一章.txt"] == "# 第一章\n\nĐây" and "0007_unknown-book.txt" in raw
    writers.write_translations(chapters, str(tmp_path / "vi"))
    assert {r.file_name for r in spark.read.parquet(str(tmp_path / "vi")).collect()} == {"1.txt", "3.txt", "7.txt"}
    books, chapters = books_and_chapters(spark)
    writers.write_parts(assemble.book_html(books, chapters), str(tmp_path / "html"))
    assert spark.read.parquet(str(tmp_path / "html")).count() == 5


def test_aligned_paragraphs_and_tails(spark):
    pairs = spark.createDataFrame([(1, "a\n\n\nb\n\n", "x")], "id long, s string, t string")
    got = assemble.align_paragraphs(pairs, "s", "t", ["id"]).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a", "x"), (1, 1, "b", "")]
    _, chapters = books_and_chapters(spark)
    tails = assemble.previous_tail(chapters, size=2).orderBy("index").collect()
    assert [(r["index"], r.previous_tail) for r in tails] == [(1, None), (3, "ây"), (7, "ba")]
