"""Ordering, glossaries, states, styles and events on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from folioloom.operators import events as ev
from folioloom.operators import glossary as gl
from folioloom.operators import ordering
from folioloom.operators import status as st
from folioloom.operators import styles as sy

GLOSSARY = "term string, target string, category string, notes string, ordinal long"
CHANGES = "term string, target string, category string, notes string, seq long"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_positions_do_not_depend_on_cells(spark, width):
    rng = random.Random(width)
    # One group holds most rows.
    data = [("hot" if rng.random() < 0.7 else f"g{i % 5}", i * 7 % 1009, rng.random() < 0.2) for i in range(400)]
    df = spark.createDataFrame(data, "g string, o long, has boolean")
    groups = {}
    for g, o, has in sorted(data):
        groups.setdefault(g, []).append((o, has))
    numbered = ordering.number_rows(df, "g", "o", "n", width)
    expected = sorted((g, o, i) for g, items in groups.items() for i, (o, _) in enumerate(items, 1))
    assert rows(numbered, "g", "o", "n") == expected
    near = ordering.nearest_marked(df, "g", "o", F.col("has"), "p", "f", width)
    expected = []
    for g, items in groups.items():
        for o, _ in items:
            before = [x for x, has in items if has and x < o]
            after = [x for x, has in items if has and x > o]
            expected.append((g, o, max(before, default=-1), min(after, default=-1)))
    assert rows(near.fillna(-1, ["p", "f"]), "g", "o", "p", "f") == sorted(expected)


def test_segments_read_as_one_text(spark):
    df = spark.createDataFrame([("b", i, f"t{i}") for i in range(1, 26)], "g string, n long, t string")
    got = ordering.concat_segments(df, "g", "n", "t", 10).orderBy("segment").collect()
    assert [r.n_parts for r in got] == [10, 10, 5]
    assert "\n".join(r.t for r in got) == "\n".join(f"t{i}" for i in range(1, 26))


def test_upsert_keeps_places_and_last_change(spark):
    base = spark.createDataFrame(
        [("a", "A", "item", None, 0), ("b", "B", "item", "n", 1), ("a", "A2", "item", None, 2), ("c", "C", "misc", None, 3)],
        GLOSSARY,
    )
    changes = spark.createDataFrame(
        [("b", "B1", "realm", "x", 0), ("z", "Z1", "item", None, 1), ("b", "B2", "general", None, 2),
         ("z", "Z2", "item", None, 3), ("a", "A9", "item", None, 4)],
        CHANGES,
    )
    got = [tuple(r) for r in gl.upsert(base, changes).orderBy("ordinal").collect()]
    assert got == [
        ("a", "A9", "item", None, 0),
        ("b", "B2", "general", None, 1),
        ("a", "A2", "item", None, 2),
        ("c", "C", "misc", None, 3),
        ("z", "Z2", "item", None, 5),
    ]
    assert gl.upsert(base.limit(0), changes).count() == 3
    assert gl.lookup(base, "a").first().target == "A2"


def test_delete_and_rename(spark):
    base = spark.createDataFrame([("a", "A", "item", None, 0), ("b", "B", "item", "n", 1)], GLOSSARY)
    keys = spark.createDataFrame([("a",), ("q",)], "term string")
    assert rows(gl.delete_terms(base, keys), "term") == [("b",)]
    assert rows(gl.deleted_terms(base, keys), "term", "existed") == [("a", True), ("q", False)]
    renames = spark.createDataFrame([("a", "b", 0)], "term string, new_term string, seq long")
    assert rows(gl.rename_terms(base, renames), "term", "target") == [("b", "A")]


def test_search_new_terms_and_lists(spark):
    base = spark.createDataFrame(
        [("王林", "Vương Lâm", "character", None, 0), ("练气", "Luyện Khí", "realm", "", 1), ("Ab", "x", "none", None, 2)], GLOSSARY
    )
    assert rows(gl.search(base, "vương"), "term") == [("王林",)]
    assert rows(gl.search(base, "ab"), "term") == []
    assert rows(gl.search(base, "", "realm"), "term") == [("练气",)]
    found = spark.createDataFrame([("王林", 0, "i"), ("n", 1, "j"), ("n", 2, "k")], "term string, seq long, v string")
    assert rows(gl.new_terms(found, base), "term", "seq", "v") == [("n", 1, "j")]
    assert gl.known_terms_list(base).first()[0] == "王林, 练气, Ab"
    assert gl.known_terms_list(base.limit(0)).first()[0] == "(chưa có)"
    assert [r.term for r in gl.priority_topk(base.orderBy(F.desc("ordinal")), 3).collect()] == ["王林", "练气", "Ab"]
    assert [(r.term, r.n_more) for r in gl.shown_and_rest(base, 2).collect()] == [("王林", 1), ("练气", 1)]


def test_merge_extractions_keeps_first_and_cap(spark):
    entry = lambda c, v: f'{{"chinese": "{c}", "vietnamese": "{v}"}}'
    replies = spark.createDataFrame(
        [(1, f"[{entry('b', 'B1')}, {entry('a', 'A1')}]"), (0, f"x [{entry('a', 'A0')}]"), (2, "[bad"), (3, f"[{entry('c', 'C')}]")],
        "batch long, reply string",
    )
    base = spark.createDataFrame([("a", "old", "item", None, 0)], GLOSSARY)
    got = [tuple(r)[:2] for r in gl.merge_extractions(replies, base, limit=2).orderBy("ordinal").collect()]
    assert got == [("a", "A0"), ("b", "B1")]


CHAPTERS = "book_id string, index long, status string, title_cn string, title_vi string"


def chapters(spark):
    return spark.createDataFrame(
        [("x", 1, "translated", "一", "Một"), ("x", 2, "crawled", "二", None), ("x", 3, "pending", "三", ""),
         ("x", 4, "error", "四", None), ("y", 1, "translated", "", None)],
        CHAPTERS,
    )


def test_states_and_work_lists(spark):
    table = chapters(spark)
    counts = {r.book_id: r for r in st.status_counts(table).collect()}
    assert (counts["x"].n_translated, counts["x"].n_crawled, counts["x"].n_pending, counts["x"].n_error) == (1, 1, 1, 1)
    assert counts["x"].n_remaining == 3 and counts["y"].n_done == 1
    assert rows(st.resumable(st.status_counts(table)), "book_id") == [("x",)]
    assert rows(st.work_lists(table).fillna("-"), "book_id", "index", "action") == [
        ("x", 1, "done"), ("x", 2, "translate"), ("x", 3, "crawl"), ("x", 4, "translate"), ("y", 1, "done")]
    assert rows(st.work_lists(table, True).fillna("-"), "action").count(("-",)) == 1
    assert rows(st.pending_for(table, "format"), "book_id") == [("x",), ("y",)]
    assert st.pending_for(table, "other").count() == 0
    assert rows(st.untitled(table), "index") == [(2,), (3,), (4,)]
    totals = st.library_totals(st.status_counts(table)).first()
    assert tuple(totals) == (2, 5, 2, 40)


def test_force_reset(spark):
    table = chapters(spark).withColumn("raw", F.col("index") == 1)
    kept = st.force_reset(table, F.col("raw"), "full", has_url=False)
    assert rows(kept, "index", "status") == [(1, "crawled"), (1, "crawled"), (2, "crawled"), (3, "pending"), (4, "error")]
    for mode, url in (("crawl_only", False), ("full", True)):
        assert {r[0] for r in rows(st.force_reset(table, F.col("raw"), mode, url), "status")} == {"pending"}


def test_run_result_of_an_idle_run(spark):
    done = chapters(spark).filter("status = 'translated'")
    got = {r.book_id: r for r in st.run_result(st.work_lists(done), done, ["book_id", "index"]).collect()}
    assert (got["x"].skipped_crawl, got["x"].skipped_translate, got["x"].all_done) == (1, 1, True)


def test_settings(spark):
    text = spark.createDataFrame([("x", '{"style": "s", "workers": 3, "last_run_at": "t"}'), ("y", "{broken")], "book_id string, settings_json string")
    got = {r.book_id: r for r in st.parse_settings(text).collect()}
    assert got["x"].last_settings.style == "s" and got["x"].last_run_at == "t"
    assert got["y"].last_settings is None and got["y"].last_run_at is None
    fresh = st.default_settings(st.status_counts(chapters(spark)), text.filter("book_id = 'y'"), style="plain", workers=3)
    assert rows(fresh, "book_id", "style", "workers") == [("x", "plain", 3)]


def test_chapter_updates(spark):
    table = chapters(spark).withColumn("translated_at", F.lit(None).cast("timestamp")).withColumn("error_message", F.lit("e"))
    updates = spark.createDataFrame([("x", 4, "Chương 9: Mới", "第4章"), ("q", 1, "t", None)], "book_id string, index long, title_vi string, title_cn string")
    now = F.lit("2024-01-01").cast("timestamp")
    got = {(r["book_id"], r["index"]): r for r in st.apply_chapter_updates(table, updates, now).collect()}
    changed = got[("x", 4)]
    assert (changed.title_vi, changed.status, changed.error_message) == ("Chương 4 Chương 9: Mới", "translated", None)
    assert got[("x", 2)].status == "crawled" and got[("x", 2)].error_message == "e"
    assert rows(st.rejected_updates(table, updates, ["book_id", "index"]), "book_id") == [("q",)]


FIELDS = "name string, description string, tone string"


def test_style_layers_and_changes(spark):
    builtin = spark.createDataFrame([("a", "A", "t"), ("b", "B", "t")], FIELDS)
    custom = spark.createDataFrame([("b", "B'", "t"), ("c", "C", "t")], FIELDS)
    assert rows(sy.layered(builtin, custom), "name", "description", "style_type", "is_builtin") == [
        ("a", "A", "builtin", True), ("b", "B'", "shadow", True), ("c", "C", "custom", False)]
    assert rows(sy.search(sy.layered(builtin, custom), "b'"), "name") == [("b",)]
    changes = spark.createDataFrame(
        [(0, "create", "a", None, "x", "t"), (1, "create", "d", None, "D", "t"), (2, "update", "a", None, "x", "t"),
         (3, "update", "b", None, "B2", "t"), (4, "delete", "a", None, None, None), (5, "delete", "c", None, None, None),
         (6, "duplicate", "a", None, None, None), (7, "duplicate", "b", "e", None, None), (8, "duplicate", "q", None, None, None)],
        "seq long, op string, name string, new_name string, description string, tone string",
    )
    checked = sy.check_changes(changes, builtin, custom)
    assert [r.seq for r in checked.filter("accepted").orderBy("seq").collect()] == [1, 3, 5, 6, 7]
    after = sy.apply_changes(changes, builtin, custom, ["description", "tone"])
    assert rows(after, "name", "description") == [("a", "A"), ("b", "B2"), ("d", "D"), ("e", "B'")]


def test_unreadable_style_is_listed_under_its_stem(spark):
    files = spark.createDataFrame(
        [("f1", '{"name": "n", "description": "d", "tone": "t", "guidelines": ["g"]}'), ("f2", "not json")], "stem string, style_json string"
    )
    got = {r.name: r for r in sy.parse_styles(files).collect()}
    assert got["n"].guidelines == ["g"] and (got["f2"].description, got["f2"].guidelines) == ("", None)


def test_event_feeds(spark):
    data = [(i, "j" if i % 3 else "k", "progress" if i % 2 else "chapter_crawled", f'{{"chapter_index": {i}}}', i) for i in range(700)]
    data.append((700, "j", "heartbeat", "{}", 700))
    events = spark.createDataFrame(data, "event_id long, job_id string, type string, data string, s long").withColumn("ts", F.timestamp_seconds("s"))
    recent = ev.recent_events(ev.event_filter(events))
    assert recent.groupBy("job_id").count().orderBy("job_id").collect()[0]["count"] == 201
    assert recent.filter("job_id = 'j'").agg(F.max("event_id"), F.min("event_id")).first()[0] == 698
    last = {r.job_id: r.data for r in ev.latest_progress(events).collect()}
    assert last == {"j": '{"chapter_index": 697}', "k": '{"chapter_index": 699}'}
    label = spark.range(1).select(ev.event_label(F.lit("chapter_error"), F.lit('{"chapter_index": 3}')), ev.event_level(F.lit("job_failed"))).first()
    assert tuple(label) == ("Ch.3 error: unknown", "error")


def test_updates_by_position(spark):
    listed = spark.createDataFrame([("x", 0, 1), ("x", 1, 5)], "book_id string, position int, index long")
    updates = spark.createDataFrame([("x", 0), ("x", 1), ("x", 7)], "book_id string, position int")
    got = {r.position: (r["index"], r.aligned) for r in st.updates_by_position(listed, updates).collect()}
    assert got == {0: (1, True), 1: (5, False), 7: (None, None)}


def test_import_and_text(spark):
    base = spark.createDataFrame([("王林", "x", "character", None, 0), ("练气", "Luyện Khí", "realm", "n", 1)], GLOSSARY)
    given = spark.createDataFrame([("王林", "Vương Lâm", "character", "", 0), ("n", "N", "misc", "", 1)], GLOSSARY)
    after = gl.import_rows(base, given)
    assert rows(after, "term", "target") == [("n", "N"), ("王林", "Vương Lâm"), ("练气", "Luyện Khí")]
    assert gl.glossary_text(after).first().block == "### Nhân vật\n- 王林 → Vương Lâm\n\n### Cảnh giới\n- 练气 → Luyện Khí\n"


def test_observed_counts(spark):
    from folioloom.streaming.chapters import observed

    table, progress = observed(chapters(spark))
    table.write.format("noop").mode("overwrite").save()
    assert progress.get == {"rows": 5, "errors": 1}


def test_last_update_of_a_chapter_holds(spark):
    from pyspark.sql import functions as F

    from folioloom.operators.status import apply_chapter_updates

    kind = "book_id string, index long, title_vi string, status string, translated_at timestamp, error_message string"
    chapters = spark.createDataFrame([("b", 1, "old", "error", None, "x"), ("b", 2, "kept", "error", None, "x")], kind)
    updates = spark.createDataFrame(
        [("b", 1, "Z first", None, 1), ("b", 1, "A last", None, 2)],
        "book_id string, index long, title_vi string, title_cn string, step long",
    )
    rows = apply_chapter_updates(chapters, updates, F.current_timestamp(), order="step").collect()
    assert sorted((r["index"], r["title_vi"], r["status"]) for r in rows) == [(1, "A last", "translated"), (2, "kept", "error")]


def test_glossary_of_the_corpus_keeps_no_pair_of_word_and_text(spark, tmp_path):
    from folioloom.plans import adapters as ad

    texts = [(1, "zebras zebras meadow Zebras"), (2, "meadow zebras"), (5, None), (7, "x"), (9, "ZEBRAS meadow, zebras meadow")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    firsts = ad.tokens(docs).groupBy("doc_id", "term").agg({"seq": "min"})
    assert sorted(ad.first_tokens(docs).select("doc_id", "term", "seq").collect()) == sorted(firsts.collect())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    glossary = ad.corpus_glossary(spark, str(tmp_path))
    assert sorted((r.term, r.ordinal) for r in glossary.collect()) == [("meadow", (1 << 27) + 2), ("zebras", 1 << 27)]
    plan = glossary._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1


def test_shown_and_rest_make_the_glossary_once(spark):
    words = spark.range(300).select(F.concat(F.lit("w"), (F.col("id") % 90).cast("string")).alias("term"), "id")
    listed = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("ordinal"))
    base = listed.filter("n >= 3").withColumn("ordinal", F.when(F.col("ordinal") != 7, F.col("ordinal")))
    shown = gl.shown_and_rest(base, 50)
    found = shown.collect()
    assert len(found) == 50 and {r.n_more for r in found} == {40}
    assert "ReusedExchange" in shown._jdf.queryExecution().executedPlan().toString()
