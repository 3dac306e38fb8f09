"""Streams: equal to batch, safe to run again, resumable."""

import itertools
import re
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioloom.functions import sequences
from folioloom.operators import terms
from folioloom.plans import stream_queries
from folioloom.streaming import chapters, feeds, glossaries, progress, retries, states
from folioloom.streaming.tables import arrivals, exists, read_batches, read_stream, start, write_batch

SMALL_DATA = "/root/testdata/sf0.001"
CHANGE = "book_id string, index long, status string, error string, s long, seq long"


def changes(spark, rows):
    return spark.createDataFrame(rows, CHANGE).withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_states_over_several_batches_equal_batch(spark, tmp_path):
    source, out = str(tmp_path / "changes"), str(tmp_path / "states")
    first = [("b", 1, "crawled", None, 10, 0), ("b", 2, "error", "lost", 11, 1), ("b", 9, "crawled", None, 1, 2)]
    second = [("b", 2, "crawled", None, 20, 3), ("b", 1, "translated", None, 21, 4), ("b", 1, "error", "bad", 22, 5)]
    known = spark.createDataFrame([("b", 1), ("b", 2)], "book_id string, index long")
    for batch in (first, second):
        changes(spark, batch).write.mode("append").parquet(source)
        states.run_states(read_stream(spark, source), out, str(tmp_path / "cp"), known).awaitTermination()
    got = sorted(states.current_states(spark, out).collect())
    expected = sorted(states.chapter_states(changes(spark, first + second)).filter("index < 9").collect())
    assert got == expected
    by_index = {r["index"]: r for r in got}
    assert (by_index[1].status, by_index[1].error_message) == ("error", "bad")
    assert by_index[1].translated_at is not None and by_index[2].error_message is None
    events = states.state_events(states.current_states(spark, out))
    assert {r.type for r in events.collect()} == {"chapter_error", "chapter_crawled"}


def test_a_batch_run_again_leaves_its_rows_once(spark, tmp_path):
    rows = spark.createDataFrame([("t", "T", "item", None)], glossaries.TERMS)
    for _ in range(2):
        write_batch(rows, str(tmp_path / "terms"), 3)
    assert read_batches(spark, str(tmp_path / "terms"), glossaries.TERMS).count() == 1
    assert read_batches(spark, str(tmp_path / "terms"), glossaries.TERMS, before=3).count() == 0
    assert read_batches(spark, str(tmp_path / "nothing"), glossaries.TERMS).count() == 0


def test_pages_resume(spark, tmp_path):
    body = "<h1>T</h1><div id=c><p>" + "long enough text " * 20 + "</p></div>"
    source, out = str(tmp_path / "pages"), str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.mode("append").parquet(source)
        stream = read_stream(spark, source)
        chapters.run_pages(stream, out, str(tmp_path / "cp"), "#c", "h1", [], {"size": 100}).awaitTermination()
        return {r.page_id: r.status for r in chapters.latest_texts(spark, out).collect()}

    assert run([(1, body), (2, ""), (1, body)]) == {1: "crawled", 2: "error"}
    n_chunks = spark.read.parquet(f"{out}/chunks").count()
    # Page 1 is done and skipped; page 2 was in error and is taken again.
    assert run([(1, body), (2, body), (3, body)]) == {1: "crawled", 2: "crawled", 3: "crawled"}
    texts = spark.read.parquet(f"{out}/texts")
    assert texts.filter("page_id = 1").count() == 1 and texts.filter("page_id = 2").count() == 2
    assert spark.read.parquet(f"{out}/chunks").count() == 3 * n_chunks


def test_glossary_growth_and_refresh(spark, tmp_path):
    source, out = str(tmp_path / "docs"), str(tmp_path / "out")
    base = spark.createDataFrame([("harbour", "x", "item", None)], glossaries.TERMS)
    texts = ["harbour harbour lanterns lanterns", "lanterns lanterns mountain", "rivers rivers mountain", "harbour"]
    for i, text in enumerate(texts):
        spark.createDataFrame([(i, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
    docs = spark.read.parquet(source)
    stream = read_stream(spark, source, files_per_batch=1)
    glossaries.run_growth(stream, out, str(tmp_path / "cp"), base, all_docs=docs, refresh=2).awaitTermination()
    terms = [r.term for r in read_batches(spark, f"{out}/terms", glossaries.TERMS).collect()]
    assert sorted(terms) == ["lanterns", "mountain", "rivers"]
    versions = glossaries.version(spark, out)
    stats = spark.read.parquet(f"{out}/stats")
    fitted = {r.version for r in stats.collect()}
    assert fitted == {v for v in range(2, versions + 1, 2)} and fitted
    known = {r.term: r.df for r in stats.filter(F.col("version") == max(fitted)).collect()}
    assert known["harbour"] == 2 and all(v >= 1 for v in known.values())


def test_first_glossary_is_made_once(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], glossaries.TERMS)
    some = spark.createDataFrame([("a", "b", "item", None)], glossaries.TERMS)
    assert glossaries.first_glossary(docs, none, lambda d: some).count() == 1
    assert glossaries.first_glossary(docs.limit(0), none, lambda d: some).count() == 0
    assert glossaries.first_glossary(docs, some, lambda d: pytest.fail("made again")).count() == 1


def test_event_log_and_heartbeats(spark, tmp_path):
    source = str(tmp_path / "events")
    data = [("j", "progress", 1), ("j", "heartbeat", 2), ("k", "job_started", 3), ("m", "progress", 4), ("m", "job_completed", 5)]
    spark.createDataFrame(data, "job_id string, type string, event_id long").coalesce(1).write.parquet(source)
    feeds.run_event_log(read_stream(spark, source), str(tmp_path / "log"), str(tmp_path / "cp1"), "j").awaitTermination()
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [1]
    beats = feeds.heartbeats(read_stream(spark, source), idle_seconds=1)
    query = start(beats.writeStream.format("memory").queryName("beats").outputMode("append"), str(tmp_path / "cp2"), seconds=1)
    try:
        for _ in range(60):
            jobs = {r.job_id for r in spark.table("beats").collect()}
            if jobs == {"j", "k"}:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert jobs == {"j", "k"}


def test_heartbeats_take_as_long_as_they_need(spark, monkeypatch):
    # A clock on which every look is ten minutes later: the run must not end before its last job.
    ticks = itertools.count(step=600)
    monkeypatch.setattr(stream_queries, "time", SimpleNamespace(monotonic=lambda: next(ticks)), raising=False)
    beats = stream_queries.job_heartbeats_stream(spark, SMALL_DATA).collect()
    users = spark.read.parquet(f"{SMALL_DATA}/events.parquet").filter("user_id % 4 <> 0").select("user_id").distinct()
    assert sorted(r.job_id for r in beats) == sorted(str(r.user_id) for r in users.collect())


def test_jobs_of_a_group_have_their_own_times():
    class State:
        exists = hasTimedOut = False

        def getCurrentProcessingTimeMs(self):
            return self.now

        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, ms):
            self.wakes = self.now + ms

    state, step = State(), feeds._beats(idle=10, forget=35)

    def at(now, *rows):
        state.now, state.hasTimedOut = now, not rows
        out = step((0,), iter([pd.DataFrame(rows, columns=["job_id", "ends"])] if rows else []), state)
        return [tuple(r) for beats in out for r in beats[["job_id", "number"]].itertuples(index=False)]

    assert at(0, ("a", False), ("b", False), ("c", False), ("c", True)) == [] and state.wakes == 10
    assert at(6, ("b", False)) == [] and state.wakes == 10
    assert at(10) == [("a", 1)] and state.wakes == 16
    # Rows for another job do not keep a beat back that is due.
    assert at(17, ("d", False)) == [("b", 1)] and state.wakes == 20
    assert at(30, ("b", True)) == [("a", 2), ("d", 1)] and state.wakes == 40
    assert at(40) == [("d", 2)] and state.wakes == 50  # a is forgotten
    assert at(52, ("d", True)) == [] and not state.exists


def test_repeats_over_several_batches_are_in_state(spark, tmp_path):
    body = "<h1>T</h1><div id=c><p>" + "long enough text " * 20 + "</p></div>"
    source, out = str(tmp_path / "pages"), str(tmp_path / "out")
    for k in range(5):
        rows = [(1, body), (10 + k, body), (10 + max(0, k - 1), body), (99, body if k == 3 else "")]
        spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.mode("append").parquet(source)
    stream = read_stream(spark, source, files_per_batch=1)
    run = chapters.run_pages(stream, out, str(tmp_path / "cp"), "#c", "h1", [], {"size": 100})
    run.awaitTermination()
    rows = read_batches(spark, f"{out}/texts", chapters.TEXTS)
    written = {(r.page_id, r.status): r["count"] for r in rows.groupBy("page_id", "status").count().collect()}
    assert written == {(k, "crawled"): 1 for k in (1, 10, 11, 12, 13, 14, 99)} | {(99, "error"): 1}
    # A page in error was done later on; the error of a page that is done does not come back.
    assert {r.page_id: r.status for r in chapters.latest_texts(spark, out).collect()}[99] == "crawled"
    assert {r.batch_id for r in rows.select("batch_id").distinct().collect()} <= set(range(5))


def test_progress_of_intervals_and_batches(spark, tmp_path):
    kinds = ["chapter_crawled", "chapter_translated", "chapter_error", "progress"]
    data = [(f"j{k % 3}", kinds[k % 4], k * 10) for k in range(60)]
    events = spark.createDataFrame(data, "job_id string, type string, s long").withColumn("ts", F.timestamp_seconds("s"))
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    events.drop("s").write.parquet(source)
    stream = arrivals(spark, source, str(tmp_path / "landing"), batches=5)
    log = progress.ProgressLog(spark, f"{out}/batches")
    spark.streams.addListener(log)
    try:
        seen = progress.observed_batches(stream, F.col("type"))
        run = progress.run_progress(seen, f"{out}/rows", str(tmp_path / "cp"), "100 seconds", late="1 day")
        run.awaitTermination()
        log.wait(run)
    finally:
        spark.streams.removeListener(log)
    want = {}
    for job, kind, s in data:
        own = want.setdefault((job, s // 100), dict.fromkeys(progress.COUNTERS, 0))
        own["events"] += 1
        if kind != "progress":
            own[{"chapter_crawled": "crawled", "chapter_translated": "translated", "chapter_error": "errors"}[kind]] += 1
    rows = progress.progress_events(spark, f"{out}/rows").collect()
    assert len(rows) == len(want)
    for job in ("j0", "j1", "j2"):
        so_far = dict.fromkeys(progress.COUNTERS, 0)
        for r in sorted((r for r in rows if r.job_id == job), key=lambda r: r.ts):
            own = want[(job, int(r.ts.timestamp()) // 100 - 1)]
            so_far = {c: n + own[c] for c, n in so_far.items()}
            assert {c: r[c] for c in progress.COUNTERS} == so_far and r.type == "progress"
    batches = progress.batch_progress(spark, f"{out}/batches").collect()
    assert len({r.batch_id for r in batches}) == len(batches) > 1
    assert sum(r.events for r in batches) == sum(r.input_rows for r in batches) == len(data)


@pytest.mark.parametrize("kind", ["progress", "states", "pages"])
def test_states_are_on_disk_in_every_session(spark, tmp_path, kind):
    key = "spark.sql.streaming.stateStore.providerClass"
    built, plain = spark.conf.get(key), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    source, out, checkpoint = (str(tmp_path / name) for name in ("rows", "out", "cp"))
    given = {
        "progress": spark.createDataFrame([("j", "progress", 5)], "job_id string, type string, s long"),
        "states": spark.createDataFrame([("b", 1, "crawled", None, 10, 0)], CHANGE),
        "pages": spark.createDataFrame([(1, "<h1>T</h1><div id=c>text</div>")], "page_id long, html string"),
    }[kind]
    rows = given.withColumn("ts", F.timestamp_seconds("s")).drop("s") if "s" in given.columns else given
    rows.write.parquet(source)
    spark.conf.set(key, plain)
    try:
        stream = read_stream(spark, source)
        run = {
            "progress": lambda: progress.run_progress(stream, out, checkpoint),
            "states": lambda: states.run_states(stream, out, checkpoint),
            "pages": lambda: chapters.run_pages(stream, out, checkpoint, "#c", "h1", []),
        }[kind]()
        run.awaitTermination()
    finally:
        spark.conf.set(key, built)
    files = {p.suffix for p in (tmp_path / "cp" / "state").rglob("*") if p.is_file() and p.stat().st_size}
    # Changes are written, not maps that a task keeps in its memory (.delta).
    assert ".changelog" in files and ".delta" not in files


def test_failures_wait_in_quarantine(spark, tmp_path):
    source, out = str(tmp_path / "docs"), str(tmp_path / "out")
    for k in range(3):
        rows = [(10 * k + i, f"t{i}") for i in range(4)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)

    def reply(doc_id, text, attempt):
        if doc_id % 10 == 1 and attempt < 3 or doc_id % 10 == 2:
            raise RuntimeError(f"{text} lost")
        return text.upper()

    step = retries.guarded(reply)
    stream = read_stream(spark, source, files_per_batch=1)
    key = stream.schema["doc_id"]
    retries.run_retrying(stream, "doc_id", step, out, str(tmp_path / "cp"), attempts=3).awaitTermination()
    # The first batch's failures were taken up by the later batches; others wait.
    assert {r.doc_id: r.attempts for r in retries.results(spark, key, out).collect() if r.doc_id < 3} == {0: 1, 1: 3, 2: 3}
    retries.retry_rest(spark, key, step, out, attempts=3)
    got = {r.doc_id: (r.value, r.error, r.status, r.attempts) for r in retries.results(spark, key, out).collect()}
    want = {}
    for d in (10 * k + i for k in range(3) for i in range(4)):
        failed = ("RuntimeError: t2 lost", "error", 3)
        want[d] = (None, *failed) if d % 10 == 2 else (f"T{d % 10}", None, "translated", 3 if d % 10 == 1 else 1)
    assert got == want
    retries.retry_rest(spark, key, step, out, attempts=3)  # nothing waits: nothing is done
    assert retries.results(spark, key, out).count() == len(want)


def test_statistics_go_on_from_earlier_ones(spark):
    texts = [(0, "harbour lantern"), (1, "lantern lantern"), (2, "rivers harbour"), (3, "rivers"), (4, None), (5, "mountain rivers")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kind = "term string, target string, category string, notes string, ordinal long"
    words = ["harbour", "lantern", "rivers", "mountain", "absent", "harbour"]
    listed = spark.createDataFrame([(w, w, "item", None, k) for k, w in enumerate(words)], kind)
    first = terms.fit_terms(docs.filter("doc_id < 2"), listed.filter("ordinal < 2"), "doc_id")
    again = terms.refit_terms(first, docs.filter("doc_id < 2"), docs.filter("doc_id >= 2"), listed, "doc_id")
    whole = terms.fit_terms(docs, listed, "doc_id")
    assert sorted(again.select(whole.columns).collect(), key=str) == sorted(whole.collect(), key=str)
    same = terms.refit_terms(whole, docs, docs.limit(0), listed, "doc_id")
    assert sorted(same.select(whole.columns).collect(), key=str) == sorted(whole.collect(), key=str)


def test_tables_that_are_not_there(spark, tmp_path):
    assert not exists(spark, str(tmp_path / "no table"))
    write_batch(spark.createDataFrame([], glossaries.TERMS), str(tmp_path / "terms"), 0)
    assert exists(spark, str(tmp_path / "terms"))


def test_terms_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(glossaries, "FOLD", 2)
    source, out = str(tmp_path / "docs"), str(tmp_path / "out")
    base = spark.createDataFrame([("harbour", "x", "item", None)], glossaries.TERMS)
    words = ["harbour lanterns", "lanterns mountain", "mountain", "rivers lanterns", "forests rivers"]
    for i, text in enumerate(words):
        spark.createDataFrame([(i, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
    docs = spark.read.parquet(source)
    stream = read_stream(spark, source, files_per_batch=1)
    glossaries.run_growth(stream, out, str(tmp_path / "cp"), base, all_docs=docs, refresh=2).awaitTermination()
    rows = read_batches(spark, f"{out}/terms", glossaries.TERMS)
    terms_added = {r.term: r.batch_id for r in rows.collect()}
    assert sorted(terms_added) == ["forests", "lanterns", "mountain", "rivers"] and rows.count() == 4
    # A batch after a fold reads it and the batches after it, and finds the same terms.
    assert exists(spark, f"{out}/known/upto=1") and exists(spark, f"{out}/known/upto=3")
    for before in range(6):
        known = sorted(r.term for r in glossaries.known_terms(spark, out, base, before).collect())
        assert known == sorted(["harbour", *(t for t, b in terms_added.items() if b < before)])
    noted = read_batches(spark, f"{out}/versions", glossaries.VERSIONS).collect()
    assert {r.batch_id: r.version for r in noted} == {k: len({b for b in terms_added.values() if b <= k}) for k in range(5)}


def test_words_are_counted_inside_their_row(spark):
    texts = ["", None, "river River mountain", "rivers harbour harbour rivers lantern Árboles", "short words only", "a_long 123456 a_long"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = glossaries.frequent_words(docs, limit=2)
    want = []
    for i, text in enumerate(texts):
        words = [w for w in re.findall(r"\w+", (text or "").lower()) if len(w) >= 6]
        best = sorted(set(words), key=lambda w: (-words.count(w), w))[:2]
        want += [(w, w.upper(), "general", None, (i, place + 1)) for place, w in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    # What is shuffled is no longer every word of every text: nothing is.
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_statistics_do_not_depend_on_the_table_of_hashes(spark, monkeypatch):
    # A table that lets every stretch through, as a full one nearly does.
    every = (np.full(sequences.PLACES // 8, 255, np.uint8), list(range(1, 10)))
    monkeypatch.setattr(terms, "listed_places", lambda glossary: every)
    texts = ["harbour lantern", "lantern lantern", "rivers harbour", "", None, "lanterns"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed = spark.createDataFrame([(w,) for w in ("harbour", "lantern", "rivers", "absent", "harbour", None)], "term string")
    first = terms.fit_terms(docs.filter("doc_id < 2"), listed.filter("term = 'lantern'"), "doc_id")
    again = terms.refit_terms(first, docs.filter("doc_id < 2"), docs.filter("doc_id >= 2"), listed, "doc_id")
    want = [("absent", 0), ("harbour", 2), ("harbour", 2), ("lantern", 3), ("rivers", 1)]
    for fitted in (again, terms.fit_terms(docs, listed, "doc_id")):
        assert sorted((r.term, r.df) for r in fitted.collect()) == want
        assert {r.n_docs for r in fitted.collect()} == {len(texts)}
