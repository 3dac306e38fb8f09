"""Libraries of files, the state log, and edits made in order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioloom.operators import ordering
from folioloom.operators import styles as sy
from folioloom.sources import library as lib
from folioloom.sources import readers, statelog


def files(spark, rows):
    return spark.createDataFrame(rows, lib.FILES)


def test_library_is_written_and_read(spark, tmp_path):
    spark.dataSource.register(lib.Library)
    path = str(tmp_path / "library")
    rows = [(f"b{k % 7}", f"{k}.txt", f"text {k}\nütf {'x' * k}") for k in range(150)]
    files(spark, rows).repartition(5).write.format("book_library").mode("append").save(path)
    read = spark.read.format("book_library").option("booksPerPartition", "2")
    assert sorted(map(tuple, read.load(path).collect())) == sorted(rows)
    assert read.load(path).rdd.getNumPartitions() == 4
    assert sorted(map(tuple, readers.scan_texts(spark, path).collect())) == sorted(rows)
    # A later job replaces its own files and leaves the others.
    files(spark, [("b0", "0.txt", "new"), ("b9", "1.txt", None)]).write.format("book_library").mode("append").save(path)
    after = {(r.book_id, r.file_name): r.text for r in read.load(path).collect()}
    assert after[("b0", "0.txt")] == "new" and after[("b9", "1.txt")] == "" and len(after) == 151
    jobs = [json.loads(f.read_text()) for f in (tmp_path / "library" / "_jobs").iterdir()]
    assert sorted(j["files"] for j in jobs) == [2, 150]
    assert not any((tmp_path / "library" / "_staging").iterdir())
    (tmp_path / "library" / "b0" / "raw" / "bad.txt").write_bytes(b"\xff\xfe")
    assert read.load(path).count() == 151


def test_library_that_is_not_there_and_names_that_leave_it(spark, tmp_path):
    spark.dataSource.register(lib.Library)
    path = str(tmp_path / "none")
    assert spark.read.format("book_library").load(path).count() == 0
    for name in ("../x.txt", "", "_jobs", ".hidden"):
        with pytest.raises(Exception, match="no name of a book or file"):
            files(spark, [("b", name, "t")]).write.format("book_library").mode("append").save(path)
    assert spark.read.format("book_library").load(path).count() == 0
    with pytest.raises(Exception, match="columns of a library"):
        files(spark, []).drop("text").write.format("book_library").mode("append").save(path)


def test_state_log_equals_its_changes(spark, tmp_path):
    rng = random.Random(4)
    kinds = ["crawled", "translated", "error"]
    data = [(f"b{rng.randrange(3)}", rng.randrange(6), rng.choice(kinds), k) for k in range(240)]
    changes = spark.createDataFrame(data, "book_id string, index long, status string, seq long")
    changes = changes.withColumn("error", F.when(F.col("status") == "error", F.concat(F.lit("e"), "seq")))
    changes = changes.withColumn("ts", F.timestamp_seconds(F.col("seq") / 3))
    path = str(tmp_path / "log")
    want = {}
    for k in range(6):
        statelog.append_states(changes.filter(F.col("seq") % 6 == k), path, k)
        if k == 3:
            statelog.append_states(changes.filter(F.col("seq") % 6 == k), path, k)  # run again
        if k in (1, 2, 4):
            assert statelog.compact(spark, path) == k == statelog.compact(spark, path)
    for book, index, status, seq in data:
        state = want.setdefault((book, index), {"crawled": None, "translated": None})
        state["last"] = (status, f"e{seq}" if status == "error" else None, seq)
        state[status] = seq
    got = {(r["book_id"], r["index"]): r for r in statelog.read_states(spark, path).collect()}
    assert set(got) == set(want)
    for key, state in want.items():
        assert (got[key].status, got[key].error_message, got[key].seq) == state["last"]
        for name in ("crawled", "translated"):
            assert (got[key][f"{name}_at"] is None) == (state[name] is None)
    # The fold reads the snapshot and the appends after it, no others.
    assert statelog.last_snapshot(spark, path) == 4
    assert {r.batch_id for r in statelog._unfolded(spark, path, 4)[1].select("batch_id").distinct().collect()} == {5}
    assert statelog.last_snapshot(spark, str(tmp_path / "no log")) == -1


def test_sparse_positions(spark):
    rng = random.Random(8)
    # One group of numbers that lie far apart, and in part close together.
    data = [("hot", rng.randrange(-(1 << 62), 1 << 62)) for _ in range(4000)] + [("hot", k) for k in range(2000)]
    data += [(None, 5 * k) for k in range(7)] + [("one", 3)]
    df = spark.createDataFrame(data, "g string, o long").withColumn("m", F.col("o") % 5 == 0)
    want = {}
    for g, o in sorted(set(data), key=lambda x: (str(x[0]), x[1])):
        want.setdefault(g, []).append(o)
    placed = ordering.number_rows(df.filter("g is not null"), "g", "o", "n", width=100, sparse=True)
    got = {(r.g, r.o): r.n for r in placed.collect()}
    assert got == {(g, o): i for g, items in want.items() if g for i, o in enumerate(items, 1)}
    cells = ordering.with_cells(df, "g", "o", 100, True).groupBy("g", "_cell").count().collect()
    assert max(r["count"] for r in cells if r.g == "hot") < 100 and len([r for r in cells if r.g == "one"]) == 1
    near = ordering.nearest_marked(df.filter("g = 'hot'"), "g", "o", F.col("m"), "p", "f", width=100, sparse=True)
    marked = [o for o in want["hot"] if o % 5 == 0]
    before, k = {}, -1
    for o in want["hot"]:
        before[o] = marked[k] if k >= 0 else None
        k += o % 5 == 0
    assert {r.o: r.p for r in near.collect()} == before


def fold(changes, builtin, custom):
    """What the changes do, one after the other."""
    custom, verdicts = dict(custom), {}
    for seq, op, name, new_name, value in changes:
        has, given = name in custom, name in builtin
        verdicts[seq] = {
            "create": not (has or given), "update": has or not given, "delete": has, "duplicate": has or given
        }.get(op, False)
        if not verdicts[seq]:
            continue
        if op == "delete":
            del custom[name]
        elif op == "duplicate":
            custom[new_name or name] = custom.get(name, builtin.get(name))
        else:
            custom[name] = value
    return verdicts, custom


CHANGE = "seq long, op string, name string, new_name string, description string"


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_changes_in_order_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    builtin, custom = {"a": "A", "b": "B"}, {"b": "B'", "c": "C'"}
    ops = ["create", "update", "delete", "duplicate", "duplicate", "other"]
    changes = [(k, rng.choice(ops), rng.choice("abcdef"), rng.choice(["d", "e", "f", "g", None]), f"v{k}") for k in range(60)]
    layers = [spark.createDataFrame(list(x.items()), "name string, description string") for x in (builtin, custom)]
    table = spark.createDataFrame(changes, CHANGE)
    verdicts, after = fold(changes, builtin, custom)
    assert {r.seq: r.accepted for r in sy.check_in_order(table, *layers).collect()} == verdicts
    assert {r.name: r.description for r in sy.apply_in_order(table, *layers, ["description"]).collect()} == after


def test_names_that_come_back(spark):
    none = spark.createDataFrame([], "name string, description string")
    cases = {
        "create twice": ([(0, "create", "x", None, "1"), (1, "create", "x", None, "2")], {0: True, 1: False}, {"x": "1"}),
        "create, delete": ([(0, "create", "x", None, "1"), (1, "delete", "x", None, "")], {0: True, 1: True}, {}),
        "delete, create": ([(0, "delete", "x", None, ""), (1, "create", "x", None, "2")], {0: False, 1: True}, {"x": "2"}),
        "nothing": ([], {}, {}),
    }
    for changes, verdicts, after in cases.values():
        table = spark.createDataFrame(changes, CHANGE)
        assert {r.seq: r.accepted for r in sy.check_in_order(table, none, none).collect()} == verdicts
        assert {r.name: r.description for r in sy.apply_in_order(table, none, none, ["description"]).collect()} == after


def test_few_books_of_many_files_are_read_by_several_tasks(spark, tmp_path):
    spark.dataSource.register(lib.Library)
    path = str(tmp_path / "library")
    rows = [(f"b{k % 9}", f"{k}.txt", str(k)) for k in range(45)]
    files(spark, rows).write.format("book_library").mode("append").save(path)
    read = spark.read.format("book_library").load(path)
    assert read.rdd.getNumPartitions() == 9
    assert sorted(map(tuple, read.collect())) == sorted(rows)


def test_scans_list_folders_and_gather_small_files(spark, tmp_path):
    def roots(rows):
        plan = rows._jdf.queryExecution().optimizedPlan()
        return plan.collectLeaves().head().relation().location().rootPaths().size()

    for k in range(300):
        folder = tmp_path / f"b{k % 3}" / "raw"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{k}.txt").write_text(f"text {k}")
        (folder / f"{k}.html").write_text(f"page {k}")
    texts = readers.scan_texts(spark, str(tmp_path))
    pages = readers.scan_pages(spark, f"{tmp_path}/*/raw/*.html")
    assert sorted(r.text for r in texts.collect()) == sorted(f"text {k}" for k in range(300))
    assert sorted(r.html for r in pages.collect()) == sorted(f"page {k}" for k in range(300))
    assert readers.scan_pages(spark, f"{tmp_path}/b0/raw/3.html").first().html == "page 3"
    assert roots(texts) == roots(pages) == 3
