"""Columns in pieces."""

import pyarrow as pa
from pyspark.sql import functions as F

from folioloom.functions.slices import sliced
from folioloom.operators.pages import extract_main_text
from folioloom.sources.decode import decode_bytes


def test_pieces_are_small_and_cover_the_column():
    column = pa.array(["a" * n for n in (0, 5, 0, 12, 3, 3, 3, 0, 30)] + [None, "é"])
    pieces = list(sliced(column, 10))
    assert [x for p in pieces for x in column[p].to_pylist()] == column.to_pylist()
    sizes = [[len((x or "").encode()) for x in column[p].to_pylist()] for p in pieces]
    assert all(sum(s) <= 10 or sum(n > 0 for n in s) == 1 for s in sizes) and len(pieces) == 5
    assert list(sliced(pa.array([], pa.string()))) == []


def test_a_batch_of_many_bytes_is_worked_on_in_pieces(spark):
    rows = spark.range(40, numPartitions=1).withColumn("text", F.repeat(F.concat(F.lit("é"), "id"), 60_000))
    done = rows.select("id", "text", decode_bytes(F.encode("text", "UTF-8"), F.lit("ascii")).alias("read"))
    assert done.filter("read <> text or read is null").count() == 40  # valid as GBK, which comes first
    pages = rows.select("id", F.concat(F.lit("<article>"), "text", F.lit("</article>")).alias("html"))
    found = extract_main_text(pages, "article", "h1")
    assert found.join(rows.withColumnRenamed("text", "meant"), "id").filter("text = meant").count() == 40
