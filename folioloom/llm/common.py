"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import math
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioloom.session import work_folder

#: A word: a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def settle(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared work folder and read back.

    Cuts the lineage, survives lost executors, fixes what is read twice, and gives Spark the
    true size of a table before it chooses a join.
    """
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, groups: list[str], order: list[str], total: int, name: str) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in the order of the columns of ``order``.

    The first column of ``order`` is a hash (long).  A group may hold most rows, so ranges of
    that hash form cells; rows are numbered inside their cell, and each cell starts where the
    cells before it end.  With about the square root of ``total`` cells, neither a cell nor
    the list of cells of a group is large.  Rows must come out alike when read twice.
    """
    cells = max(64, math.isqrt(total))
    low, width = -(1 << 63), (1 << 64) // cells + 1
    cell = F.floor((F.col(order[0]).cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("long")
    rows = rows.withColumn("_rk_cell", cell)
    sizes = rows.groupBy(*groups, "_rk_cell").agg(F.count(F.lit(1)).alias("_rk_n"))
    before = Window.partitionBy(*groups).orderBy("_rk_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*groups, "_rk_cell", F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_start"))
    within = Window.partitionBy(*groups, "_rk_cell").orderBy(*order)
    placed = rows.withColumn("_rk_place", F.row_number().over(within) - 1)
    joined = placed.join(starts, [*groups, "_rk_cell"])
    return joined.withColumn(name, F.col("_rk_start") + F.col("_rk_place")).drop("_rk_cell", "_rk_start", "_rk_place")


def in_worker(key: str, make: Callable[[], Any]) -> Any:
    """One object per Python worker, kept over the tasks that the worker runs."""
    store = sys.modules.setdefault("folioloom_worker_store", types.ModuleType("folioloom_worker_store"))
    if not hasattr(store, key):
        setattr(store, key, make())
    return getattr(store, key)


def chunked(batch: pa.RecordBatch, texts: pa.Array, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text each; a longer text by itself."""
    begin = held = 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + (n or 0) > size:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)
