"""Positions inside a group without putting a whole group into one task.

A group here may hold a large share of all rows.  Rows are therefore ordered inside cells
of the order column: a cell covers ``width`` consecutive integers, so with an order column
that is unique inside its group no cell has more than ``width`` rows.  Where numbers are far
apart, as hashes are, such cells would hold a row each; ``sparse`` cuts a group at quantiles
of the order column instead.  What has to pass from one cell to the next is a single number
per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_WIDTH = 1 << 18


#: Cells of a group that is cut at quantiles; a power of two.
RANKED_CELLS = 256


def with_cells(df: DataFrame, group: str, order: str, width: int, sparse: bool) -> DataFrame:
    """Add ``_cell``, which rises with the order column inside a group.

    Sparse groups of more than ``width`` rows get ``RANKED_CELLS`` cells of nearly as many
    rows each, others one.  Borders are found by a mergeable sketch and are few, so they are
    joined to the rows, which find their cell by halving.
    """
    if not sparse:
        return df.withColumn("_cell", F.floor(F.col(order) / F.lit(width)).cast("long"))
    shares = F.array(*[F.lit(k / RANKED_CELLS) for k in range(1, RANKED_CELLS)])
    found = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx(order, shares, F.lit(100 * RANKED_CELLS)).alias("_borders")
    )
    borders = found.filter(F.col("_n") > width).select(F.col(group).alias("_group"), "_borders")
    joined = df.join(borders, F.col(group).eqNullSafe(F.col("_group")), "left")
    halves = F.array(*[F.lit(RANKED_CELLS >> k) for k in range(1, RANKED_CELLS.bit_length())])

    def halve(cell: Column, half: Column) -> Column:
        return cell + F.when(F.get("_borders", cell + half - 1) <= F.col(order), half).otherwise(F.lit(0))

    cell = F.aggregate(halves, F.lit(0), halve).cast("long")
    return joined.withColumn("_cell", cell).drop("_group", "_borders")


def number_rows(
    df: DataFrame,
    group: str,
    order: str,
    name: str = "index",
    width: int = CELL_WIDTH,
    among: dict[str, Column] | None = None,
    sparse: bool = False,
) -> DataFrame:
    """Add the 1-based position of each row in its group, by a unique integer column.

    ``among`` names further numbers that count only the rows that fulfil a condition, made in
    the same pass; they say nothing on other rows.
    """
    wanted = {name: F.lit(True), **(among or {})}
    marks = {f"_mark{i}": F.when(condition, 1).otherwise(0) for i, condition in enumerate(wanted.values())}
    cells = with_cells(df, group, order, width, sparse).withColumns(marks)
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cells.groupBy(group, "_cell")
        .agg(*[F.sum(m).alias(m) for m in marks])
        .select(group, "_cell", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_start{m}") for m in marks])
    )
    inside = Window.partitionBy(group, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cells.withColumns({m: F.sum(m).over(inside) for m in marks})
        .join(starts, [group, "_cell"])
        .withColumns({n: F.col(f"_start{m}") + F.col(m) for n, m in zip(wanted, marks)})
        .drop("_cell", *marks, *[f"_start{m}" for m in marks])
    )


def nearest_marked(
    df: DataFrame,
    group: str,
    order: str,
    marked: Column,
    previous: str = "previous",
    following: str = "following",
    width: int = CELL_WIDTH,
    sparse: bool = False,
) -> DataFrame:
    """Add the nearest order value before and after each row among the marked rows.

    What follows is read in falling order, so that every window grows by a row at a time.
    """
    cells = with_cells(df, group, order, width, sparse).withColumn("_mark", F.when(marked, F.col(order)))
    earlier = Window.unboundedPreceding, -1
    ordered = Window.partitionBy(group).orderBy("_cell").rowsBetween(*earlier)
    reversed_cells = Window.partitionBy(group).orderBy(F.desc("_cell")).rowsBetween(*earlier)
    carried = cells.groupBy(group, "_cell").agg(
        F.min("_mark").alias("_low"), F.max("_mark").alias("_high")
    )
    carried = carried.select(
        group,
        "_cell",
        F.max("_high").over(ordered).alias("_before"),
        F.min("_low").over(reversed_cells).alias("_after"),
    )
    inside = Window.partitionBy(group, "_cell")
    last = F.last("_mark", ignorenulls=True).over(inside.orderBy(order).rowsBetween(*earlier))
    first = F.last("_mark", ignorenulls=True).over(inside.orderBy(F.desc(order)).rowsBetween(*earlier))
    return (
        cells.withColumn("_last", last)
        .withColumn("_first", first)
        .join(carried, [group, "_cell"])
        .withColumn(previous, F.coalesce("_last", "_before"))
        .withColumn(following, F.coalesce("_first", "_after"))
        .drop("_cell", "_mark", "_before", "_after", "_last", "_first")
    )


def keep_first(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """The first row of every key.  Tasks cut their own rows to one per key before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    orders = [order] if isinstance(order, str) else order
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*orders))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def first_rows(df: DataFrame, group: str | list[str], order: list[Column], limit: int) -> DataFrame:
    """The first rows of every group; each task sends at most ``limit`` rows per group."""
    keys = [group] if isinstance(group, str) else group
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def concat_segments(
    df: DataFrame, group: str, position: str, text: str, size: int, separator: str = "\n"
) -> DataFrame:
    """Texts of a group joined in order, in segments of at most ``size`` positions.

    One text for a whole group would have to pass through one task and could outgrow a row;
    segments are bounded, and in order of ``segment`` they read as that one text.
    """
    parts = df.withColumn("segment", F.floor((F.col(position) - 1) / size).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position), F.col(text))))
    joined = F.array_join(F.transform(ordered, lambda x: x[text]), separator)
    return parts.groupBy(group, "segment").agg(
        joined.alias(text), F.count(F.lit(1)).alias("n_parts")
    )
