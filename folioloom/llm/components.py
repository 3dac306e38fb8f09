"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.llm.common import settle


def components(edges: DataFrame, written_minima: bool = False) -> DataFrame:
    """``node, label``: the smallest node of its component, for every node of ``a, b`` pairs.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest
    neighbour, until all edges point at the smallest node of their component.  Minima are
    pre-aggregated, so a node may have any number of edges.  Loops and repeats do no harm.

    With ``written_minima``, they are written before they are joined: a join on an aggregate's own
    shuffle cannot split a node of very many edges.  It costs two more tables a round, which over
    many small partitions is most of the time.
    """
    held = (lambda least: settle(least, "least")) if written_minima else (lambda least: least)
    ordered = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    ordered = settle(ordered.distinct(), "edges")
    state = None
    while True:
        found = ordered.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            break
        state = found
        # Large star: larger neighbours of a node link to the smallest of it and its neighbours.
        least = held(ordered.groupBy("u").agg(F.min("v").alias("m")))
        large = ordered.select(F.col("u").alias("x"), F.col("v").alias("u")).join(least, "u", "left")
        linked = large.select(F.col("x").alias("u"), F.coalesce(F.least("m", "u"), "u").alias("v"))
        # Small star: smaller neighbours, and the node, link to the smallest of them.
        linked = settle(linked.distinct(), "edges")
        least = held(linked.groupBy("u").agg(F.min("v").alias("m")))
        small = linked.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ordered = settle(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    labels = ordered.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(ordered.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
