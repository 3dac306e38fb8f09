"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions.arrays import each
from folioloom.llm.common import settle, whole_text

#: A line is boilerplate above this share of a site's pages,
MAX_RATIO = 0.1
#: and on this many pages at least.
MIN_PAGES = 3


def _digest(line: Column) -> Column:
    return F.md5(F.trim(line))


def boilerplate(docs: DataFrame, site: str, max_ratio: float, min_pages: int, copies: bool = True) -> DataFrame:
    """``site`` and the digests of its boilerplate lines, one row for each site that has any.

    A page counts a line once; partial counts are made before the shuffle.  At most (mean
    lines of a page / ``max_ratio``) lines of a site can exceed the ratio, so the list is short.
    Without ``copies``, lines that are on enough rows are counted again by distinct texts.
    """
    lines = F.filter(F.split("_text", "\n"), lambda x: F.trim(x) != "")
    digests = F.array_distinct(F.transform(lines, _digest))
    pages = docs.select(F.col(site).alias("_ld_site"), whole_text().alias("_text"))
    counts = (
        pages.select("_ld_site", F.explode(each(digests)).alias("digest"))
        .groupBy("_ld_site", "digest")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pages)
    )
    counted = pages if copies else pages.select("_ld_site", F.md5("_text").alias("_page")).distinct()
    totals = counted.groupBy("_ld_site").agg(F.count(F.lit(1)).alias("n_pages")).withColumnRenamed("_ld_site", "_ld_of")
    heavy = counts.join(totals, F.col("_ld_site").eqNullSafe(F.col("_ld_of")))
    heavy = heavy.where(F.col("n") > max_ratio * F.col("n_pages"))
    bad = heavy.groupBy("_ld_site").agg(F.collect_set("digest").alias("_ld_bad"))
    if copies:
        return bad
    bad = settle(bad, "frequent-lines").withColumnRenamed("_ld_site", "_ld_in")
    found = pages.join(bad, F.col("_ld_site").eqNullSafe(F.col("_ld_in"))).select(
        "_ld_site", F.md5("_text").alias("_page"), F.explode(each(F.array_intersect(digests, "_ld_bad"))).alias("digest")
    )
    counts = found.distinct().groupBy("_ld_site", "digest").agg(F.count(F.lit(1)).alias("n"))
    heavy = counts.join(totals, F.col("_ld_site").eqNullSafe(F.col("_ld_of")))
    heavy = heavy.where((F.col("n") >= min_pages) & (F.col("n") > max_ratio * F.col("n_pages")))
    return heavy.groupBy("_ld_site").agg(F.collect_set("digest").alias("_ld_bad"))


def clean_lines(
    docs: DataFrame,
    site: str = "source",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    copies: bool = True,
) -> DataFrame:
    """All columns of ``docs`` with boilerplate lines cut from ``text``, and ``n_lines, n_removed``.

    Lines are compared without the blanks at their ends; blank lines stay.  A line goes where
    it is on more than ``max_ratio`` of the site's pages and on ``min_pages`` at least; pages
    are rows, copies included; without ``copies``, they are the distinct texts of the site, so
    that copies of a text don't make its lines boilerplate.  A null site is a site; a null text stays null; a text of
    boilerplate only becomes empty.  An empty table gives an empty result.  A column named
    ``n_lines`` or ``n_removed`` of ``docs`` is replaced.
    """
    bad = settle(boilerplate(docs, site, max_ratio, min_pages, copies), "boilerplate").withColumnRenamed("_ld_site", "_ld_of")
    lines = F.split("text", "\n")
    known = lambda x: F.array_contains(F.col("_ld_bad"), _digest(x))
    kept = F.when(F.col("_ld_bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~known(x)))
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    joined = docs.join(bad, F.col(site).eqNullSafe(F.col("_ld_of")), "left")
    cleaned = joined.withColumn("_ld_kept", F.when(F.col("text").isNotNull(), kept))
    return cleaned.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines),
            "n_removed": F.coalesce(F.size(lines) - F.size("_ld_kept"), F.lit(0)).cast("long"),
            "text": F.array_join("_ld_kept", "\n"),
        }
    ).drop("_ld_of", "_ld_bad", "_ld_kept")
