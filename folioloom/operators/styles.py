"""Styles in two layers: built-in rows, and custom rows that shadow them by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioloom.operators.ordering import keep_first
from folioloom.schemas import STYLE
from folioloom.session import work_folder

_FIELDS = ["description", "tone", "guidelines", "vocabulary", "examples"]


def parse_styles(rows: DataFrame, stem: str = "stem", text: str = "style_json") -> DataFrame:
    """Style rows from JSON text; unreadable text is listed under its stem, fields empty."""
    parsed = rows.withColumn("_s", F.from_json(text, STYLE))
    ok = F.col("_s.name").isNotNull()
    empty = {"description": F.lit(""), "tone": F.lit("")}
    return parsed.select(
        F.when(ok, F.col("_s.name")).otherwise(F.col(stem)).alias("name"),
        *[
            F.when(ok, F.col(f"_s.{f}")).otherwise(empty.get(f, F.lit(None))).alias(f)
            for f in _FIELDS
        ],
    )


def layered(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Every name once, the custom row before the built-in one, with its style_type."""
    both = builtin.withColumn("_layer", F.lit(1)).unionByName(custom.withColumn("_layer", F.lit(0)))
    order = ["_layer", "ordinal"] if "ordinal" in builtin.columns else ["_layer"]
    kinds = both.groupBy("name").agg(
        F.max(F.col("_layer") == 1).alias("is_builtin"), F.max(F.col("_layer") == 0).alias("_custom")
    )
    kind = (
        F.when(F.col("is_builtin") & F.col("_custom"), "shadow")
        .when(F.col("is_builtin"), "builtin")
        .otherwise("custom")
    )
    return (
        keep_first(both, "name", order)
        .join(kinds, "name")
        .withColumn("style_type", kind)
        .drop("_layer", "_custom")
    )


def style_names(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    return builtin.select("name").union(custom.select("name")).distinct().orderBy("name")


def lookup_styles(wanted: DataFrame, builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """For each wanted name its style row, null where there is none."""
    return wanted.join(layered(builtin, custom), "name", "left")


def search(styles: DataFrame, query: str) -> DataFrame:
    text = query.lower()
    return styles.filter(
        F.lower("name").contains(text)
        | F.lower("description").contains(text)
        | F.lower("tone").contains(text)
    )


def check_changes(changes: DataFrame, builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Changes (seq, op, name, new_name, fields) with ``accepted`` and the name they act on.

    create needs a free name, update a custom row or a free name, delete a custom row, duplicate
    a source.  All are judged by the state before the set.
    """
    marks = (
        builtin.select("name", F.lit(True).alias("_b"), F.lit(False).alias("_c"))
        .union(custom.select("name", F.lit(False), F.lit(True)))
        .groupBy("name")
        .agg(F.max("_b").alias("_builtin"), F.max("_c").alias("_custom"))
    )
    known = changes.join(marks, "name", "left").fillna(False, subset=["_builtin", "_custom"])
    exists = F.col("_builtin") | F.col("_custom")
    accepted = (
        F.when(F.col("op") == "create", ~exists)
        .when(F.col("op") == "update", F.col("_custom") | ~F.col("_builtin"))
        .when(F.col("op") == "delete", F.col("_custom"))
        .when(F.col("op") == "duplicate", exists)
        .otherwise(F.lit(False))
    )
    acts_on = F.when(F.col("op") == "duplicate", F.coalesce("new_name", "name")).otherwise(F.col("name"))
    return known.select(
        *changes.columns, accepted.alias("accepted"), acts_on.alias("target_name")
    )


def apply_changes(
    changes: DataFrame, builtin: DataFrame, custom: DataFrame, fields: list[str]
) -> DataFrame:
    """The custom layer after a set of changes, at most one per name.

    A duplicate takes its fields from the row the source name stands for.
    """
    checked = check_changes(changes, builtin, custom).filter("accepted")
    source = layered(builtin, custom).select("name", F.struct(*fields).alias("_source"))
    valued = checked.join(source, "name", "left").withColumn(
        "_value",
        F.when(F.col("op") == "duplicate", F.col("_source")).otherwise(F.struct(*fields)),
    )
    written = valued.filter("op != 'delete'").select(
        F.col("target_name").alias("name"), "seq", "_value"
    )
    last = written.groupBy("name").agg(F.max_by("_value", "seq").alias("_value"))
    untouched = custom.join(checked.select(F.col("target_name").alias("name")), "name", "left_anti")
    return untouched.select("name", *fields).unionByName(
        last.select("name", *[F.col(f"_value.{f}") for f in fields])
    )


def check_in_order(changes: DataFrame, builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Changes with ``accepted`` and ``target_name`` as in ``check_changes``, each judged by what
    those before it (by ``seq``) have left.

    Whether a name has a custom row is a state machine with two states.  Every change sets its
    name's state or leaves it: create and update make a custom row of a name that isn't
    built-in, delete takes it away, an accepted duplicate makes one of its target.  So the
    state before a change is what the last setting one left, found by a window over the name's
    changes.  A duplicate depends on its source, which may come from a duplicate: rounds go on
    until no verdict changes, one for each link of the longest such chain.
    """
    layers = builtin.select("name", F.lit(1).alias("_b"), F.lit(0).alias("_c")).union(
        custom.select("name", F.lit(0), F.lit(1))
    )
    marks = layers.groupBy(F.col("name").alias("_at")).agg(F.max("_b").alias("_b"), F.max("_c").alias("_c"))
    duplicate = F.col("op") == "duplicate"
    target = F.when(duplicate, F.coalesce("new_name", "name")).otherwise(F.col("name"))
    known = changes.withColumn("target_name", target)
    judged = _settled(known.withColumn("accepted", F.lit(False)))
    while True:
        # Everything is looked at in the name it reads, a duplicate also in the name it writes.
        reads = judged.select("seq", "op", F.col("name").alias("_at"), F.lit(True).alias("_reads"), "accepted")
        writes = judged.filter(duplicate & F.col("accepted"))
        writes = writes.select("seq", "op", F.col("target_name").alias("_at"), F.lit(False).alias("_reads"), "accepted")
        rows = reads.unionByName(writes).join(marks, "_at", "left").fillna(0, subset=["_b", "_c"])
        sets = (
            F.when(F.col("op") == "delete", 0)
            .when(F.col("op").isin("create", "update") & (F.col("_b") == 0), 1)
            .when(duplicate & ~F.col("_reads"), 1)
        )
        before = Window.partitionBy("_at").orderBy("seq", F.desc("_reads")).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_has", F.coalesce(F.last(sets, ignorenulls=True).over(before), "_c"))
        has, builtin_too = F.col("_has") == 1, F.col("_b") == 1
        verdict = (
            F.when(F.col("op") == "create", ~has & ~builtin_too)
            .when(F.col("op") == "update", has | ~builtin_too)
            .when(F.col("op") == "delete", has)
            .when(duplicate, has | builtin_too)
            .otherwise(F.lit(False))
        )
        verdicts = rows.filter("_reads").select("seq", verdict.alias("_verdict"))
        again = _settled(judged.join(verdicts, "seq"))
        moved = again.filter(F.col("_verdict") != F.col("accepted")).isEmpty()
        judged = again.withColumn("accepted", F.col("_verdict")).drop("_verdict")
        if moved or again.filter(duplicate).isEmpty():
            return judged.select(*changes.columns, "accepted", "target_name")


def apply_in_order(
    changes: DataFrame, builtin: DataFrame, custom: DataFrame, fields: list[str]
) -> DataFrame:
    """The custom layer after a set of changes made one after the other, by ``seq``.

    A name's row is what its last accepted change wrote.  A duplicate writes what its source
    had then; where that was a duplicate again, its source's, until one is found that has
    fields of its own.
    """
    checked = _settled(check_in_order(changes, builtin, custom).filter("accepted"))
    duplicate = F.col("op") == "duplicate"
    reads = checked.filter(duplicate).select("seq", F.col("name").alias("_at"), F.lit(True).alias("_reads"), F.lit(False).alias("_gone"))
    writes = checked.select("seq", F.col("target_name").alias("_at"), F.lit(False).alias("_reads"), (F.col("op") == "delete").alias("_gone"))
    before = Window.partitionBy("_at").orderBy("seq", F.desc("_reads")).rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.last(F.when(~F.col("_reads"), F.struct("seq", "_gone")), ignorenulls=True).over(before)
    found = reads.unionByName(writes).withColumn("_last", wrote).filter("_reads")
    # Of each duplicate the change that wrote its source: none where it is a row from before the
    # set, or the built-in one after a delete.
    source = found.select(
        "seq", F.when(~F.col("_last._gone"), F.col("_last.seq")).alias("_from"),
        F.when(F.col("_last._gone").isNull(), "before").when(F.col("_last._gone"), "builtin").alias("_layer"),
        F.col("_at").alias("_name"),
    )
    source = _settled(source)
    while True:
        up = source.select(F.col("seq").alias("_from"), F.col("_from").alias("_up"), F.col("_layer").alias("_l"), F.col("_name").alias("_n"))
        further = source.join(up, "_from", "left")
        hit = F.col("_n").isNotNull()
        if further.filter(hit).isEmpty():
            break
        source = _settled(
            further.select(
                "seq",
                F.when(hit, F.col("_up")).otherwise(F.col("_from")).alias("_from"),
                F.when(hit, F.col("_l")).otherwise(F.col("_layer")).alias("_layer"),
                F.when(hit, F.col("_n")).otherwise(F.col("_name")).alias("_name"),
            )
        )
    own = checked.filter(~duplicate).select(F.col("seq").alias("_from"), F.struct(*fields).alias("_own"))
    stood = layered(builtin, custom).select(F.col("name").alias("_name"), F.struct(*fields).alias("_stood"))
    given = builtin.select(F.col("name").alias("_name"), F.struct(*fields).alias("_given"))
    copied = source.join(own, "_from", "left").join(stood, "_name", "left").join(given, "_name", "left")
    copied = copied.select(
        "seq",
        F.when(F.col("_layer") == "before", F.col("_stood")).when(F.col("_layer") == "builtin", F.col("_given")).otherwise(F.col("_own")).alias("_copy"),
    )
    valued = checked.join(copied, "seq", "left").withColumn(
        "_value", F.when(duplicate, F.col("_copy")).when(F.col("op") != "delete", F.struct(*fields))
    )
    last = valued.groupBy(F.col("target_name").alias("name")).agg(F.max_by(F.struct("op", "_value"), "seq").alias("_w"))
    kept = last.filter("_w.op != 'delete'").select("name", *[F.col(f"_w._value.{f}").alias(f) for f in fields])
    untouched = custom.join(last.select("name"), "name", "left_anti")
    return untouched.select("name", *fields).unionByName(kept)


def _settled(rows: DataFrame) -> DataFrame:
    """The rows written and read back: rounds would otherwise compute all those before."""
    path = work_folder(rows.sparkSession, "style-changes")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
