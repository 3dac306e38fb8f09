"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions.arrays import let
from folioloom.llm.common import SPACE, whole_text

#: Frequent function words of the languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with is in for on as by it this was are at from "
    "le la les de des du et un une que qui dans pour par sur en est au aux avec "
    "der die das und ist von mit den ein eine zu im nicht auf für sich dem "
    "el los las y del que una para con por se no su al lo"
).split()
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A measure and the range it must lie in; a missing bound does not bind."""

    measure: str
    least: float | None = None
    most: float | None = None


#: Thresholds: lengths, symbols per word, stop words, lines.
RULES = (
    Rule("n_words", 50, 1_000_000),
    Rule("mean_word_chars", 2, 12),
    Rule("symbols_per_word", None, 0.1),
    Rule("n_stop_words", 2, None),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words that lie in windows of ``size`` words found twice or more, the first included.

    Windows are known by a 64-bit hash.  They are sorted with their places; a window with an
    equal neighbour is a repeat; its places, in order, count what they add to the ones before.
    """
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(size)]).alias("h"), i.alias("i"))

    def repeats(ordered: Column) -> Column:
        equal = lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"])
        return F.transform(F.filter(ordered, lambda x, k: F.coalesce(equal(x, k), F.lit(False))), lambda x: x["i"])

    places = F.sort_array(let(F.sort_array(F.transform(starts, window)), repeats))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last"))
    add = lambda s, i: F.struct((s["n"] + F.least(F.lit(size), i - s["last"])).alias("n"), i.alias("last"))
    return F.aggregate(places, start, add, lambda s: s["n"])


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measured(docs: DataFrame, *carried: str | Column) -> DataFrame:
    """All measures of every text, after the columns to carry along; see :func:`judged`."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda x: F.size(x).cast("long")

    def of_words(words: Column) -> Column:
        stops = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(list(STOP_WORDS)))
        return F.struct(
            count(words).alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
            let(stops, lambda s: F.struct(count(s).alias("n"), count(F.array_distinct(s)).alias("kinds"))).alias("stop"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            count(x).alias("n"),
            (count(x) - count(F.array_distinct(x))).alias("dup"),
            count(F.filter(x, lambda y: y.rlike(r"^[\x20\x09]*[-*•]"))).alias("bullet"),
            count(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("ellipsis"),
        )

    rows = docs.select(*carried, whole_text().alias("_text"))
    names = [name for name in rows.columns if name != "_text"]
    found = F.struct(
        let(F.filter(F.split(text, SPACE), lambda w: w != ""), of_words).alias("_word"),
        let(lines, of_lines).alias("_line"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    # A generator of one row: a filter above it isn't moved below, where it would measure again.
    return rows.select(*names, F.inline_outer(F.array(found))).select(
        *names,
        "_word.n_words",
        "_word.word_chars",
        "n_symbols",
        F.col("_line.dup").alias("n_dup_lines"),
        "_word.n_repeat_words",
        F.col("_line.n").alias("n_lines"),
        F.col("_word.stop.kinds").alias("n_stop_words"),
        _ratio(F.col("_word.word_chars"), F.col("_word.n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("_word.n_words")).alias("symbols_per_word"),
        _ratio(F.col("_word.stop.n"), F.col("_word.n_words")).alias("stop_word_ratio"),
        _ratio(F.col("_line.dup"), F.col("_line.n")).alias("dup_line_ratio"),
        _ratio(F.col("_line.bullet"), F.col("_line.n")).alias("bullet_line_ratio"),
        _ratio(F.col("_line.ellipsis"), F.col("_line.n")).alias("ellipsis_line_ratio"),
    )


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one condition over the measures."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            verdict = verdict & (F.col(rule.measure) >= rule.least)
        if rule.most is not None:
            verdict = verdict & (F.col(rule.measure) <= rule.most)
    return verdict


#: The measures that ``base_failed`` and its contract name.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: ``doc_id``, the base measures, ``base_failed``, ``kept``, and the
    measures of the other rules.

    Words are runs of characters other than ASCII white space.  ``base_failed``: fewer than
    50 words, or more than half of the words in repeated windows of three.  A null or empty
    text has no words and fails.  Equal rows get equal verdicts; an empty table gives an
    empty result; columns other than ``doc_id`` and ``text`` are not looked at.
    """
    judgement = measured(docs, "doc_id").withColumn("base_failed", base_failed())
    judgement = judgement.withColumn("kept", ~F.col("base_failed") & passes(rules))
    first = ["doc_id", *BASE, "base_failed", "kept"]
    return judgement.select(*first, *[c for c in judgement.columns if c not in first])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def good_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`judged` keeps."""
    judgement = measured(docs, F.struct("*").alias("_doc"))
    return judgement.where(~base_failed() & passes(rules)).select("_doc.*")
