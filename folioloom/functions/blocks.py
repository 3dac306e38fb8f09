"""Functions that write blocks of text from structured columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioloom import fixed_values as fixed
from folioloom.functions.text import non_empty


def _section(heading: Column, lines: Column) -> Column:
    """Heading, lines and a closing empty line; null where there are no lines."""
    return F.when(
        F.size(lines) > 0, F.concat(heading, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))
    )


def glossary_block(entries: Column, notes: bool = True) -> Column:
    """Entries grouped under the heading of their category, in the fixed category order.

    ``entries`` is an array of structs (term, target, category, notes) in the order the
    lines are to have.  Entries of an unknown category do not appear.
    """

    def line(entry: Column) -> Column:
        plain = F.concat(F.lit("- "), entry["term"], F.lit(" → "), entry["target"])
        if not notes:
            return plain
        extra = F.concat(F.lit(" ("), non_empty(entry["notes"]), F.lit(")"))
        return F.concat(plain, F.coalesce(extra, F.lit("")))

    def section(name: str) -> Column:
        own = F.filter(entries, lambda e: e["category"] == name)
        return _section(F.lit(f"### {fixed.CATEGORY_HEADINGS[name]}"), F.transform(own, line))

    return F.concat_ws("\n", *[section(name) for name in fixed.CATEGORIES])


def style_block(description: Column, guidelines: Column, vocabulary: Column, examples: Column) -> Column:
    """Description, guidelines, vocabulary and the first three examples of a style."""
    dash = lambda text: F.concat(F.lit("- "), text)
    words = F.transform(
        F.map_entries(vocabulary), lambda e: F.concat(F.lit("- "), e["key"], F.lit(" → "), e["value"])
    )
    pairs = F.transform(
        F.slice(examples, 1, 3),
        lambda e: F.concat(
            F.lit("- CN: "),
            F.coalesce(e["chinese"], F.lit("")),
            F.lit("\n  VN: "),
            F.coalesce(e["vietnamese"], F.lit("")),
        ),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit(f"**{fixed.STYLE_TITLE}: "), description, F.lit("**\n")),
        _section(F.lit(fixed.STYLE_GUIDELINES_HEADING), F.transform(guidelines, dash)),
        _section(F.lit(fixed.STYLE_VOCABULARY_HEADING), words),
        _section(F.lit(fixed.STYLE_EXAMPLES_HEADING), pairs),
    )


def naming_rules(name: Column, guidelines: Column, limit: int = 5) -> Column:
    """The first guidelines that speak of names, else the default rule."""

    def about_names(guideline: Column) -> Column:
        lowered = F.lower(guideline)
        found = F.lit(False)
        for word in fixed.NAMING_KEYWORDS:
            found = found | lowered.contains(word)
        return found

    rules = F.slice(F.filter(guidelines, about_names), 1, limit)
    lines = F.array_join(F.transform(rules, lambda r: F.concat(F.lit("- "), r)), "\n")
    before, _, after = fixed.NAMING_HEADING.partition("{name}")
    heading = F.concat(F.lit(before), name, F.lit(f"{after}\n"))
    return F.when(F.size(rules) > 0, F.concat(heading, lines)).otherwise(
        F.lit(fixed.DEFAULT_NAMING_RULE)
    )


def html_meta(author: Column, translator: Column, language: Column, description: Column) -> Column:
    """Meta tags of a book, the description only where there is one."""

    def tag(label: str, value: Column) -> Column:
        return F.concat(F.lit(f'<meta name="{label}" content="'), value, F.lit('">'))

    return F.concat_ws(
        "\n    ",
        tag("author", author),
        tag("translator", translator),
        tag("language", language),
        tag("description", F.replace(non_empty(description), F.lit('"'), F.lit("&quot;"))),
    )


def elapsed_label(seconds: Column, days: bool = False) -> Column:
    """``42s ago`` and so on; the form with days is the one for lists."""
    whole = F.floor(seconds)

    def part(unit: int, letter: str) -> Column:
        return F.concat(F.floor(whole / unit).cast("string"), F.lit(f"{letter} ago"))

    label = F.when(whole < 60, part(1, "s")).when(whole < 3600, part(60, "m"))
    if days:
        return label.when(whole < 86400, part(3600, "h")).otherwise(part(86400, "d"))
    minutes = (F.floor(whole / 60) % 60).cast("string")
    return label.otherwise(
        F.concat(F.floor(whole / 3600).cast("string"), F.lit("h "), minutes, F.lit("m ago"))
    )
