"""String functions as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioloom import fixed_values as fixed

# Whitespace as Unicode has it (plain ``\s`` and ``trim`` know only ASCII blanks).
_BLANK = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]"
_WORD = r"[\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    """Text without leading and trailing Unicode whitespace."""
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def squeeze(text: Column) -> Column:
    """Stripped text with every run of whitespace turned into one blank."""
    return F.regexp_replace(strip(text), f"{_BLANK}+", " ")


def non_empty(text: Column) -> Column:
    """Null in place of the empty string."""
    return F.nullif(text, F.lit(""))


def fallback(first: Column, second: Column, zero_is_unset: bool = False) -> Column:
    """``first`` unless it is null or empty (for numbers: zero), else ``second``."""
    unset = F.lit(0) if zero_is_unset else F.lit("")
    return F.coalesce(F.nullif(first, unset), second)


def truncate(text: Column, size: int) -> Column:
    return F.left(text, F.lit(size))


def percent(part: Column, whole: Column) -> Column:
    """Whole percentage, halves rounded up, 0 where there is nothing to divide by."""
    return F.coalesce(
        F.floor(F.lit(100.0) * part / F.nullif(whole, F.lit(0)) + 0.5), F.lit(0)
    ).cast("long")


def pad_key(index: Column, width: int = 4) -> Column:
    """Number with leading zeros; longer numbers are kept whole."""
    digits = index.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def slugify(text: Column, size: int = 50) -> Column:
    """Lower-case words joined by hyphens, at most ``size`` characters."""
    kept = F.regexp_replace(text, r"[^\p{L}\p{N}_\s\p{Z}-]", "")
    joined = F.regexp_replace(kept, r"[\s\p{Z}_]+", "-")
    trimmed = F.regexp_replace(joined, "^-+|-+$", "")
    return F.when(trimmed == "", F.lit("unknown-book")).otherwise(
        F.left(F.lower(trimmed), F.lit(size))
    )


def split_paragraphs(text: Column, separator: str = fixed.PARAGRAPH_BREAK) -> Column:
    """Paragraphs of a text, empty ones kept."""
    return F.split(text, _quote(separator), -1)


def split_sentences(paragraph: Column, ends: str = fixed.SENTENCE_ENDS) -> Column:
    """Sentences with their end marks; a final end mark leaves one empty sentence."""
    return F.split(paragraph, f"(?<=[{_class(ends)}])", -1)


def is_dialogue(
    paragraph: Column,
    marks: Sequence[str] = tuple(fixed.QUOTE_MARKS),
    attributions: Sequence[str] = tuple(fixed.ATTRIBUTION_WORDS),
) -> Column:
    """True where a quote mark or an attribution word occurs."""
    found = F.lit(False)
    for marker in [*marks, *attributions]:
        found = found | paragraph.contains(marker)
    return found


def occurrences(text: Column, term: Column) -> Column:
    """Number of non-overlapping occurrences of a non-empty term."""
    without = F.replace(text, term, F.lit(""))
    return F.floor(
        (F.octet_length(text) - F.octet_length(without)) / F.octet_length(term)
    ).cast("long")


def needs_scene_reset(text: Column, position: Column) -> Column:
    return text.contains(fixed.SCENE_BREAK) & (position > 0)


def lines_to_paragraphs(text: Column, separator: str = fixed.PARAGRAPH_BREAK) -> Column:
    """Non-empty lines with their whitespace squeezed, as paragraphs.

    One pass over the text turns all other whitespace into single blanks; lines then need
    only a plain trim.
    """
    flat = F.regexp_replace(text, f"[{_BLANK}&&[^\n ]]+|[{_BLANK}&&[^\n]]{{2,}}", " ")
    lines = F.transform(F.split(F.regexp_replace(flat, " {2,}", " "), "\n", -1), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda line: line != ""), separator)


def escape_markup(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def without_heading(text: Column) -> Column:
    """Text without its first line where that line is a ``#`` heading."""
    return F.when(
        text.startswith("#"),
        F.when(text.contains("\n"), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(F.lit("")),
    ).otherwise(text)


def paragraphs_html(text: Column, indent: str = "            ", escaped: bool = False) -> Column:
    """``<p>`` elements for the non-empty paragraphs of a text.

    The plain form drops a heading line and joins lines within a paragraph; the escaped
    form, for XHTML, keeps both and escapes markup.
    """
    body = strip(text if escaped else without_heading(text))
    paragraphs = F.transform(F.split(body, "\n\n", -1), strip)
    paragraphs = F.filter(paragraphs, lambda p: p != "")
    shape = escape_markup if escaped else (lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))
    return F.array_join(
        F.transform(paragraphs, lambda p: F.concat(F.lit(f"{indent}<p>"), shape(p), F.lit("</p>"))),
        "\n",
    )


def display_title(
    title_vi: Column, text: Column, title_cn: Column, index: Column, word: str = fixed.CHAPTER_WORD
) -> Column:
    """Target title, else the heading line of the text, else source title, else a number.

    A heading line that is only hash signs still counts, as an empty title.
    """
    first_line = strip(F.regexp_extract(text, r"^[^\n]*", 0))
    heading = strip(F.regexp_replace(first_line, "^#+", ""))
    return F.coalesce(
        non_empty(title_vi),
        F.when(first_line.startswith("#"), heading),
        non_empty(title_cn),
        F.concat(F.lit(f"{word} "), index.cast("string")),
    )


def normalize_title(title_vi: Column, title_cn: Column, word: str = fixed.CHAPTER_WORD) -> Column:
    """``Chương N rest``, with N from the numbered source title; others stay as they are."""
    number = non_empty(F.regexp_extract(title_cn, rf"第{_BLANK}*(\p{{Nd}}+){_BLANK}*章", 1))
    joints = r"[\s\p{Z}:\x{2013}\x{2014}-]"
    own_number = F.concat(
        F.lit(rf"(?iu)^{word}{_BLANK}*"), number, F.lit(rf"{_BLANK}*{joints}*{_BLANK}*")
    )
    rest = F.regexp_replace(title_vi, own_number, F.lit(""))
    rest = squeeze(F.regexp_replace(rest, f"^{joints}+", ""))
    return F.when(number.isNull(), title_vi).otherwise(
        F.concat(F.lit(f"{word} "), number, F.lit(" "), rest)
    )


def word_tokens(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(f"({_WORD}+)"), 1)


def replace_words(text: Column, words: Mapping[str, str] = fixed.LEAKED_WORDS) -> Column:
    """Whole-word, case-sensitive replacement of every listed word.

    The text is cut once into words and what is between them, however many words are listed.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"({_WORD}+|[^\\p{{L}}\\p{{N}}_]+)"), 1)
    targets = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.array_join(
        F.transform(pieces, lambda p: F.coalesce(F.try_element_at(targets, p), p)), ""
    )


def _quote(literal: str) -> str:
    """A regular expression that matches the literal text."""
    return "".join(c if c.isalnum() or not c.isascii() or c.isspace() else "\\" + c for c in literal)


def _class(characters: str) -> str:
    """The characters as the inside of a regular-expression class."""
    return "".join("\\" + c if c in "\\]^-[&" else c for c in characters)
