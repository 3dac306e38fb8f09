"""Splitting texts into chunks that keep paragraphs and dialogue together.

The text itself stays in the JVM: Spark measures paragraphs and sentences, a small Arrow
function decides from those numbers alone where chunks begin and end, and Spark cuts the
text there.  All of it happens inside a row, so chunking needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom import fixed_values as fixed
from folioloom.functions.arrays import let
from folioloom.functions.text import is_dialogue, split_paragraphs, split_sentences

# A piece is `count` whole paragraphs from `first` on, or (count 0) part `part` of paragraph
# `first`: a sentence, or what one longer than a chunk is cut into.
_PIECES = "array<array<struct<first:int,count:int,part:int>>>"


def dialogue_ends(sizes: Sequence[int], talk: Sequence[bool], short: int) -> list[int]:
    """For every dialogue paragraph the last paragraph of its block, else -1."""
    count = len(sizes)
    ends = [-1] * count
    for i in range(count - 1, -1, -1):
        if not talk[i]:
            continue
        bridge = i + 1 < count and not talk[i + 1] and sizes[i + 1] < short
        after = i + 2 if bridge else i + 1
        ends[i] = ends[after] if after < count and talk[after] else i
    return ends


def plan_chunks(
    sizes: Sequence[int],
    talk: Sequence[bool],
    sentences: Sequence[Sequence[int] | None],
    limit: int,
    gap: int,
    overflow: float,
    short: int,
) -> list[list[tuple[int, int, int]]]:
    """Chunks as lists of pieces, from paragraph sizes, dialogue flags and sentence sizes."""
    chunks: list[list[tuple[int, int, int]]] = []
    held: list[tuple[int, int, int]] = []
    filled = 0
    ends = dialogue_ends(sizes, talk, short)
    reach = [0]
    for size in sizes:
        reach.append(reach[-1] + size)

    def hold(piece: tuple[int, int, int], length: int, fits: bool, cost: int) -> None:
        """Add a piece to the open chunk, or close that chunk and open one with the piece."""
        nonlocal held, filled
        if fits:
            held.append(piece)
            filled += cost
        else:
            if held:
                chunks.append(held)
            held, filled = [piece], length

    at = 0
    while at < len(sizes):
        size = int(sizes[at])
        if talk[at]:
            many = ends[at] - at + 1
            length = int(reach[ends[at] + 1] - reach[at]) + gap * (many - 1)
            fits = filled + length + gap <= limit
            if fits or length <= limit * overflow:
                hold((at, many, 0), length, fits, length + gap)
                at += many
                continue
        if size <= limit:
            hold((at, 1, 0), size, filled + size + gap <= limit, size + gap)
        else:
            if held:
                chunks.append(held)
            held, filled = [], 0
            part = 0
            for length in map(int, sentences[at]):
                if length > limit:
                    # Cut at once, even ahead of what the open chunk holds.
                    many = -(-length // limit)
                    chunks.extend([(at, 0, k)] for k in range(part, part + many))
                else:
                    many = 1
                    hold((at, 0, part), length, filled + length <= limit, length)
                part += many
        at += 1
    if held:
        chunks.append(held)
    return chunks


def _planner(limit: int, gap: int, overflow: float, short: int):
    @F.pandas_udf(_PIECES)
    def plan(sizes: pd.Series, talk: pd.Series, sentences: pd.Series) -> pd.Series:
        return pd.Series(
            [
                plan_chunks(a.tolist(), b.tolist(), c, limit, gap, overflow, short)
                for a, b, c in zip(sizes, talk, sentences)
            ]
        )

    return plan


def _sentences(paragraph: Column, ends: str) -> Column:
    """The sentences; a bare end mark is preceded by one empty sentence."""
    marks = F.array(*[F.lit(mark) for mark in ends])
    return F.flatten(
        F.transform(
            split_sentences(paragraph, ends),
            lambda s: F.when(F.array_contains(marks, s), F.array(F.lit(""), s)).otherwise(F.array(s)),
        )
    )


def _parts(sentences: Column, size: int) -> Column:
    """The sentences, those longer than a chunk cut into such of its size.

    One pass over a text cuts it; to count characters from its beginning for each part would
    take time with the square of its length.
    """
    cuts = lambda s: F.regexp_extract_all(s, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.flatten(
        F.transform(sentences, lambda s: F.when(F.length(s) > size, cuts(s)).otherwise(F.array(s)))
    )


def chunk_documents(
    docs: DataFrame,
    text: str = "text",
    size: int = fixed.CHUNK_SIZE,
    overlap: int = fixed.CHUNK_OVERLAP,
    separator: str = fixed.PARAGRAPH_BREAK,
    sentence_ends: str = fixed.SENTENCE_ENDS,
    marks: Sequence[str] = tuple(fixed.QUOTE_MARKS),
    attributions: Sequence[str] = tuple(fixed.ATTRIBUTION_WORDS),
    overflow: float = fixed.DIALOGUE_OVERFLOW,
    short: int = fixed.SHORT_NARRATION,
) -> DataFrame:
    """One row per chunk: chunk_idx, main_text and context_text instead of the text column.

    The context is the end of the previous chunk; the first chunk has none.
    """
    plan = _planner(size, len(separator), overflow, short)
    others = [c for c in docs.columns if c != text]
    long = lambda p: F.when(F.length(p) > size, _sentences(p, sentence_ends))
    split = docs.withColumn("_paras", split_paragraphs(F.col(text), separator))
    split = split.withColumn("_sentences", F.transform("_paras", long))
    measured = split.select(
        *others,
        "_paras",
        "_sentences",
        plan(
            F.transform("_paras", F.length),
            F.transform("_paras", lambda p: is_dialogue(p, marks, attributions)),
            F.transform("_sentences", lambda p: F.transform(p, F.length)),
        ).alias("_pieces"),
    )

    def cut(piece: Column, parts: Column) -> Column:
        whole = F.slice("_paras", piece["first"] + 1, piece["count"])
        part = F.element_at(F.element_at(parts, piece["first"] + 1), piece["part"] + 1)
        return F.when(piece["count"] > 0, F.array_join(whole, separator)).otherwise(part)

    def cut_all(parts: Column) -> Column:
        join = lambda pieces: F.array_join(F.transform(pieces, lambda p: cut(p, parts)), separator)
        return F.transform("_pieces", join)

    parts = F.transform("_sentences", lambda p: _parts(p, size))
    texts = measured.select(*others, let(parts, cut_all).alias("_chunks"))

    def row(chunk: Column, place: Column) -> Column:
        before = F.element_at("_chunks", F.greatest(place, F.lit(1)))
        return F.struct(
            place.cast("long").alias("chunk_idx"),
            chunk.alias("main_text"),
            F.when(place > 0, F.right(before, F.lit(overlap))).alias("context_text"),
        )

    return texts.select(*others, F.inline(F.transform("_chunks", row)))


def dialogue_islands(
    docs: DataFrame,
    text: str = "text",
    separator: str = fixed.PARAGRAPH_BREAK,
    marks: Sequence[str] = tuple(fixed.QUOTE_MARKS),
    attributions: Sequence[str] = tuple(fixed.ATTRIBUTION_WORDS),
    short: int = fixed.SHORT_NARRATION,
) -> DataFrame:
    """One row per dialogue block: first and last paragraph (0-based), paragraphs and length.

    Paragraph numbers, flags and sizes of the texts are enough, so only they leave the JVM.
    """

    @F.pandas_udf("array<struct<first_para:long,last_para:long,n_chars:long>>")
    def blocks(sizes: pd.Series, talk: pd.Series) -> pd.Series:
        def of_text(size: list[int], talks: list[bool]) -> list[tuple[int, int, int]]:
            ends = dialogue_ends(size, talks, short)
            found, at = [], 0
            while at < len(size):
                if talks[at]:
                    last = ends[at]
                    gaps = len(separator) * (last - at)
                    found.append((at, last, sum(size[at : last + 1]) + gaps))
                    at = last
                at += 1
            return found

        return pd.Series([of_text(a.tolist(), b.tolist()) for a, b in zip(sizes, talk)])

    others = [c for c in docs.columns if c != text]
    paras = docs.withColumn("_paras", split_paragraphs(F.col(text), separator))
    return paras.select(
        *others,
        F.inline(
            blocks(
                F.transform("_paras", F.length),
                F.transform("_paras", lambda p: is_dialogue(p, marks, attributions)),
            )
        ),
    )
