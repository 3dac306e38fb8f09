"""Request rows for a translator function, and runs of such a function over tables.

The function is the user's: ``fn(main_text, context, state) -> reply``.  No model is part of
this package.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioloom import fixed_values as fixed
from folioloom.functions.blocks import glossary_block
from folioloom.functions.replies import state_fields
from folioloom.functions.text import non_empty
from folioloom.operators.terms import annotate_chunks, relevant_terms

SECTIONS = {
    "style": "## Style",
    "state": "## State so far",
    "speaker": "- Speaker: ",
    "pronouns": "- Pronouns: ",
    "glossary": "## Terms",
    "context": "## Before",
    "text": "## Text",
}


def state_section(state_json: Column) -> Column:
    """Section on speaker and pronouns; null for an empty state."""
    state = state_fields(state_json)
    pairs = F.transform(
        F.map_entries(state["pronouns"]), lambda e: F.concat(e["key"], F.lit("→"), e["value"])
    )
    lines = F.concat_ws(
        "\n",
        F.lit(SECTIONS["state"]),
        F.concat(F.lit(SECTIONS["speaker"]), non_empty(state["speaker"])),
        F.concat(F.lit(SECTIONS["pronouns"]), non_empty(F.array_join(pairs, ", "))),
    )
    return F.when(F.coalesce(F.trim(state_json), F.lit("{}")) != "{}", lines)


def system_prompt(style: Column, state_json: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit(SECTIONS["style"] + "\n"), style), state_section(state_json))


def user_prompt(text: Column, glossary: Column, context: Column) -> Column:
    """Glossary, context and text, in this order; empty sections are left out."""

    def section(name: str, body: Column) -> Column:
        return F.concat(F.lit(SECTIONS[name] + "\n"), non_empty(body), F.lit("\n"))

    return F.concat_ws(
        "\n",
        section("glossary", glossary),
        section("context", context),
        F.concat(F.lit(SECTIONS["text"] + "\n"), text),
    )


def build_requests(
    chunks: DataFrame,
    glossary: DataFrame,
    style: Column,
    state_json: Column | None = None,
    annotate_limit: int = fixed.ANNOTATION_TERMS,
    glossary_limit: int = fixed.GLOSSARY_TERMS,
    *,
    key: list[str],
    small: bool = False,
) -> DataFrame:
    """One request row per chunk: annotated text, glossary block and both prompts.

    Terms are chosen twice: from the plain chunk for the annotation, and from the annotated
    chunk for the glossary block.
    """
    marked = annotate_chunks(chunks, glossary, annotate_limit, key=key, small=small)
    chosen = relevant_terms(marked, glossary, glossary_limit, "annotated", "_terms", key=key, small=small)
    state = F.lit("{}") if state_json is None else state_json
    return (
        chosen.withColumn("glossary_block", glossary_block(F.col("_terms")))
        .drop("_terms")
        .withColumn("system_prompt", system_prompt(style, state))
        .withColumn(
            "user_prompt", user_prompt(F.col("annotated"), F.col("glossary_block"), F.col("context_text"))
        )
    )


def split_reply(reply: str) -> tuple[str, dict]:
    """Text and state of a reply, by the rules of ``functions.replies.parse_state``."""
    head, marker, block = reply.partition(fixed.STATE_MARKER)
    if not marker:
        return reply.strip(), {}
    try:
        state = json.loads(block.strip())
    except ValueError:
        return reply.strip(), {}
    return head.strip(), state if isinstance(state, dict) else {}


def translate_documents(
    chunks: DataFrame,
    fn: Callable[[str, str | None, dict | None], str],
    doc: str = "doc_id",
    order: str = "chunk_idx",
    text: str = "main_text",
    overlap: int = fixed.CHUNK_OVERLAP,
    max_failures: int = fixed.STATE_FAILURES,
    partitions: int | None = None,
) -> DataFrame:
    """Run ``fn`` over the chunks of each document in order; one row per chunk.

    A call gets the end of the previous output as context and the state of the reply before
    it.  After ``max_failures`` replies without a state in a row a document is run without
    states; a scene break clears the state.

    Documents go to tasks whole and sorted, and are streamed through: a task holds one batch
    of rows and one state, however long a document is.  A call that fails marks its row and
    the rest of its document, never the run.
    """
    columns = [doc, order]
    schema = T.StructType(
        [chunks.schema[c] for c in columns]
        + [
            T.StructField("translated", T.StringType()),
            T.StructField("state_json", T.StringType()),
            T.StructField("outcome", T.StringType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, previous, state, failures, tracking, failed = None, None, {}, 0, True, None
        for batch in batches:
            rows = []
            for key, place, main in zip(batch[doc], batch[order], batch[text]):
                if key != current:
                    current, previous, state, failures, tracking, failed = key, None, {}, 0, True, None
                first = previous is None
                if failed is None:
                    try:
                        context = None if first else previous[-overlap:]
                        reply = fn(main, context, state if tracking else None)
                    except Exception as error:  # the document fails, the run goes on
                        failed = str(error) or type(error).__name__
                if failed is not None:
                    rows.append((key, place, None, None, f"error: {failed}"))
                    continue
                if tracking:
                    output, new_state = split_reply(reply)
                    if new_state:
                        state, failures = new_state, 0
                    else:
                        failures += 1
                        if failures >= max_failures:
                            tracking, state = False, {}
                else:
                    output = reply
                if tracking and not first and fixed.SCENE_BREAK in main:
                    state = {}
                previous = output
                rows.append((key, place, output, json.dumps(state, ensure_ascii=False, sort_keys=True), "ok"))
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    spread = chunks.select(*columns, text)
    spread = spread.repartition(partitions, doc) if partitions else spread.repartition(doc)
    return spread.sortWithinPartitions(doc, order).mapInPandas(run, schema)


def second_pass(
    docs: DataFrame,
    fn: Callable[[str, str], str],
    source: str = "source_text",
    draft: str = "draft",
    retries: int = 1,
) -> DataFrame:
    """Add the text ``fn(source, draft)`` gives and the outcome; the draft where it keeps failing."""

    @F.pandas_udf("text string, outcome string")
    def polish(sources: pd.Series, drafts: pd.Series) -> pd.DataFrame:
        def one(src: str, text: str) -> tuple[str, str]:
            problem = ""
            for attempt in range(retries + 1):
                try:
                    return fn(src, text), "ok" if attempt == 0 else f"ok after {attempt} retries"
                except Exception as error:
                    problem = str(error) or type(error).__name__
            return text, f"kept draft: {problem}"

        return pd.DataFrame(
            [one(s, d) for s, d in zip(sources, drafts)], columns=["text", "outcome"]
        )

    done = docs.withColumn("_done", polish(F.col(source), F.col(draft)))
    return done.select(
        *docs.columns, F.col("_done.text").alias("polished"), F.col("_done.outcome").alias("outcome")
    )
