"""Functions that read the free-text replies of a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioloom import fixed_values as fixed
from folioloom.functions.arrays import let
from folioloom.functions.text import non_empty, strip
from folioloom.schemas import ENTRY, NARRATIVE_STATE


def _valid_json(text: Column) -> Column:
    """The text where it is one JSON value and nothing else, else null.

    Parsing alone would accept text behind the value, so the text is also tried as the only
    item of a list.
    """

    def check(stripped: Column) -> Column:
        listed = F.try_parse_json(F.concat(F.lit("["), stripped, F.lit("]")))
        single = F.try_parse_json(stripped).isNotNull() & listed.isNotNull()
        return F.when(single & F.try_variant_get(listed, "$[1]", "variant").isNull(), stripped)

    return let(non_empty(strip(text)), check)


def lenient_json(reply: Column) -> Column:
    """JSON text of a reply: the whole, else a fenced block, else first to last brace, else {}."""
    return F.coalesce(
        _valid_json(reply),
        _valid_json(F.regexp_extract(reply, fixed.FENCED_BLOCK, 1)),
        _valid_json(F.regexp_extract(reply, fixed.IN_BRACES, 0)),
        F.lit("{}"),
    )


def parse_entries(reply: Column, limit: int | None = None) -> Column:
    """Entries of the bracketed list in a reply; one invalid entry voids the whole list.

    The limit cuts the list before its entries are checked, as it comes before any
    removal of duplicates.
    """
    found = _valid_json(F.regexp_extract(reply, fixed.IN_BRACKETS, 0))
    items = F.from_json(found, T.ArrayType(T.StringType()))
    if limit is not None:
        items = F.slice(items, 1, limit)

    def wrong(item: Column) -> Column:
        value = F.try_parse_json(item)

        def kind(field: str) -> Column:
            return F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))

        return (
            F.coalesce(F.try_variant_get(value, "$.chinese", "string"), F.lit(None)).isNull()
            | F.try_variant_get(value, "$.vietnamese", "string").isNull()
            | (kind("chinese") != "STRING")
            | (kind("vietnamese") != "STRING")
            | ~F.coalesce(kind("category"), F.lit("STRING")).isin("STRING")
            | ~F.coalesce(kind("notes"), F.lit("STRING")).isin("STRING", "VOID")
        )

    entries = F.transform(items, lambda item: F.from_json(item, ENTRY))
    entries = F.transform(
        entries,
        lambda e: F.struct(
            e["chinese"].alias("term"),
            e["vietnamese"].alias("target"),
            F.coalesce(e["category"], F.lit(fixed.DEFAULT_CATEGORY)).alias("category"),
            e["notes"].alias("notes"),
        ),
    )
    empty = F.filter(entries, lambda e: F.lit(False))
    bad = F.exists(items, lambda item: F.coalesce(wrong(item), F.lit(True)))
    return F.when(items.isNull(), F.array().cast(_ENTRIES)).when(bad, empty).otherwise(entries)


_ENTRIES = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("term", "target", "category", "notes")])
)


def parse_state(reply: Column, marker: str = fixed.STATE_MARKER) -> Column:
    """Struct (text, state_json): the reply split at its state block.

    Without a block, or with one that is not JSON, the whole reply is the text and the
    state is ``{}``; a block that is JSON but no object leaves the text before it.
    """
    place = F.locate(marker, reply)
    head = strip(F.substring(reply, F.lit(1), place - 1))
    block = _valid_json(F.substring(reply, place + len(marker), F.length(reply)))
    whole = F.struct(strip(reply).alias("text"), F.lit("{}").alias("state_json"))
    state = F.when(block.startswith("{"), block).otherwise(F.lit("{}"))
    return F.when((place == 0) | block.isNull(), whole).otherwise(
        F.struct(head.alias("text"), state.alias("state_json"))
    )


def state_fields(state_json: Column) -> Column:
    """The known fields of a narrative state."""
    return F.from_json(state_json, NARRATIVE_STATE)
