"""Prompts and runs of functions over documents."""

import pytest
from pyspark.sql import functions as F

from folioloom.operators import requests as rq
from folioloom.operators import terms


def test_prompt_sections(spark):
    chunks = spark.createDataFrame([(1, 0, "王林 走", None), (1, 1, "走", "trước")], "doc_id long, chunk_idx long, main_text string, context_text string")
    glossary = spark.createDataFrame([("王林", "Vương Lâm", "character", None, 0)], "term string, target string, category string, notes string, ordinal long")
    state = F.when(F.col("chunk_idx") == 0, "{}").otherwise('{"speaker": "A", "pronouns": {"他": "hắn"}, "other": 1}')
    fitted = terms.fit_terms(chunks.select("doc_id", F.col("main_text").alias("text")), glossary, "doc_id")
    first, second = rq.build_requests(chunks, fitted, F.lit("S"), state, key=["chunk_idx"]).orderBy("chunk_idx").collect()
    assert first.annotated == "王林<Vương Lâm> 走"
    assert first.user_prompt == "## Terms\n### Nhân vật\n- 王林 → Vương Lâm\n\n\n## Text\n王林<Vương Lâm> 走"
    assert first.system_prompt == "## Style\nS"
    assert second.glossary_block == "" and second.user_prompt == "## Before\ntrước\n\n## Text\n走"
    assert second.system_prompt == "## Style\nS\n\n## State so far\n- Speaker: A\n- Pronouns: 他→hắn"


def make_translator():
    """A function that workers get by value, as this module is not on their path."""

    def reply(main, context, state):
        if main == "boom":
            raise RuntimeError("down")
        tail = "" if "quiet" in main else '\n---STATE---\n{"speaker": "' + main[0] + '"}'
        return f"[{main}|{context}|{(state or {}).get('speaker') if state is not None else 'off'}]" + tail

    return reply


@pytest.mark.parametrize("partitions", [1, 3])
def test_documents_in_order_with_state(spark, partitions):
    data = [(1, ["a", "b", "c---", "d"]), (2, ["quiet1", "quiet2", "x"]), (3, ["a", "boom", "c"]), (4, ["quiet", "b", "quiet", "b"])]
    rows = [(d, i, t) for d, texts in data for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows[::-1], "doc_id long, chunk_idx long, main_text string")
    done = rq.translate_documents(chunks, make_translator(), overlap=4, partitions=partitions).collect()
    got = {(r.doc_id, r.chunk_idx): r for r in done}
    assert len(got) == len(rows)
    assert got[1, 0].translated == "[a|None|None]" and got[1, 1].translated == "[b|one]|a]"
    assert got[1, 2].state_json == "{}" and got[1, 3].translated == "[d|]|b]|None]"
    # Two replies without a state: the rest of the document runs without states, raw.
    assert got[2, 2].translated.startswith("[x|one]|off]\n---STATE---")
    assert got[3, 1].outcome == "error: down" and got[3, 2].outcome == "error: down" and got[3, 2].translated is None
    assert got[4, 3].translated.endswith("|b]")


def test_second_pass(spark):
    seen = spark.sparkContext.accumulator(0)

    def polish(source, draft):
        seen.add(1)
        if source == "bad":
            raise ValueError("no")
        return draft.upper()

    docs = spark.createDataFrame([("ok", "d"), ("bad", "d")], "source_text string, draft string").coalesce(1)
    got = {r.source_text: (r.polished, r.outcome) for r in rq.second_pass(docs, polish, retries=2).collect()}
    assert got == {"ok": ("D", "ok"), "bad": ("d", "kept draft: no")}
