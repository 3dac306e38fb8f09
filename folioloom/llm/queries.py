"""Queries of the operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from folioloom.llm import (
    exact_dedup,
    jaccard_join,
    line_dedup,
    mixing,
    packing,
    periodic_runs,
    pii_crf,
    quality_rules,
    simhash_anchors,
    suffix_dedup,
    token_alignment,
    token_counts,
    url_lists,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_SQL = """
WITH lines AS (SELECT doc_id, source, unnest(list_distinct(list_transform(list_filter(
         string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)))) AS line FROM documents),
bad AS (SELECT l.source, line FROM lines l
    JOIN (SELECT source, count(*) AS n_pages FROM documents GROUP BY source) p ON l.source IS NOT DISTINCT FROM p.source
    GROUP BY l.source, line, n_pages HAVING count(*) >= 3 AND count(*) > 0.1 * n_pages),
lists AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
cut AS (SELECT d.doc_id, d.source, string_split(text, chr(10)) AS l,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(bad, []), trim(x))) AS k
    FROM documents d LEFT JOIN lists b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, array_to_string(k, chr(10)) AS text, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(k) AS BIGINT) AS n_removed FROM cut
"""


@query(LINE_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.clean_lines(docs, "source")


URL_SQL = r"""
WITH captures AS (SELECT page_id, url, nullif(lower(regexp_extract(url, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
    TIMESTAMP '2024-01-01' + to_minutes(CAST((page_id * 37) % 43200 AS INT)) AS fetched_at FROM pages),
hosts AS (SELECT page_id, host, string_split(host, '.') AS l FROM captures WHERE host IS NOT NULL),
entries AS (SELECT CASE WHEN event_id % 2 = 0 OR len(l) < 3 THEN host ELSE array_to_string(list_slice(l, 2, len(l)), '.') END AS entry, ts AS since,
    event_id AS seq, CASE event_type WHEN 'signup' THEN 'block' WHEN 'purchase' THEN 'block' WHEN 'click' THEN 'allow' ELSE 'remove' END AS action
    FROM events JOIN hosts ON page_id = user_id),
changes AS (SELECT entry, since, arg_max(action, seq) AS action FROM entries GROUP BY entry, since),
intervals AS (SELECT *, lead(since) OVER (PARTITION BY entry ORDER BY since) AS until FROM changes),
keys AS (SELECT c.page_id, c.fetched_at, unnest(list_transform(range(1, greatest(len(l), 2)), lambda k: array_to_string(list_slice(l, k, len(l)), '.'))) AS key
    FROM captures c JOIN hosts USING (page_id)),
hits AS (SELECT page_id, max({'n': length(entry), 'entry': entry, 'action': action, 'since': since}) AS h FROM keys JOIN intervals
    ON entry = key AND since <= fetched_at AND (until IS NULL OR fetched_at < until) WHERE action <> 'remove' GROUP BY page_id)
SELECT page_id, url, host, fetched_at, h.entry AS entry, h.action AS action, h.since AS listed_at,
    coalesce(h.action <> 'block', true) AS kept FROM captures LEFT JOIN hits USING (page_id)
"""


@query(URL_SQL)
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against a list whose changes are the events: a user's events change the entry of
    the page with the user's number, by host or by parent domain."""
    minutes = ((F.col("page_id") * 37) % 43200) * 60
    fetched = F.timestamp_seconds(F.lit(1704067200) + minutes).cast("timestamp_ntz")
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    hosts = captures.select(F.col("page_id").alias("user_id"), url_lists.host_of(F.col("url")).alias("host"))
    labels = F.split("host", r"\.")
    parent = F.array_join(F.slice(labels, 2, F.size(labels)), ".")
    kinds = F.when(F.col("event_type").isin("signup", "purchase"), url_lists.BLOCK)
    kinds = kinds.when(F.col("event_type") == "click", url_lists.ALLOW).otherwise(url_lists.REMOVE)
    entries = (
        _table(spark, sf_dir, "events")
        .join(hosts.where(F.col("host").isNotNull()), "user_id")
        .select(
            F.when((F.col("event_id") % 2 == 0) | (F.size(labels) < 3), F.col("host")).otherwise(parent).alias("entry"),
            kinds.alias("action"),
            F.col("ts").cast("timestamp_ntz").alias("at"),
            F.col("event_id").alias("seq"),
        )
    )
    return url_lists.judge_captures(captures, entries)


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"))


@query()
def op4_pii_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_pii(_table(spark, sf_dir, "documents"))


@query()
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


@query()
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@query()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_near(_table(spark, sf_dir, "documents"))


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


EXACT_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM n
"""


@query(EXACT_SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.owners(_table(spark, sf_dir, "documents"), keep="largest")


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, of which one text in ten is made periodic from some word on."""
    docs = periodic_runs.with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.digests(periodic_runs.find_runs(docs))


@query()
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align_tokens(_table(spark, sf_dir, "documents"), *models)


@query()
def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_anchors.near_documents(_table(spark, sf_dir, "documents"))
