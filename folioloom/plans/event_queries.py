"""Queries over events, exports and styles."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.functions.blocks import naming_rules, style_block
from folioloom.operators import events as ev
from folioloom.operators import styles as sy
from folioloom.operators.ordering import keep_first
from folioloom.plans import adapters as ad
from folioloom.plans.registry import query

_E = f"({ad.EVENTS_SQL})"


@query(
    f"SELECT job_id, arg_max(data, ts) AS data, max(ts) AS ts FROM {_E} WHERE type = 'progress' GROUP BY job_id"
)
def latest_event(spark, sf_dir):
    """Last progress of every job."""
    return ev.latest_progress(ad.events(spark, sf_dir))


@query(
    f"""SELECT event_id, job_id, ts, type FROM {_E}
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) <= 201"""
)
def recent_events(spark, sf_dir):
    """The last 201 events of every job."""
    return ev.recent_events(ad.events(spark, sf_dir)).select("event_id", "job_id", "ts", "type")


@query(
    f"""SELECT event_id, CASE type WHEN 'chapter_translated' THEN 'Ch.' || chapter_index || ' translated'
               WHEN 'chapter_crawled' THEN 'Ch.' || chapter_index || ' crawled'
               WHEN 'chapter_error' THEN 'Ch.' || chapter_index || ' error: e' || chapter_index
               WHEN 'job_started' THEN 'Job started' ELSE type END AS label,
               CASE WHEN type IN ('chapter_translated') THEN 'success'
                    WHEN type IN ('chapter_crawled', 'job_started') THEN 'warning'
                    WHEN type = 'chapter_error' THEN 'error' ELSE 'other' END AS level
        FROM {_E}"""
)
def event_labels(spark, sf_dir):
    """Readable text and level of every event."""
    return ad.events(spark, sf_dir).select(
        "event_id",
        ev.event_label(F.col("type"), F.col("data")).alias("label"),
        ev.event_level(F.col("type")).alias("level"),
    )


@query(f"SELECT job_id, count(*) AS n_shown FROM {_E} WHERE type NOT IN ('progress', 'heartbeat') GROUP BY job_id")
def event_log_sizes(spark, sf_dir):
    """Size of the log view of every job."""
    shown = ev.event_filter(ad.events(spark, sf_dir), log_view=True)
    return shown.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_shown"))


@query(
    f"""SELECT job_id, count(*) FILTER (type = 'chapter_crawled') AS n_crawled,
               count(*) FILTER (type = 'chapter_translated') AS n_translated,
               count(*) FILTER (type = 'chapter_error') AS n_errors, max(ts) AS last_ts
        FROM {_E} GROUP BY job_id"""
)
def job_progress_rollup(spark, sf_dir):
    """Counters of every job; crawl and translate errors together."""
    kind = F.col("type")
    split = F.when(kind == "chapter_error", F.when(F.col("chapter_index") % 2 == 0, "crawl_error").otherwise("translate_error"))
    return ev.job_progress(ad.events(spark, sf_dir).withColumn("type", F.coalesce(split, kind)))


_FORMATS = ["epub", "azw3", "mobi", "pdf"]


@query(
    """SELECT book_id, """
    + ", ".join(f"min(path) FILTER (format = '{f}') AS {f}" for f in _FORMATS)
    + """ FROM (SELECT 'host' || (page_id % 50) AS book_id, url AS path,
                       (['epub','azw3','mobi','pdf'])[page_id % 7 + 1] AS format FROM pages) GROUP BY book_id"""
)
def export_status(spark, sf_dir):
    """Existing output per book and format."""
    names = F.array(*[F.lit(f) for f in _FORMATS])
    pages = ad.table(spark, sf_dir, "pages")
    files = pages.select(
        F.concat(F.lit("host"), (F.col("page_id") % 50).cast("string")).alias("book_id"),
        F.col("url").alias("path"),
        F.get(names, (F.col("page_id") % 7).cast("int")).alias("format"),
    )
    return ev.export_status(files, _FORMATS)


def _styles(spark, sf_dir):
    """Styles from parts: one name per brand and size group, a third of them custom."""
    parts = ad.table(spark, sf_dir, "part")
    rows = parts.select(
        F.concat(F.col("p_brand"), F.lit("/"), (F.col("p_size") % 3).cast("string")).alias("name"),
        F.concat(F.lit("Style "), F.col("p_type")).alias("description"),
        F.lower("p_type").alias("tone"),
        F.array(
            F.concat(F.lit("Keep names of "), F.col("p_name")),
            F.concat(F.lit("Write "), F.lower("p_type")),
            F.concat(F.lit("Giữ Tên "), F.col("p_name")),
        ).alias("guidelines"),
        F.create_map(F.col("p_name"), F.col("p_brand")).alias("vocabulary"),
        F.array(F.create_map(F.lit("chinese"), F.col("p_name"), F.lit("vietnamese"), F.col("p_type"))).alias("examples"),
        F.col("p_partkey").alias("ordinal"),
    )
    custom = F.col("ordinal") % 3 == 0
    return (
        keep_first(rows.filter(~custom), "name", "ordinal"),
        keep_first(rows.filter(custom), "name", "ordinal"),
    )


_PARTS = """(SELECT p_brand || '/' || (p_size % 3) AS name, 'Style ' || p_type AS description, lower(p_type) AS tone,
                    p_partkey AS ordinal, p_partkey % 3 = 0 AS custom, p_name, p_type, p_brand FROM part)"""
_LAYERS = f"(SELECT * FROM {_PARTS} QUALIFY row_number() OVER (PARTITION BY name, custom ORDER BY ordinal) = 1)"
_LAYERED = f"""(SELECT name, description, tone, ordinal, p_name, p_type, p_brand,
                  bool_or(NOT custom) OVER (PARTITION BY name) AS is_builtin,
                  CASE WHEN bool_or(custom) OVER (PARTITION BY name) AND bool_or(NOT custom) OVER (PARTITION BY name)
                       THEN 'shadow' WHEN custom THEN 'custom' ELSE 'builtin' END AS style_type
                FROM {_LAYERS} QUALIFY row_number() OVER (PARTITION BY name ORDER BY custom DESC) = 1)"""


@query(f"SELECT name, description, tone, is_builtin, style_type FROM {_LAYERED}")
def layered_styles(spark, sf_dir):
    """Every style once, custom before built-in, with its type."""
    return sy.layered(*_styles(spark, sf_dir)).select("name", "description", "tone", "is_builtin", "style_type")


@query(f"SELECT DISTINCT name FROM {_LAYERS}")
def style_names(spark, sf_dir):
    """Names of all styles."""
    return sy.style_names(*_styles(spark, sf_dir))


@query(f"SELECT name, tone FROM {_LAYERED} WHERE contains(lower(name), 'eco') OR contains(lower(description), 'eco') OR contains(lower(tone), 'eco')")
def style_search(spark, sf_dir):
    """Styles that contain a query in any case."""
    return sy.search(sy.layered(*_styles(spark, sf_dir)), "Eco").select("name", "tone")


@query(
    f"""SELECT name, '**Phong cách: ' || description || '**' || chr(10) || chr(10) || '### Nguyên tắc dịch thuật' || chr(10)
          || '- Keep names of ' || p_name || chr(10) || '- Write ' || lower(p_type) || chr(10) || '- Giữ Tên ' || p_name || chr(10)
          || chr(10) || '### Từ vựng chuẩn' || chr(10) || '- ' || p_name || ' → ' || p_brand || chr(10)
          || chr(10) || '### Ví dụ' || chr(10) || '- CN: ' || p_name || chr(10) || '  VN: ' || p_type || chr(10) AS block,
          '**Quy tắc dịch tên từ style ''' || name || ''':**' || chr(10) || '- Keep names of ' || p_name || chr(10)
          || '- Giữ Tên ' || p_name AS rules
        FROM {_LAYERED}"""
)
def style_blocks(spark, sf_dir):
    """Styles as blocks of text, and their naming rules."""
    styles = sy.layered(*_styles(spark, sf_dir))
    block = style_block(F.col("description"), F.col("guidelines"), F.col("vocabulary"), F.col("examples"))
    return styles.select("name", block.alias("block"), naming_rules(F.col("name"), F.col("guidelines")).alias("rules"))


_OPS = "(['create','update','delete','duplicate'])[s_suppkey % 4 + 1]"
_CHANGES = f"""(SELECT s_suppkey AS seq, {_OPS} AS op, CASE WHEN s_suppkey % 9 = 0 THEN 'New/' || s_suppkey
                ELSE 'Brand#' || (s_suppkey % 25 + 1) || '/' || (s_suppkey % 3) END AS name FROM supplier)"""


def _changes(spark, sf_dir):
    ops = F.array(*[F.lit(o) for o in ("create", "update", "delete", "duplicate")])
    key = F.col("s_suppkey")
    brand = F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string"), F.lit("/"), (key % 3).cast("string"))
    name = F.when(key % 9 == 0, F.concat(F.lit("New/"), key.cast("string"))).otherwise(brand)
    return ad.table(spark, sf_dir, "supplier").select(
        key.alias("seq"),
        F.get(ops, (key % 4).cast("int")).alias("op"),
        name.alias("name"),
        F.when(key % 8 == 3, F.concat(F.lit("Copy/"), key.cast("string"))).alias("new_name"),
        F.col("s_name").alias("description"),
        F.lit("plain").alias("tone"),
    )


@query(
    f"""SELECT seq, op, c.name, CASE op WHEN 'create' THEN NOT (b OR cu) WHEN 'update' THEN cu OR NOT b
               WHEN 'delete' THEN cu ELSE b OR cu END AS accepted
        FROM (SELECT ch.*, coalesce(l.b, false) AS b, coalesce(l.cu, false) AS cu FROM {_CHANGES} ch
              LEFT JOIN (SELECT name, bool_or(NOT custom) AS b, bool_or(custom) AS cu FROM {_LAYERS} GROUP BY name) l
                ON l.name = ch.name) c"""
)
def style_changes(spark, sf_dir):
    """Which changes of styles are accepted."""
    return sy.check_changes(_changes(spark, sf_dir), *_styles(spark, sf_dir)).select("seq", "op", "name", "accepted")


_CHECKED = f"""(SELECT seq, op, c.name, description, CASE WHEN op = 'duplicate' THEN coalesce(new_name, c.name) ELSE c.name END AS target,
        CASE op WHEN 'create' THEN NOT (b OR cu) WHEN 'update' THEN cu OR NOT b WHEN 'delete' THEN cu ELSE b OR cu END AS accepted
    FROM (SELECT ch.*, coalesce(l.b, false) AS b, coalesce(l.cu, false) AS cu,
                 CASE WHEN seq % 8 = 3 THEN 'Copy/' || seq END AS new_name, s.s_name AS description
          FROM {_CHANGES} ch JOIN supplier s ON s.s_suppkey = ch.seq
          LEFT JOIN (SELECT name, bool_or(NOT custom) AS b, bool_or(custom) AS cu FROM {_LAYERS} GROUP BY name) l
            ON l.name = ch.name) c)"""


@query(
    f"""SELECT name, description, tone FROM {_LAYERS} WHERE custom AND name NOT IN
          (SELECT target FROM {_CHECKED} WHERE accepted)
        UNION ALL
        SELECT name, description, tone FROM (
          SELECT c.target AS name, c.seq, CASE WHEN op = 'duplicate' THEN l.description ELSE c.description END AS description,
                 CASE WHEN op = 'duplicate' THEN l.tone ELSE 'plain' END AS tone
          FROM {_CHECKED} c LEFT JOIN {_LAYERED} l ON l.name = c.name WHERE accepted AND op <> 'delete')
        QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1"""
)
def styles_after_changes(spark, sf_dir):
    """The custom layer after all accepted changes."""
    return sy.apply_changes(_changes(spark, sf_dir), *_styles(spark, sf_dir), ["description", "tone"])


@query(
    f"""SELECT DISTINCT w.name, l.description, l.style_type
        FROM (SELECT 'Brand#' || (s_suppkey % 40 + 1) || '/' || (s_suppkey % 4) AS name FROM supplier) w
        LEFT JOIN {_LAYERED} l ON l.name = w.name"""
)
def style_lookup(spark, sf_dir):
    """Styles by name, those that do not exist too."""
    key = F.col("s_suppkey")
    name = F.concat(F.lit("Brand#"), (key % 40 + 1).cast("string"), F.lit("/"), (key % 4).cast("string"))
    wanted = ad.table(spark, sf_dir, "supplier").select(name.alias("name")).distinct()
    return sy.lookup_styles(wanted, *_styles(spark, sf_dir)).select("name", "description", "style_type")


# Changes of an ordered set: names come back, so each is judged by those before it.  SQL makes
# them one after the other: ``done`` holds the custom layer as a map after every change.
_ORDERED = """(SELECT row_number() OVER (ORDER BY p_partkey) AS seq,
        (['create','update','delete','duplicate','create','delete'])[(p_partkey * 7 + p_size) % 6 + 1] AS op,
        CASE WHEN p_size % 3 = 0 THEN 'Own/' || (p_size % 7) ELSE 'Brand#' || (p_size % 25 + 1) || '/' || (p_size % 3) END AS name,
        CASE WHEN p_partkey % 2 = 0 THEN 'Own/' || (p_partkey % 7) ELSE 'Copy/' || (p_partkey % 5) END AS new_name,
        'Change ' || p_partkey AS description FROM part)"""
_FOLDED = f"""
    WITH RECURSIVE base AS MATERIALIZED (SELECT * FROM {_LAYERS}), ch AS MATERIALIZED (SELECT * FROM {_ORDERED}),
    builtin AS MATERIALIZED (SELECT map_from_entries(list((name, description))) AS b FROM base WHERE NOT custom),
    done AS (
      SELECT CAST(0 AS BIGINT) AS seq, map_from_entries(list((name, description))) AS m, CAST(NULL AS VARCHAR) AS op,
             CAST(NULL AS VARCHAR) AS name, false AS accepted FROM base WHERE custom
      UNION ALL
      SELECT seq, CASE WHEN NOT accepted THEN m WHEN op = 'delete' THEN
                 map_from_entries(list_filter(map_entries(m), lambda e: e.key <> name))
               ELSE map_concat(m, MAP {{target: value}}) END, op, name, accepted
      FROM (SELECT ch.seq, d.m, ch.op, ch.name, CASE WHEN ch.op = 'duplicate' THEN ch.new_name ELSE ch.name END AS target,
                   CASE WHEN ch.op = 'duplicate' THEN coalesce(d.m[ch.name], b[ch.name]) ELSE ch.description END AS value,
                   CASE ch.op WHEN 'create' THEN NOT (map_contains(d.m, ch.name) OR map_contains(b, ch.name))
                     WHEN 'update' THEN map_contains(d.m, ch.name) OR NOT map_contains(b, ch.name)
                     WHEN 'delete' THEN map_contains(d.m, ch.name)
                     ELSE map_contains(d.m, ch.name) OR map_contains(b, ch.name) END AS accepted
            FROM done d JOIN ch ON ch.seq = d.seq + 1, builtin))"""


def _ordered_changes(spark, sf_dir):
    part, size = F.col("p_partkey"), F.col("p_size")
    ops = F.array(*[F.lit(o) for o in ("create", "update", "delete", "duplicate", "create", "delete")])
    text = lambda n: n.cast("string")
    brand = F.concat(F.lit("Brand#"), text(size % 25 + 1), F.lit("/"), text(size % 3))
    return ad.table(spark, sf_dir, "part").select(
        part.cast("long").alias("seq"),
        F.get(ops, ((part * 7 + size) % 6).cast("int")).alias("op"),
        F.when(size % 3 == 0, F.concat(F.lit("Own/"), text(size % 7))).otherwise(brand).alias("name"),
        F.when(part % 2 == 0, F.concat(F.lit("Own/"), text(part % 7))).otherwise(F.concat(F.lit("Copy/"), text(part % 5))).alias("new_name"),
        F.concat(F.lit("Change "), text(part)).alias("description"),
    )


@query(f"{_FOLDED} SELECT seq - 1 + (SELECT min(p_partkey) FROM part) AS seq, op, name, accepted FROM done WHERE seq > 0")
def ordered_style_changes(spark, sf_dir):
    """Which changes of an ordered set are accepted."""
    checked = sy.check_in_order(_ordered_changes(spark, sf_dir), *_styles(spark, sf_dir))
    return checked.select("seq", "op", "name", "accepted")


@query(f"{_FOLDED} SELECT unnest(map_keys(m)) AS name, unnest(map_values(m)) AS description FROM (FROM done ORDER BY seq DESC LIMIT 1)")
def styles_after_ordered_changes(spark, sf_dir):
    """The custom layer after an ordered set."""
    return sy.apply_in_order(_ordered_changes(spark, sf_dir), *_styles(spark, sf_dir), ["description"])
