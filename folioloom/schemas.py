"""Schemas of the tables the operators exchange."""

from pyspark.sql import types as T

CHAPTER = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("title_cn", T.StringType()),
        T.StructField("title_vi", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("crawled_at", T.TimestampType()),
        T.StructField("translated_at", T.TimestampType()),
        T.StructField("error_message", T.StringType()),
    ]
)
PATTERNS = T.StructType(
    [
        T.StructField("chapter_selector", T.StringType()),
        T.StructField("content_selector", T.StringType()),
        T.StructField("title_selector", T.StringType()),
        T.StructField("elements_to_remove", T.ArrayType(T.StringType())),
    ]
)
METADATA = T.StructType(
    [
        T.StructField("translator", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("cover_path", T.StringType()),
    ]
)
BOOK = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("title_vi", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("author_vi", T.StringType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("patterns", PATTERNS),
        T.StructField("chapters", T.ArrayType(CHAPTER)),
        T.StructField("metadata", METADATA),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
# One row of a terms reply and of a terminology file.
ENTRY = T.StructType(
    [
        T.StructField("chinese", T.StringType()),
        T.StructField("vietnamese", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)
GLOSSARY = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("ordinal", T.LongType()),
    ]
)
STYLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("tone", T.StringType()),
        T.StructField("guidelines", T.ArrayType(T.StringType())),
        T.StructField("vocabulary", T.MapType(T.StringType(), T.StringType())),
        T.StructField("examples", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    ]
)
NARRATIVE_STATE = T.StructType(
    [
        T.StructField("speaker", T.StringType()),
        T.StructField("pronouns", T.MapType(T.StringType(), T.StringType())),
    ]
)
RUN_SETTINGS = T.StructType(
    [
        T.StructField("style", T.StringType()),
        T.StructField("workers", T.LongType()),
        T.StructField("chapters", T.StringType()),
        T.StructField("crawl_only", T.BooleanType()),
        T.StructField("translate_only", T.BooleanType()),
        T.StructField("no_glossary", T.BooleanType()),
        T.StructField("last_run_at", T.StringType()),
    ]
)
