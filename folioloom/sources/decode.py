"""Bytes to text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioloom.functions.slices import sliced

# The order in which encodings are tried.
FALLBACK_ENCODINGS = ["gbk", "gb18030", "utf-8", "latin-1"]
GBK_LABELS = ["gb2312", "gb18030"]


def normalize_encoding(label: Column) -> Column:
    """The superset encoding for the narrower Chinese labels; utf-8 where there is none."""
    return F.when(F.lower(label).isin(*GBK_LABELS), "gbk").otherwise(
        F.coalesce(F.nullif(label, F.lit("")), F.lit("utf-8"))
    )


@F.arrow_udf(T.StringType())
def _decode_chain(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    def one(data: bytes, first: str) -> str | None:
        if data is None:
            return None
        rest = [e for e in FALLBACK_ENCODINGS if e != first.lower()]
        for encoding in [first, *rest]:
            try:
                return data.decode(encoding)
            except (UnicodeDecodeError, LookupError):
                continue
        return data.decode("utf-8", errors="ignore")

    for content, label in columns:
        for piece in sliced(content):
            pairs = zip(content[piece].to_pylist(), label[piece].to_pylist(), strict=True)
            yield pa.array([one(d, e) for d, e in pairs], pa.string())


def decode_bytes(content: Column, label: Column) -> Column:
    """Text of bytes: the given encoding if they are valid in it, else the first that fits.

    Valid UTF-8 under a utf-8 label, the common case, never leaves the JVM: only the other
    rows reach the Arrow function (it gets nulls for these).
    """
    as_text = content.cast("string")
    plain = F.lower(label).isin("utf-8", "utf8") & F.is_valid_utf8(as_text)
    return F.coalesce(
        F.when(plain, as_text), _decode_chain(F.when(~plain, content), F.coalesce(label, F.lit("utf-8")))
    )
