"""All registered queries."""

from folioloom.plans import (  # noqa: F401
    book_queries,
    event_queries,
    file_queries,
    glossary_queries,
    page_queries,
    status_queries,
    stream_queries,
    text_queries,
)
from folioloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
