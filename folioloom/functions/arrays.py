"""Helpers around array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def each(array: Column | str) -> Column:
    """The same array, as an expression to explode.

    For a generator over a bare column Spark infers the filters "not null" and "not empty"
    and pushes them down to where the column is made: an array that is costly to build
    would be built three times.
    """
    return F.transform(array, lambda item: item)
