"""Arrow columns in pieces, so that a task holds few of their values as Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the values that are objects at the same time, unless one value is longer.
SLICE = 1 << 20


def sliced(column: pa.Array, size: int = SLICE) -> Iterator[slice]:
    """Where to cut a column of strings or bytes: pieces of about ``size`` bytes."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield slice(start, stop)
        start = stop
