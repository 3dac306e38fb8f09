"""Functions over links and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioloom.functions.text import non_empty

# The component pattern given in appendix B of RFC 3986.
_PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def _without_dots(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments resolved."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)

    def step(kept: Column, segment: Column) -> Column:
        parent = F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return (
            F.when(segment == "..", parent)
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    resolved = F.aggregate(segments, F.array().cast("array<string>"), step)
    closed = F.when(last.isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)
    return F.when(path.contains("."), F.array_join(closed, "/")).otherwise(path)


def resolve_url(base: Column, reference: Column) -> Column:
    """The absolute URL a reference on a page stands for (RFC 3986)."""
    origin = F.concat(_part(base, 1), _part(base, 3))
    base_path = _part(base, 5)
    path = _part(reference, 5)
    query = _part(reference, 6)
    fragment = _part(reference, 8)
    folder = F.when(base_path == "", F.lit("/")).otherwise(
        F.regexp_replace(base_path, r"[^/]*$", "")
    )
    return (
        F.when(_part(reference, 2) != "", reference)
        .when(_part(reference, 3) != "", F.concat(_part(base, 1), reference))
        .when(
            path == "",
            F.concat(
                origin,
                base_path,
                F.when(query != "", query).otherwise(_part(base, 6)),
                fragment,
            ),
        )
        .when(path.startswith("/"), F.concat(origin, _without_dots(path), query, fragment))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), query, fragment))
    )


def chapter_id(href: Column) -> Column:
    """Number before ``.htm``/``.html`` at the end, else the last path part, else the link."""
    path = F.regexp_replace(_part(href, 5), "/+$", "")
    return F.coalesce(
        non_empty(F.regexp_extract(href, r"(\p{Nd}+)\.html?$", 1)),
        non_empty(F.element_at(F.split(path, "/", -1), -1)),
        href,
    )


def book_slug(url: Column) -> Column:
    """The last two path parts joined by a hyphen, word characters only."""
    path = F.regexp_replace(_part(url, 5), "^/+|/+$", "")
    parts = F.split(path, "/", -1)
    size = F.size(parts)
    tail = F.slice(parts, F.greatest(size - 1, F.lit(1)), F.least(size, F.lit(2)))
    return F.regexp_replace(F.array_join(tail, "-"), r"[^\p{L}\p{N}_-]", "")
