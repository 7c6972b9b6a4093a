"""Field paths and the positional patterns that select them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.errors import InvalidFields

ANY = "*"


def checked_pattern(pattern: Sequence[str]) -> list[str]:
    """A pattern is a path in which "*" stands for any one value of its level; it is checked as a whole."""
    if isinstance(pattern, str) or not pattern or any(not isinstance(x, str) or not x for x in pattern):
        raise InvalidFields(f"not a pattern: {pattern!r}")
    return list(pattern)


def valid_fields(fields: Column) -> Column:
    """Whether a path may be tracked: not empty, no null, empty or wildcard element."""
    return fields.isNotNull() & (F.size(fields) > 0) & ~F.exists(fields, lambda x: x.isNull() | x.isin("", ANY))


def matches(fields: Column, pattern: Sequence[str]) -> Column:
    """Whether the levels of a path that a pattern names have its values; the path may go deeper."""
    out = F.size(fields) >= len(pattern)
    for i, value in enumerate(pattern):
        if value != ANY:
            out &= F.get(fields, F.lit(i)) == value
    return out


def prefix(fields: Column, depth: int) -> Column:
    return F.slice(fields, 1, depth)
