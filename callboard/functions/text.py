"""Text: versioned keys and patterns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: separator of the parts of an employee key.
KEY_SEPARATOR = "||"


def without_version(key: Column | str) -> Column:
    """Employee key without its last part, which is the date of the version.

    A key with a single part gives ``''``, NULL stays NULL.
    """
    parts = F.split(key, r"\|\|")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), KEY_SEPARATOR)


def like_none(col: Column | str, patterns: Iterable[str]) -> Column:
    """True where ``col`` matches none of the LIKE patterns; unknown where it is NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return reduce(lambda a, b: a & b, [~col.like(p) for p in patterns], F.lit(True))


def month_patterns(months: Iterable[str]) -> list[str]:
    """LIKE patterns for months given as ``yyyy-MM``."""
    return [f"%{m}%" for m in months]
