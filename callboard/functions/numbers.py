"""Numbers: missing values, ratios, bands, recoding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the middle band of the health probability.
BAND_LOW = 0.35
BAND_HIGH = 0.7


def real(col: Column | str) -> Column:
    """Double with NaN turned to NULL, so that aggregates skip it and comparisons drop it."""
    col = F.col(col) if isinstance(col, str) else col
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def number(col: Column | str) -> Column:
    """Double from dirty text; what does not parse is NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """``top / bottom``, NULL where the bottom is 0 or either side is missing."""
    return F.try_divide(real(top), real(bottom))


def band(probability: Column | str, low: float = BAND_LOW, high: float = BAND_HIGH) -> Column:
    """0 up to ``low``, 2 from ``high``, 1 between, NULL for a missing probability."""
    p = real(probability)
    return F.when(p <= low, 0).when(p < high, 1).when(p >= high, 2)


def recode(col: Column | str, values: Mapping) -> Column:
    """Replace by ``values``; anything else becomes NULL."""
    col = F.col(col) if isinstance(col, str) else col
    result = None
    for old, new in values.items():
        result = (F if result is None else result).when(col == F.lit(old), F.lit(new))
    return result
