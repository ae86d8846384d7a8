"""Dates kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how the source tables write a point in time.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def day(col: Column | str, strict: bool = True, fmt: str = TIME_FORMAT) -> Column:
    """Date of a point in time written as text.

    ``strict`` fails on malformed text, as the warehouse would; otherwise it is NULL.
    """
    parse = F.to_timestamp if strict else F.try_to_timestamp
    return F.to_date(parse(F.col(col) if isinstance(col, str) else col, F.lit(fmt) if not strict else fmt))
