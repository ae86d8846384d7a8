"""Replace rows of a keyed table by newer ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``current`` with every row of ``changes`` put in its place by key, whole rows at a time.

    ``order`` names columns of ``changes`` that tell which of several writes to a key is the
    last (of equals, the greatest by its other columns); they are not part of the table unless
    ``current`` has them. Both inputs are read once and meet in one aggregate by key, which
    takes a change over what is there and the last change over others. It is no window: rows
    of a much-written key meet inside each task first. Where a row holds text, Spark sorts by
    key to do so; ``max_by`` on the ordering columns would too, as it carries the row along.
    """
    rest = [c for c in current.columns if c not in keys]
    kinds = dict(changes.dtypes)

    def side(df: DataFrame, newer: int) -> DataFrame:
        when = [(F.col(c) if newer else F.lit(None).cast(kinds[c])).alias(f"_{c}") for c in order]
        row = F.struct(F.lit(newer).alias("_newer"), *when, *[F.col(c) for c in rest])
        return df.select(*keys, row.alias("_row"))

    both = side(current, 0).unionByName(side(changes, 1))
    last = both.groupBy(*keys).agg(F.max("_row").alias("_row"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in current.columns])
