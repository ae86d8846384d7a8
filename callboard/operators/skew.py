"""Joins whose large side may have a hot key.

Adaptive execution splits a hot key by itself where both sides of a join are plain
shuffles and the result is not needed in the same partitioning again. That leaves two
kinds of join out: an aggregate joined back to its own rows, since it already sits on the
join key, and two joins in a row on one key. Those go through ``spread_join``.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is too much for one task.
ROWS_PER_TASK = 1_000_000
# Rows that stand for a task's worth when keys are counted on a sample.
COUNTED_ROWS = 1_000


def _known(on: Sequence[str]) -> Column:
    """True where no part of the key is missing: such rows join nothing."""
    return reduce(operator.and_, [F.col(c).isNotNull() for c in on])


def hot_keys(
    df: DataFrame, ons: Sequence[Sequence[str]], rows_per_task: int = ROWS_PER_TASK
) -> list[dict[int, int]]:
    """For each list of columns, the hash of every key too large for one task -> tasks it needs.

    One pass over the key columns counts all of them on a sample in which a task's worth of
    rows is about ``COUNTED_ROWS`` (all rows, where a task takes fewer). Counts are summed
    inside tasks first. At most ``rows / rows_per_task`` keys come back, with the number of
    tasks that their estimated rows fill, so the same rule holds at any size. Estimates decide
    how rows travel and never what a join returns; they are made once, so that both sides of a
    join agree.
    """
    share = min(1.0, COUNTED_ROWS / rows_per_task)
    rows = df.select(
        F.posexplode(F.array(*[F.when(_known(on), F.xxhash64(*on)) for on in ons])).alias("on", "key")
    )
    sample = rows.where("key IS NOT NULL")
    if share < 1.0:
        sample = sample.sample(share, seed=1)
    counted = sample.groupBy("on", "key").agg(F.count("*").alias("n")).where(F.col("n") > rows_per_task * share)
    found: list[dict[int, int]] = [{} for _ in ons]
    for r in counted.collect():
        found[r["on"]][r["key"]] = math.ceil(r["n"] / share / rows_per_task)
    return found


def hot_rows(df: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(_key, _tasks): what ``hot_keys`` finds for one list of columns, as rows that stay where they are.

    For keys that may be many because ``rows_per_task`` is small beside the table. Write them before they are
    used, so that all who use them agree.
    """
    share = min(1.0, COUNTED_ROWS / rows_per_task)
    rows = df.where(_known(on)).select(F.xxhash64(*on).alias("_key"))
    if share < 1.0:
        rows = rows.sample(share, seed=1)
    counted = rows.groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > rows_per_task * share)
    return counted.select("_key", F.ceil(F.col("n") / share / rows_per_task).cast("int").alias("_tasks"))


def spread_join(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot: Mapping[int, int] | DataFrame | None = None,
    spread_by: Column | None = None,
) -> DataFrame:
    """Equi-join that divides the rows of a hot key of ``large`` over as many tasks as they fill.

    Only the rows of ``small`` that belong to a hot key are repeated, once for each of its
    tasks. ``hot`` is the result of ``hot_keys`` if it is known already, or stored ``hot_rows``,
    which Spark broadcasts or not by their size. ``spread_by`` decides the place of a row; it has to give the same value when a lost task is run
    again, so the default is a hash of the whole row and not a random number. ``how`` is
    ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    """
    on = list(on)
    hot = hot_keys(large, [on])[0] if hot is None else hot
    if isinstance(hot, DataFrame):
        tasks = hot
    elif not hot:
        return large.join(small, on, how)
    else:
        # As many rows as there are hot keys: rows / rows per task at most.
        tasks = F.broadcast(large.sparkSession.createDataFrame(list(hot.items()), "_key LONG, _tasks INT"))
    spread = spread_by if spread_by is not None else F.xxhash64(*large.columns)
    left = large.withColumn("_key", F.xxhash64(*on)).join(tasks, "_key", "left")
    left = left.withColumn("_place", F.coalesce(F.pmod(spread, F.col("_tasks")).cast("int"), F.lit(0)))
    right = small.withColumn("_key", F.xxhash64(*on)).join(tasks, "_key", "left")
    right = right.withColumn("_place", F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1)))
    drop = ["_key", "_tasks"]
    return left.drop(*drop).join(right.drop(*drop), [*on, "_place"], how).drop("_place")
