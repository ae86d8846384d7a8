"""States of the tests by period, stored once and merged for any span of periods.

A period's state has, for each label, the moments of every measured attribute (rows, mean, sum of
squared distances from it) and the counts of every counted attribute's values. States of several
periods merge exactly: counts add up, and distances from the common mean are those inside the periods
plus those of the periods' means. A report over a year thus reads a few rows per period and attribute,
and a period that is written again replaces its own state.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hypothesis

MOMENTS = "attribute STRING, label INT, n LONG, mean DOUBLE, spread DOUBLE, period STRING"
CELLS = "attribute STRING, value STRING, label INT, n LONG, period STRING"


def moment_states(df: DataFrame, label: str, attributes: Sequence[str], period: str) -> DataFrame:
    """(attribute, label, n, mean, spread, period) in one pass; ``spread`` is the sum of squared distances from the mean.

    Rows without a label or a period take no part.
    """
    known = df.where(F.col(label).isNotNull() & F.col(period).isNotNull())
    parts = []
    for i, a in enumerate(attributes):
        x = hypothesis.real(a)
        spread = F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0))
        parts.append(F.struct(F.lit(a).alias("attribute"), F.count(x).alias("n"), F.avg(x).alias("mean"), spread.alias("spread")).alias(f"a{i}"))
    wide = known.groupBy(F.col(period).cast("string").alias("period"), F.col(label).cast("int").alias("label")).agg(*parts)
    rows = wide.select("period", "label", F.inline(F.array(*[f"a{i}" for i in range(len(attributes))])))
    return rows.select("attribute", "label", "n", "mean", "spread", "period")


def cell_states(df: DataFrame, label: str, attributes: Sequence[str], period: str) -> DataFrame:
    """(attribute, value, label, n, period): counts in one pass."""
    known = df.where(F.col(label).isNotNull() & F.col(period).isNotNull()).withColumn("_period", F.col(period).cast("string"))
    cells = hypothesis._cells(known, label, attributes, "_period")
    return cells.select("attribute", "value", F.col("label").cast("int").alias("label"), "n", F.col("_period").alias("period"))


def save(df: DataFrame, path: str, label: str, measured: Sequence[str], counted: Sequence[str], period: str) -> None:
    """Store the states of all periods in ``df``; periods that are there already are replaced, others stay.

    Each kind is written in two steps by Spark's own commit, so a failed job leaves the states before it.
    """
    states = {"moments": (moment_states, measured), "cells": (cell_states, counted)}
    for name, (of, attributes) in states.items():
        if attributes:
            rows = of(df, label, attributes, period).hint("rebalance", "period")
            writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("period").parquet(f"{path}/{name}")


def merged_moments(states: DataFrame) -> DataFrame:
    """(attribute, label, n, mean, variance) over all periods of ``states``. Some rows per period; none of the rows behind them."""
    own = Window.partitionBy("attribute", "label")
    known = states.where("n > 0")
    common = F.sum(F.col("n") * F.col("mean")).over(own) / F.sum("n").over(own)
    apart = known.withColumn("common", common)
    n, away = F.sum("n"), F.col("mean") - F.col("common")
    spread = F.sum("spread") + F.sum(F.col("n") * away * away)
    return apart.groupBy("attribute", "label").agg(
        n.alias("n"), F.max("common").alias("mean"), F.when(n > 1, spread / (n - 1)).alias("variance")
    )


def report(
    spark: SparkSession, path: str, measured: Sequence[str], counted: Sequence[str], groups: tuple = (0, 1), periods: Column | None = None
) -> DataFrame:
    """The report of ``hypothesis.report`` from stored states alone, over all periods or those that meet ``periods``.

    ``periods`` is a condition on the column ``period``; only the folders of those periods are read.
    """

    def states(name: str, schema: str, attributes: Sequence[str]) -> DataFrame:
        rows = spark.read.schema(schema).parquet(f"{path}/{name}")
        rows = rows.where(F.col("attribute").isin(*attributes) & F.col("label").isin(*groups))
        return rows if periods is None else rows.where(periods)

    parts = []
    if measured:
        parts.append(hypothesis.t_of_moments(merged_moments(states("moments", MOMENTS, measured)), groups))
    if counted:
        counts = hypothesis._with_margins(states("cells", CELLS, counted), groups)
        parts.append(hypothesis.chi_square_of_counts(counts, groups))
    return hypothesis.with_p_values(reduce(DataFrame.unionByName, parts))
