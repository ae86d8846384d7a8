"""Descriptive tables: frequencies, means by label, crosstabs, histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import real
from ..session import materialize


def columns_by_kind(df: DataFrame) -> tuple[list[str], list[str]]:
    """Names of the categorical and of the numeric columns."""
    text = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return text, numeric


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Count of each value, most frequent first; missing values are left out."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc(column))
    )


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns) of a frame, one row."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def first_rows(df: DataFrame, order: Sequence[str | Column], n: int = 5) -> DataFrame:
    """The first rows by ``order``: each task keeps its ``n`` best, nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)


def count_by(df: DataFrame, keys: Sequence[str], counted: str, name: str) -> DataFrame:
    """Non-missing ``counted`` per group; groups with a missing key are left out."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(counted).alias(name))


def means_by_label(df: DataFrame, label: str, attributes: Sequence[str]) -> DataFrame:
    """Mean of every attribute per label, all in one pass."""
    return (
        df.where(F.col(label).isNotNull()).groupBy(label).agg(*[F.avg(real(a)).alias(a) for a in attributes])
    )


def cells(df: DataFrame, label: str, attribute: str) -> DataFrame:
    """Crosstab in long form: (label, attribute, count), only cells that occur."""
    return df.dropna(subset=[label, attribute]).groupBy(label, attribute).agg(F.count("*").alias("count"))


def crosstab(df: DataFrame, label: str, attribute: str, values: Sequence | None = None) -> DataFrame:
    """Crosstab with one column per attribute value.

    Without ``values`` Spark finds them with one more job and refuses more than
    ``spark.sql.pivotMaxValues`` of them; the long form has no such limit.
    """
    pivoted = df.dropna(subset=[label, attribute]).groupBy(label)
    pivoted = pivoted.pivot(attribute, list(values)) if values is not None else pivoted.pivot(attribute)
    return pivoted.count().na.fill(0)


def histograms(df: DataFrame, column: str, populations: Mapping[str, Column], bins: int = 50) -> DataFrame:
    """Equal-width histogram of ``column`` in each population, all in two passes.

    The column and the conditions are written once, and both passes read that.

    ``populations`` maps a name to a condition on the row. Bins run from the least to
    the greatest value of the population; the last one includes its upper edge. All
    ``bins`` bins are in the result, empty ones with count 0. A population with a
    single value gets a range of 1 around it.
    """
    data = df.select(real(column).alias("x"), *[c.alias(f"in_{p}") for p, c in populations.items()])
    data = materialize(data.where(F.col("x").isNotNull()), "histogram")
    # One row: the range of every population.
    ends = data.agg(
        F.array(
            *[
                F.struct(
                    F.lit(p).alias("population"),
                    F.min(F.when(F.col(f"in_{p}"), F.col("x"))).alias("least"),
                    F.max(F.when(F.col(f"in_{p}"), F.col("x"))).alias("greatest"),
                )
                for p in populations
            ]
        ).alias("ends")
    )
    alone = F.col("least") == F.col("greatest")
    ranges = ends.select(F.inline("ends")).select(
        "population",
        F.when(alone, F.col("least") - 0.5).otherwise(F.col("least")).alias("lo"),
        F.when(alone, F.col("greatest") + 0.5).otherwise(F.col("greatest")).alias("hi"),
    )
    # One row per population; the ranges come from the same small aggregate.
    ranges = F.broadcast(ranges.where(F.col("lo").isNotNull()))
    members = data.select(
        "x", F.explode(F.array_compact(F.array(*[F.when(F.col(f"in_{p}"), F.lit(p)) for p in populations]))).alias("population")
    )
    counted = (
        members.join(ranges, "population")
        .groupBy("population", F.least(F.width_bucket("x", "lo", "hi", F.lit(bins)), F.lit(bins)).cast("int").alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    grid = ranges.select("population", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).select(
        "population",
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("lower"),
        (F.col("lo") + F.col("bin") * width).alias("upper"),
    )
    return grid.join(F.broadcast(counted), ["population", "bin"], "left").na.fill(0, ["count"])
