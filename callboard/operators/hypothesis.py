"""Do good and bad conversations differ in an attribute? t-test and chi-square test."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import real
from ..functions.probability import p_values


def group_moments(df: DataFrame, label: str, attributes: Sequence[str]) -> DataFrame:
    """(attribute, label, n, mean, variance) from one pass over the rows.

    All attributes are aggregated side by side, so rows are neither repeated nor
    shuffled; only two short rows of partial sums leave each task.
    """
    wide = (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"))
        .agg(
            *[
                F.struct(
                    F.lit(a).alias("attribute"),
                    F.count(real(a)).alias("n"),
                    F.avg(real(a)).alias("mean"),
                    F.var_samp(real(a)).alias("variance"),
                ).alias(f"a{i}")
                for i, a in enumerate(attributes)
            ]
        )
    )
    return wide.select("label", F.inline(F.array(*[f"a{i}" for i in range(len(attributes))])))


def t_statistics(df: DataFrame, label: str, attributes: Sequence[str], groups: tuple = (0, 1)) -> DataFrame:
    """(attribute, test, statistic, df) of the two-sample t-test with pooled variance.

    The statistic is positive where the first group has the greater mean. A group with a
    single value adds no spread; no spread at all gives no statistic.
    """
    return t_of_moments(group_moments(df.where(F.col(label).isin(*groups)), label, attributes), groups)


def t_of_moments(moments: DataFrame, groups: tuple = (0, 1)) -> DataFrame:
    """The same from (attribute, label, n, mean, variance)."""

    def of(group, what):
        return F.max(F.when(F.col("label") == group, F.col(what)))

    sides = moments.groupBy("attribute").agg(
        *[of(g, w).alias(f"{w}{i}") for i, g in enumerate(groups) for w in ("n", "mean", "variance")]
    )
    return sides.select(
        "attribute",
        F.lit("t").alias("test"),
        F.expr(
            """try_divide(mean0 - mean1, sqrt(
                 try_divide(if(n0 > 1, variance0 * (n0 - 1), 0.0D) + if(n1 > 1, variance1 * (n1 - 1), 0.0D),
                            double(n0 + n1 - 2))
                 * (try_divide(1.0D, n0) + try_divide(1.0D, n1))))"""
        ).alias("statistic"),
        F.expr("double(n0 + n1 - 2)").alias("df"),
    )


def _value_counts(df: DataFrame, label: str, attributes: Sequence[str], labels: Sequence) -> DataFrame:
    """(attribute, value, o0, o1, ..., column, r0, r1, ..., total, k): counts per value with their margins.

    Rows are counted once for all attributes, with map-side sums. The margins have one row
    per attribute and are joined back to the counts.
    """
    return _with_margins(_cells(df.where(F.col(label).isin(*labels)), label, attributes), labels)


def _cells(df: DataFrame, label: str, attributes: Sequence[str], *by: str) -> DataFrame:
    """(by, attribute, value, label, n): rows by label and value, of all attributes in one pass."""
    pairs = [F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes]
    rows = df.select(*by, F.col(label).alias("label"), F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
    return rows.groupBy(*by, "attribute", "value", "label").agg(F.count("*").alias("n"))


def _with_margins(cells: DataFrame, labels: Sequence) -> DataFrame:
    numbers = range(len(labels))
    counts = (
        cells.groupBy("attribute", "value")
        .agg(*[F.coalesce(F.sum(F.when(F.col("label") == g, F.col("n"))), F.lit(0)).alias(f"o{i}") for i, g in enumerate(labels)])
        .withColumn("column", F.expr(" + ".join(f"o{i}" for i in numbers)))
    )
    margins = counts.groupBy("attribute").agg(
        *[F.sum(f"o{i}").cast("double").alias(f"r{i}") for i in numbers],
        F.sum("column").cast("double").alias("total"),
        F.count("*").alias("k"),
    )
    return counts.join(F.broadcast(margins), "attribute")


def expected_cells(df: DataFrame, label: str, attributes: Sequence[str], labels: Sequence = (0, 1)) -> DataFrame:
    """(attribute, value, label, observed, expected) for every cell, including those that never occur."""
    cell = [
        F.struct(
            F.lit(g).alias("label"), F.col(f"o{i}").alias("observed"), F.expr(f"r{i} * column / total").alias("expected")
        )
        for i, g in enumerate(labels)
    ]
    return _value_counts(df, label, attributes, labels).select("attribute", "value", F.inline(F.array(*cell)))


def chi_square_statistics(
    df: DataFrame, label: str, attributes: Sequence[str], labels: Sequence = (0, 1), correction: bool = True
) -> DataFrame:
    """(attribute, test, statistic, df) of the test of independence of label and attribute.

    Continuity-corrected for one degree of freedom. A label that never occurs takes no part.
    """
    return chi_square_of_counts(_value_counts(df, label, attributes, labels), labels, correction)


def chi_square_of_counts(counts: DataFrame, labels: Sequence = (0, 1), correction: bool = True) -> DataFrame:
    """The same from what ``_value_counts`` gives."""
    numbers = range(len(labels))
    gaps = [f"abs(o{i} - r{i} * column / total)" for i in numbers]
    plain = " + ".join(f"coalesce(try_divide(pow({gaps[i]}, 2), r{i} * column / total), 0.0D)" for i in numbers)
    less = " + ".join(
        f"coalesce(try_divide(pow({gaps[i]} - least(0.5D, {gaps[i]}), 2), r{i} * column / total), 0.0D)" for i in numbers
    )
    rows = " + ".join(f"if(r{i} > 0, 1, 0)" for i in numbers)
    found = (
        counts
        .select("attribute", F.expr(plain).alias("plain"), F.expr(less).alias("less"), F.expr(f"({rows} - 1) * (k - 1)").alias("df"))
        .groupBy("attribute", "df")
        .agg(F.sum("plain").alias("plain"), F.sum("less").alias("less"))
    )
    statistic = F.when(F.col("df") == 1, F.col("less")).otherwise(F.col("plain")) if correction else F.col("plain")
    return found.select(
        "attribute", F.lit("chi_square").alias("test"), statistic.alias("statistic"), F.col("df").cast("double").alias("df")
    )


def with_p_values(results: DataFrame) -> DataFrame:
    """Add the p-value to test results, which have one row per attribute."""
    return results.withColumn("p_value", p_values("test", "statistic", "df"))


def t_test(df: DataFrame, label: str, attributes: Sequence[str], groups: tuple = (0, 1)) -> DataFrame:
    return with_p_values(t_statistics(df, label, attributes, groups))


def chi_square(
    df: DataFrame, label: str, attributes: Sequence[str], labels: Sequence = (0, 1), correction: bool = True
) -> DataFrame:
    return with_p_values(chi_square_statistics(df, label, attributes, labels, correction))


def report(
    df: DataFrame, label: str, numeric: Sequence[str], counted: Sequence[str], groups: tuple = (0, 1)
) -> DataFrame:
    """t-test of the ``numeric`` attributes and chi-square test of the ``counted`` ones in one table.

    Two passes over the rows, however many attributes there are.
    """
    parts = [t_statistics(df, label, numeric, groups)] if numeric else []
    parts += [chi_square_statistics(df, label, counted, groups)] if counted else []
    return with_p_values(reduce(DataFrame.unionByName, parts))
