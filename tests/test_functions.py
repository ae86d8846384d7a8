"""Edge rows of the column functions."""

import datetime
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from callboard.functions import dates, numbers, probability, text


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_key_without_version(spark):
    keys = ["A||B||2021", "A", "", "a||", "a|||b", "||x", None]
    assert column(spark, keys, "STRING", text.without_version) == ["A||B", "", "", "a", "a", "", None]


def test_band(spark):
    values = [0.35, 0.350001, 0.7, None, float("nan")]
    assert column(spark, values, "DOUBLE", numbers.band) == [0, 1, 2, None, None]


def test_recode(spark):
    assert column(spark, [1, -1, 0, None], "INT", lambda c: numbers.recode(c, {1: 1, -1: 0})) == [1, 0, None, None]


def test_ratio(spark):
    df = spark.createDataFrame(
        [(0, 4.0, 2.0), (1, 4.0, 0.0), (2, 0.0, 0.0), (3, None, 2.0), (4, 30.0, 2.0), (5, float("nan"), 2.0)],
        "i INT, a DOUBLE, b DOUBLE",
    )
    rows = df.orderBy("i").select(numbers.ratio("a", "b")).collect()
    assert [r[0] for r in rows] == [2.0, None, None, None, 15.0, None]


def test_number_from_dirty_text(spark):
    assert column(spark, ["4", " 3.5", "n/a", "NaN", None], "STRING", numbers.number) == [4.0, 3.5, None, None, None]


def test_day(spark):
    assert column(spark, ["2021-04-22 10:11:12"], "STRING", dates.day) == [datetime.date(2021, 4, 22)]
    lenient = column(spark, ["2021-04-22 10:11:12", "2021-04"], "STRING", lambda c: dates.day(c, strict=False))
    assert lenient == [datetime.date(2021, 4, 22), None]
    with pytest.raises(PySparkException):
        column(spark, ["2021-04"], "STRING", dates.day)


def test_like_none_drops_missing_text(spark):
    df = spark.createDataFrame([("2022-04-01",), ("2022-01-01",), (None,)], "d STRING")
    kept = df.where(text.like_none("d", text.month_patterns(["2022-04", "2022-03"]))).collect()
    assert [r.d for r in kept] == ["2022-01-01"]


@pytest.mark.parametrize(
    "t, df, p",
    # From printed tables of the t distribution (two-sided).
    [(12.706, 1, 0.05), (2.776, 4, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.96, 1e7, 0.05)],
)
def test_t_p_values(t, df, p):
    assert probability.t_p_value(t, df) == pytest.approx(p, abs=1e-4)
    assert probability.t_p_value(-t, df) == pytest.approx(p, abs=1e-4)


@pytest.mark.parametrize("x, df, p", [(3.841, 1, 0.05), (5.991, 2, 0.05), (18.307, 10, 0.05), (124.342, 100, 0.05)])
def test_chi_square_p_values(x, df, p):
    assert probability.chi_square_p_value(x, df) == pytest.approx(p, abs=1e-4)


def test_closed_forms():
    for x in (0.1, 1.0, 7.5, 40.0):
        assert probability.chi_square_p_value(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert probability.chi_square_p_value(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
        # One degree of freedom: the Cauchy distribution.
        assert probability.t_p_value(x, 1) == pytest.approx(1 - 2 * math.atan(x) / math.pi, rel=1e-10)
