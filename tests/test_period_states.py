"""Stored states of the tests, merged over periods."""

import random

import pytest
from pyspark.sql import functions as F

from callboard.operators import hypothesis, period_states

SCHEMA = "day STRING, y INT, x DOUBLE, z DOUBLE, c STRING, only STRING"


def frame(spark, n=3_000, days=7, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.choice([0, 1, 1, None])
        day = rng.randrange(days)
        x = rng.gauss(1e6 + 3 * day + (y or 0), 2) if rng.random() < 0.9 else rng.choice([None, float("nan")])
        rows.append((f"2024-01-{day + 1:02d}" if i % 50 else None, y, x, float(day) if day < 3 else None, rng.choice(["a", "b", "c", None]), "d" if day == 2 else None))
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def results(df):
    return {r.attribute: (r.test, r.statistic, r.df, r.p_value) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for name in a:
        assert a[name][0] == b[name][0]
        for u, v in zip(a[name][1:], b[name][1:]):
            assert u == v if u is None or v is None else u == pytest.approx(v, rel=1e-8, abs=1e-10)


def test_merged_report_is_that_of_all_rows(spark, tmp_path):
    df, path = frame(spark), str(tmp_path / "states")
    period_states.save(df, path, "y", ["x", "z"], ["c", "only"], "day")
    known = df.where("day IS NOT NULL")
    same(results(period_states.report(spark, path, ["x", "z"], ["c", "only"])), results(hypothesis.report(known, "y", ["x", "z"], ["c", "only"])))
    some = known.where("day >= '2024-01-03' AND day < '2024-01-06'")
    span = F.col("period").between("2024-01-03", "2024-01-05")
    same(results(period_states.report(spark, path, ["x"], ["c"], periods=span)), results(hypothesis.report(some, "y", ["x"], ["c"])))


def test_a_period_can_be_added_and_written_again(spark, tmp_path):
    df, path = frame(spark), str(tmp_path / "states")
    first, rest = df.where("day < '2024-01-05'"), df.where("day >= '2024-01-05'")
    period_states.save(first.union(rest.where("day = '2024-01-06'").limit(3)), path, "y", ["x"], ["c"], "day")
    period_states.save(rest, path, "y", ["x"], ["c"], "day")
    period_states.save(rest.where("day = '2024-01-07'"), path, "y", ["x"], ["c"], "day")
    same(results(period_states.report(spark, path, ["x"], ["c"])), results(hypothesis.report(df.where("day IS NOT NULL"), "y", ["x"], ["c"])))


def test_a_report_reads_states_of_its_periods_only(spark, tmp_path):
    df, path = frame(spark), str(tmp_path / "states")
    period_states.save(df, path, "y", ["x"], ["c"], "day")
    one = period_states.report(spark, path, ["x"], [], periods=F.col("period") == "2024-01-02")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan
    assert spark.read.parquet(f"{path}/moments").count() == 7 * 2


def test_periods_with_one_row_and_no_rows(spark, tmp_path):
    rows = [("a", 0, 1.0), ("b", 0, 2.0), ("c", 0, 3.0), ("a", 1, 2.0), ("d", 1, 4.0), ("e", 1, 6.0), ("f", 1, None)]
    df = spark.createDataFrame(rows, "day STRING, y INT, x DOUBLE")
    path = str(tmp_path / "states")
    period_states.save(df, path, "y", ["x"], [], "day")
    found = results(period_states.report(spark, path, ["x"], []))["x"]
    assert found[1] == pytest.approx(-1.5491933) and found[2] == 4.0
    period_states.save(df.limit(0), path + "-none", "y", ["x"], [], "day")
