"""Case tables stored by case."""

import re

import pytest
from pyspark.sql import DataFrame

from callboard import schemas
from callboard.operators import skew
from callboard.plans import performance
from callboard.sources import by_case
from registry import standins

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def rows_of(df):
    return sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


@pytest.mark.parametrize("rows_per_task", [1_000_000, 2])
def test_same_rows_without_moving_them_by_case(spark, tmp_path, no_broadcast, rows_per_task):
    t = standins.base_tables(spark, FOLDER)
    stored = performance.store_by_case(t, f"stored_{rows_per_task}", str(tmp_path), 4, rows_per_task)
    assert bool(stored.hot) == (rows_per_task == 2)
    found = performance.cases_with_health_by_case(spark, stored, t.employees)
    plain = performance.cases_with_health(t)
    assert set(found.columns) == set(plain.columns)
    assert rows_of(found) == rows_of(plain) and found.count() > 100
    # Without hot cases nothing is dealt by case any more; hot ones are, spread over tasks.
    by_key = [e for e in exchanges(found) if "case_key" in e]
    if stored.hot:
        assert by_key and all("_place" in e or "pred_score" in e or "chs" in e for e in by_key)
        hot = {r.case_key for r in stored.hot_table(spark, "cases").select("case_key").collect()}
        cold = {r.case_key for r in stored.table(spark, "cases").select("case_key").collect()}
        assert hot and not hot & cold
    else:
        assert by_key == [] and any("employee_key" in e for e in exchanges(found))
    assert [e for e in exchanges(plain) if "case_key" in e]
    by_case.drop(spark, stored)


def test_each_bucket_is_one_file_and_no_key_is_left_out(spark, tmp_path):
    t = standins.base_tables(spark, FOLDER)
    stored = performance.store_by_case(t, "stored_files", str(tmp_path), 3)
    assert len(list((tmp_path / "closed").glob("part-*"))) == 3
    assert stored.table(spark, "closed").count() == t.closed_cases.count()
    again = performance.store_by_case(t, "stored_files", str(tmp_path), 3)
    assert again.table(spark, "health").count() == t.health.count()
    by_case.drop(spark, again)


def test_missing_keys_and_empty_tables(spark, tmp_path):
    cases = spark.createDataFrame([(None, "x"), ("k", "y")], "case_key STRING, v STRING")
    other = spark.createDataFrame([("k", 1)], "case_key STRING, w INT")
    health = spark.createDataFrame([], schemas.HEALTH)
    stored = by_case.write(cases, other, health, "stored_odd", str(tmp_path), 2)
    assert [r.v for r in stored.table(spark, "cases").collect()] == ["y"]
    assert stored.table(spark, "health").count() == 0
    by_case.drop(spark, stored)


def test_hot_cases_are_stored_and_do_not_come_to_the_driver(spark, tmp_path, no_broadcast):
    n = 3000
    cases = spark.range(n * 3).selectExpr(f"string(id % {n}) AS case_key", "id AS v").unionByName(
        spark.range(5).selectExpr("string(-id - 1) AS case_key", "id AS v")
    )
    other = spark.range(n).selectExpr("string(id) AS case_key", "id AS w")
    health = spark.range(n).selectExpr("string(id) AS case_key", "1 AS pred_score", "0.5D AS model_prob", "1 AS chs")
    stored = by_case.write(cases, other, health, "stored_many_hot", str(tmp_path), 2, rows_per_task=2)
    # Rows in the shared folder, as many as there are hot cases; no list of them in the plan.
    assert isinstance(stored.hot, DataFrame)
    assert stored.hot.count() == n and {r["_tasks"] for r in stored.hot.collect()} == {2}
    assert stored.hot_table(spark, "cases").count() == 3 * n and stored.table(spark, "cases").count() == 5
    assert stored.hot_table(spark, "health").count() == n and stored.table(spark, "closed").count() == 0
    joined = skew.spread_join(stored.hot_table(spark, "cases"), stored.hot_table(spark, "closed"), ["case_key"], hot=stored.hot)
    assert sorted((r.v, r.w) for r in joined.collect()) == [(i, i % n) for i in range(3 * n)]
    by_case.drop(spark, stored)


@pytest.mark.parametrize("rows_per_task", [3, 2_000])
def test_hot_rows_are_what_hot_keys_finds(spark, rows_per_task):
    rows = spark.range(9_000).selectExpr("if(id < 8000, 'hot', nullif(string(id % 200), '7')) AS k")
    found = {r["_key"]: r["_tasks"] for r in skew.hot_rows(rows, ["k"], rows_per_task).collect()}
    (keys,) = skew.hot_keys(rows, [["k"]], rows_per_task)
    assert set(found) == set(keys) and len(keys) == (1 if rows_per_task > 3 else 1 + 199)
    assert rows_per_task > 3 or found == keys
