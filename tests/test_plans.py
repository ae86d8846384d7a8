"""The jobs on small frames with the edge rows that are easy to get wrong."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from callboard.plans import binning, cases, final_scores, health, productivity, roc, routing, scorecard
from callboard.schemas import CALL_CHAT, CLOSED_CASES, EMPLOYEES, PRODUCTIVITY


def frame(spark, schema, rows):
    """Rows given as dicts; columns not named are NULL."""
    names = [part.split()[0] for part in schema.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


CASE = {"language_key": "13", "data_source": "LE", "sales_support_flag": "Support"}


def test_case_facts_filters_and_columns(spark):
    chats = frame(
        spark,
        CALL_CHAT,
        [
            CASE | {"case_key": "1", "latest_employee_key": "E||S||1"},
            CASE | {"case_key": "2", "latest_employee_key": "E||S||1", "language_key": "14"},
            CASE | {"case_key": "3", "latest_employee_key": "E||S||1", "sales_support_flag": None},
            CASE | {"case_key": "4", "latest_employee_key": "none"},
            CASE | {"case_key": "5", "latest_employee_key": "E||S||1"},
        ],
    )
    people = frame(spark, EMPLOYEES, [{"employee_key": "E||S||1", "employee_name": "Ann"}])
    closed = frame(spark, CLOSED_CASES, [{"transaction_no": str(i)} for i in (1, 2, 3, 4)])
    newer = cases.case_facts(chats, people, closed)
    assert len(newer.columns) == 28
    assert [r.case_key for r in newer.collect()] == ["1"]
    older = cases.case_facts(chats, people, closed, support_only=False, queues=False)
    assert len(older.columns) == 22
    assert sorted(r.case_key for r in older.collect()) == ["1", "3"]


def test_productivity(spark):
    at = "2021-04-22 10:00:00"
    chats = frame(
        spark,
        CALL_CHAT,
        [{"latest_employee_key": "A||S||v1", "vendorid": "x", "interaction_starttime": at}] * 4
        + [{"latest_employee_key": "A||S||v1", "vendorid": None, "interaction_starttime": at}]
        + [{"latest_employee_key": "A||S||v2", "vendorid": "x", "interaction_starttime": at}] * 2
        + [{"latest_employee_key": "B||S||v1", "vendorid": "x", "interaction_starttime": at}] * 30
        + [{"latest_employee_key": "D||S||v1", "vendorid": "x", "interaction_starttime": at}],
    )
    work = frame(
        spark,
        PRODUCTIVITY,
        [
            {"employee_key": "A||S||v1", "cal_date": at, "login_time": 7200, "billable_hour": 3600},
            {"employee_key": "A||S||v1", "cal_date": at, "login_time": 3600, "billable_hour": 3600},
            {"employee_key": "A||S||v2", "cal_date": at, "login_time": 3600, "billable_hour": 3600},
            {"employee_key": "B||S||v1", "cal_date": at, "login_time": 3600, "billable_hour": 3600},
            {"employee_key": "C||S||v1", "cal_date": at, "login_time": 3600, "billable_hour": 3600},
            {"employee_key": "D||S||v1", "cal_date": at, "login_time": 3600, "billable_hour": 0},
            {"employee_key": "A||S||v1", "cal_date": "2022-04-01 00:00:00", "login_time": 9, "billable_hour": 9},
        ],
    )
    days = productivity.agent_days(
        productivity.cases_per_day(chats), productivity.hours_per_day(work, productivity.LEFT_OUT_MONTHS)
    )
    found = {r.latest_employee_key: r for r in days.collect()}
    assert set(found) == {"A||S||v1", "A||S||v2", "B||S||v1", "C||S||v1", "D||S||v1"}
    assert found["C||S||v1"].day == datetime.date(2021, 4, 22) and found["C||S||v1"].number_cases is None
    assert found["D||S||v1"].CPH is None
    agents = productivity.agent_rollup(chats, work).collect()
    # B has 30 contacts per hour, C no cases, D no billable hours.
    assert [tuple(r) for r in agents] == [("A||S", 2.0, 1.5, 2.0, 6.0)]
    older = {r.latest_employee_key: tuple(r)[1:] for r in productivity.agent_rollup_older(chats, work).collect()}
    assert older == {"A||S||v1": (3.0, 2.0, 2.0, 4.0), "A||S||v2": (1.0, 1.0, 2.0, 2.0)}


def test_duplicates_are_whole_rows(spark):
    found = spark.createDataFrame([("1",), ("2",)], "case_key STRING")
    scores = spark.createDataFrame(
        [("1", 1, 0.9, "a"), ("1", 1, 0.9, "a"), ("1", 1, 0.9, "b")],
        "case_key STRING, pred_score INT, model_prob DOUBLE, other STRING",
    )
    assert health.with_health(found, scores).count() == 2
    assert health.with_health(found, scores, dedup=False).count() == 3


def test_band_filter_keeps_missing(spark):
    rows = spark.createDataFrame([(0.35,), (0.350001,), (0.7,), (None,), (float("nan"),)], "model_prob DOUBLE")
    kept = health.without_middle(health.with_band(rows))
    assert kept.count() == 4


def test_issue_counts(spark):
    rows = [("a", "x", "1"), ("a", "x", "2"), ("a", "y", "3"), (None, "x", "4"), ("b", None, "5")]
    df = spark.createDataFrame(rows, "employee_name STRING, incidentlevel2reason STRING, case_key STRING")
    assert {r.case_key: r.counting for r in health.with_issue_counts(df).collect()} == {"1": 2, "2": 2, "3": 1}


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    one = {r.k for r in scorecard.split(df.repartition(1), "k")[1].collect()}
    many = {r.k for r in scorecard.split(df.repartition(13), "k")[1].collect()}
    train = {r.k for r in scorecard.split(df, "k")[0].collect()}
    assert one == many and not one & train and len(one | train) == 2000
    assert 300 < len(one) < 500


@pytest.fixture(scope="module")
def modelled(spark):
    """Rows with a real signal, gaps, a rare and a missing category, and the fitted model."""
    rng = np.random.default_rng(4)
    n = 4000
    pdf = pd.DataFrame(
        {
            "k": [str(i) for i in range(n)],
            "x": rng.normal(size=n),
            "z": rng.integers(0, 4, size=n).astype(float),
            "c": rng.choice(["red", "green", "blue", "rare"], size=n, p=[0.4, 0.3, 0.29, 0.01]),
        }
    )
    logit = 1.2 * pdf.x - 0.5 * pdf.z + (pdf.c == "red") * 1.0
    pdf["y"] = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype("int32")
    x = pdf.x.where(rng.random(n) > 0.1)
    c = pdf.c.where(rng.random(n) > 0.05)
    rows = [
        (k, None if pd.isna(a) else float(a), float(b), None if pd.isna(d) else d, int(e))
        for k, a, b, d, e in zip(pdf.k, x, pdf.z, c, pdf.y)
    ]
    df = spark.createDataFrame(rows, "k STRING, x DOUBLE, z DOUBLE, c STRING, y INT").repartition(5).cache()
    return df, scorecard.fit(df, ["x", "z"], ["c"], "y")


def test_bins_cover_all_rows_and_go_one_way(modelled):
    df, model = modelled
    table = model.table.toPandas()
    assert (table.groupby("variable").n.sum() == df.count()).all()
    for _, bins in table[table.bin >= 0].groupby("variable"):
        bins = bins.sort_values("bin")
        steps = np.diff(bins.event_rate)
        assert (steps > 0).all() or (steps < 0).all()
        assert (bins.n >= 0.05 * bins.n.sum()).all()
        assert np.isneginf(bins.lower.iloc[0]) and np.isposinf(bins.upper.iloc[-1])
        assert (bins.lower.iloc[1:].values == bins.upper.iloc[:-1].values).all()
    assert (table.groupby("variable").iv.sum() >= 0).all()


def newton(x, y, c):
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.diag([0.0] + [1.0] * (len(w) - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(c * (x.T * (p * (1 - p))) @ x + keep, c * x.T @ (p - y) + keep @ w)
    return w


def test_coefficients_agree_with_newton(modelled):
    df, model = modelled
    assert 0 < model.passes < 100
    table = model.table.withColumn("woe", F.when(F.col("bin") == -1, 0.0).otherwise(F.col("woe"))).collect()
    rows = scorecard._with_bins(df, model.binning, table, model.variables, "woe", "_w").toPandas()
    expected = newton(rows[[f"{v}_w" for v in model.variables]].values, rows.y.values, 5.0)
    found = [model.intercept] + [model.coefficients[v] for v in model.variables]
    assert found == pytest.approx(expected.tolist(), abs=1e-4)


def test_scores(spark, modelled):
    df, model = modelled
    scored = model.score(df)
    pdf = scored.toPandas()
    assert len(pdf) == df.count()
    assert pdf.score.between(-1e-9, 100 + 1e-9).all()
    assert pdf[pdf.y == 1].score.mean() > pdf[pdf.y == 0].score.mean()
    unseen = spark.createDataFrame([("n", None, None, "violet")], "k STRING, x DOUBLE, z DOUBLE, c STRING")
    neutral = sum(r.points for r in model.table.where("bin = -1").collect())
    assert model.score(unseen).first().score == pytest.approx(neutral)


def test_reverse_and_selection(modelled):
    df, model = modelled
    other = scorecard.fit(df, ["x", "z"], ["c"], "y", reverse=False)
    both = other.score(model.score(df, "up"), "down").select(F.round(F.col("up") + F.col("down"), 6).alias("s"))
    assert [r.s for r in both.distinct().collect()] == [100.0]
    chosen = scorecard.fit(df, ["x", "z"], ["c"], "y", select=(0.2, 10.0))
    values = {r.variable: r.iv for r in binning.information_values(model.binning.table).collect()}
    assert set(chosen.variables) == {v for v, iv in values.items() if 0.2 <= iv <= 10.0} != set(values)


def test_categories_are_joined_with_and_without_broadcast(spark, modelled):
    df, model = modelled
    before = {r.k: r.score for r in model.score(df).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        after = {r.k: r.score for r in model.score(df).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert after == before


def test_scorecard_can_be_stored(spark, modelled, tmp_path):
    df, model = modelled
    model.write(str(tmp_path / "card"))
    again = scorecard.Scorecard.read(spark, str(tmp_path / "card"))
    assert {r.k: r.score for r in again.score(df).collect()} == {r.k: r.score for r in model.score(df).collect()}
    assert sorted(map(tuple, again.category_bins().collect())) == sorted(map(tuple, model.category_bins().collect()))


def test_category_bins(modelled):
    df, model = modelled
    rows = {r.category: r for r in model.category_bins().collect()}
    assert set(rows) == {"red", "green", "blue", "rare"}
    counts = {r.c: r["count"] for r in df.groupBy("c").count().collect()}
    assert all(rows[c].n == counts[c] for c in rows)
    table = {(r.variable, r.bin): r for r in model.table.collect()}
    assert all(r.points == table["c", r.bin].points and r.woe == table["c", r.bin].woe for r in rows.values())


def test_rare_categories_are_folded(spark, modelled):
    df, _ = modelled
    model = scorecard.fit(df, ["x"], ["c"], "y", rare=0.05)
    rows = {r.category: r for r in model.category_bins().collect()}
    assert set(rows) == {"red", "green", "blue", "Other"}
    schema = "k STRING, x DOUBLE, c STRING"
    points = {r.k: r.score for r in model.score(spark.createDataFrame([(c, None, c) for c in ("rare", "violet", "red")], schema)).collect()}
    assert points["rare"] == points["violet"]
    missing = model.score(spark.createDataFrame([("m", None, None)], schema)).first().score
    absent = {r.variable: r.points for r in model.table.where("bin = -1").collect()}
    assert missing == pytest.approx(absent["x"] + absent["c"])
    assert points["violet"] == pytest.approx(absent["x"] + rows["Other"].points)


def test_folding_takes_the_chance_out_of_noise(spark):
    rng = np.random.default_rng(8)
    rows = [(f"c{i // 3}", int(rng.random() < 0.5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "c STRING, y INT")
    plain, folded = (
        binning.information_values(binning.fit_binning(df, [], ["c"], "y", rare=rare).table).first().iv for rare in (0.0, 0.01)
    )
    assert plain > 0.5 and folded < 0.01


def test_joined_bins():
    bins = [[0, 1, 10, 0], [1, 2, 100, 30], [2, 3, 100, 20], [3, 4, 100, 60], [4, 5, 2, 1]]
    joined = binning.joined_bins(bins, 0.05, "ascending")
    assert joined == [[0, 3, 210, 50], [3, 5, 102, 61]]
    assert binning.joined_bins(bins, 0.05, None) == [[0, 2, 110, 30], [2, 3, 100, 20], [3, 5, 102, 61]]
    assert binning.joined_bins([[0, 1, 5, 5]], 0.05, "auto") == [[0, 1, 5, 5]]


def test_curve_agrees_with_spark_ml(modelled):
    df, model = modelled
    scored = model.score(df)
    points = roc.curve(scored, "score", "y")
    area = roc.area(points).first()
    labelled = scored.select(F.col("score"), F.col("y").cast("double").alias("label"))
    expected = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(labelled)
    assert area.auc == pytest.approx(expected, abs=1e-9)
    ks = roc.distance(points).first().ks
    pdf = scored.toPandas()
    tpr = [(pdf[pdf.y == 1].score >= s).mean() for s in pdf.score.unique()]
    fpr = [(pdf[pdf.y == 0].score >= s).mean() for s in pdf.score.unique()]
    assert ks == pytest.approx(np.abs(np.array(tpr) - np.array(fpr)).max())


def test_final_scores(spark):
    rows = [("a", "l", "x", 10.0, 1), ("a", "l", "x", 20.0, None), ("a", "l", "y", 5.0, 0), (None, "l", "x", 1.0, 1)]
    df = spark.createDataFrame(
        rows, "employee_name STRING, sub_line_of_business__c STRING, incidentlevel2reason STRING, score DOUBLE, pred_score INT"
    )
    final = final_scores.final_score(df)
    assert {tuple(r) for r in final.collect()} == {("a", "l", "x", 15.0, 1), ("a", "l", "y", 5.0, 1)}
    assert [tuple(r) for r in final_scores.pivoted(final).collect()] == [("a", "l", 15.0, 5.0)]


def test_routing(spark):
    scores = spark.createDataFrame(
        [("i", "b", 9.0), ("i", "a", 9.0), ("i", "top", 10.0), ("i", "none", None), ("j", "off", 3.0), ("k", "none", None)],
        "issue_code STRING, ldap STRING, score DOUBLE",
    )
    here = spark.createDataFrame([("a",), ("b",), ("none",)], "ldap STRING")
    requests = spark.createDataFrame([("i",), ("i",), ("j",), ("k",), ("new",)], "issue_code STRING")
    found = {r.issue_code: r.ldap for r in routing.route(requests, scores, here).collect()}
    assert found == {"i": "a", "j": "Not Found", "k": "none", "new": "Not Found"}
    assert routing.route(requests, scores, here).count() == 4
    assert [r.ldap for r in routing.route_one("i", scores, here).collect()] == ["a"]
    assert [r.ldap for r in routing.route_one("j", scores, here).collect()] == ["Not Found"]


def test_hot_cases_change_nothing(spark, tmp_path, monkeypatch):
    """A third of the rows on one case and one agent, in equal copies, against plain joins."""
    from callboard.operators import skew
    from callboard.plans import performance
    from callboard.schemas import HEALTH

    at = "2021-04-22 10:00:00"
    one = CASE | {"interaction_starttime": at, "vendorid": "v", "incidentlevel2reason": "x", "wait_time": 1.0, "csatscore": "4"}
    rows = [one | {"case_key": "hot", "latest_employee_key": "H||S||1"}] * 300
    rows += [one | {"case_key": f"c{i % 400}", "latest_employee_key": f"E{i % 40}||S||1"} for i in range(600)]
    people = [{"employee_key": f"E{i}||S||1", "employee_name": f"n{i}"} for i in range(40)]
    people.append({"employee_key": "H||S||1", "employee_name": "hot"})
    keys = [f"c{i}" for i in range(400)] + ["hot"]
    parts = {
        "call_chat": frame(spark, CALL_CHAT, rows),
        "employees": frame(spark, EMPLOYEES, people),
        "closed_cases": frame(spark, CLOSED_CASES, [{"transaction_no": k, "resolution_days": 1.0} for k in keys]),
        "productivity": frame(
            spark,
            PRODUCTIVITY,
            [
                {"employee_key": p["employee_key"], "cal_date": at, "login_time": 360000, "billable_hour": 360000}
                for p in people
            ],
        ),
        "health": frame(
            spark, HEALTH, [{"case_key": k, "pred_score": i % 2, "model_prob": 0.8, "chs": 1} for i, k in enumerate(keys)]
        ),
    }
    for name, df in parts.items():
        df.write.parquet(f"{tmp_path}/{name}")
    tables = performance.read_tables(spark, **{name: f"{tmp_path}/{name}" for name in parts})
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    filters = performance.cases_with_health(tables)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(sales_support_flag,Support)" in filters and "EqualTo(language_key,13)" in filters
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (50,))
    found = performance.all_cases(tables).toPandas()
    assert len(found) == 900
    assert "_row" not in found.columns
    counts = found.groupby("employee_name").counting.agg(["first", "nunique", "size"])
    assert (counts["nunique"] == 1).all() and (counts["first"] == counts["size"]).all()
    assert counts.loc["hot", "first"] == 300
    older = performance.all_cases_older(tables).toPandas()
    assert len(older) == 900 and set(older.chs) == {1}


def test_exports(spark, modelled, tmp_path):
    from callboard.sources import tables

    _, model = modelled
    tables.write_csv(model.table, f"{tmp_path}/csv")
    tables.write_parquet(model.table, f"{tmp_path}/parquet")
    tables.write_json(model.table, f"{tmp_path}/json")
    expected = sorted((r.variable, r.bin, r.points) for r in model.table.collect())
    for reader in (
        spark.read.option("header", True).schema(model.table.schema).csv(f"{tmp_path}/csv"),
        tables.read_table(spark, f"{tmp_path}/parquet"),
        spark.read.schema(model.table.schema).json(f"{tmp_path}/json"),
    ):
        assert sorted((r.variable, r.bin, r.points) for r in reader.collect()) == expected
    model.table.createOrReplaceTempView("model_summary")
    cut = tables.read_table(spark, "model_summary", "variable STRING, n DOUBLE")
    assert cut.dtypes == [("variable", "string"), ("n", "double")]
