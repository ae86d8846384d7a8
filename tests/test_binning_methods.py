"""Optimal bins, tree pre-bins, cross-fitted categories, Newton steps, coded categories."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callboard.operators import newton
from callboard.plans import binning, scorecard


def rows(rng, m, most=40):
    out, edge = [], -math.inf
    for i in range(m):
        n = rng.randint(1, most)
        out.append([edge, float(i), n, rng.randint(0, n)])
        edge = float(i)
    return out


def goes(rates, trend):
    if trend is None:
        return True
    steps = [b > a for a, b in zip(rates, rates[1:])]
    if any(a == b for a, b in zip(rates, rates[1:])):
        return False
    turns = [k for k, _ in itertools.groupby(steps)]
    return any(turns == list(shape) or turns == list(shape[:1]) or (not turns or turns == list(shape[1:])) for shape in binning.SHAPES[trend])


def enumerated(bins, smallest, trend):
    total, events = sum(b[2] for b in bins), sum(b[3] for b in bins)
    best = None
    for cuts in itertools.product([False, True], repeat=len(bins) - 1):
        edges = [0, *(i for i, cut in enumerate(cuts, 1) if cut), len(bins)]
        parts = [(sum(b[2] for b in bins[i:j]), sum(b[3] for b in bins[i:j])) for i, j in zip(edges, edges[1:])]
        if any(n < smallest * total or not 0 < e < n for n, e in parts):
            continue
        if not goes([e / n for n, e in parts], trend):
            continue
        value = sum(((n - e) / (total - events) - e / events) * math.log(((n - e) / (total - events)) / (e / events)) for n, e in parts)
        best = value if best is None else max(best, value)
    return best


@pytest.mark.parametrize("trend", [None, "ascending", "descending", "auto", "peak", "valley", "turning"])
def test_optimal_bins_against_all_ways_to_join(trend):
    rng = random.Random(len(str(trend)))
    for _ in range(40):
        bins = rows(rng, rng.randint(1, 9))
        smallest = rng.choice([0.0, 0.05, 0.2])
        found = binning.optimal_bins(bins, smallest, trend)
        best = enumerated(bins, smallest, trend)
        assert [b[0] for b in found][0] == -math.inf and found[-1][1] == bins[-1][1]
        assert sum(b[2] for b in found) == sum(b[2] for b in bins)
        assert [b[1] for b in found[:-1]] == [b[0] for b in found[1:]]
        if best is None:
            assert len(found) == 1
        else:
            assert binning._information(found) == pytest.approx(best)
            assert goes([e / n for _, _, n, e in found], trend)


def test_optimal_is_never_worse_than_pooled():
    rng = random.Random(8)
    better = 0
    for _ in range(60):
        bins = rows(rng, 20, most=200)
        pooled = binning._information(binning.joined_bins(bins, 0.05, "auto"))
        best = binning._information(binning.optimal_bins(bins, 0.05, "auto"))
        assert best >= pooled - 1e-12
        better += best > pooled + 1e-9
    assert better > 10


def test_optimal_of_nothing_and_of_one_class():
    assert binning.optimal_bins([], 0.05, "auto") == []
    assert binning.optimal_bins([[-1.0, 0.0, 4, 0], [0.0, 1.0, 3, 0]], 0.05, "auto") == [[-1.0, 1.0, 7, 0]]


def test_tree_finds_the_places_where_the_rate_jumps():
    rng = random.Random(2)
    bins, edge = [], -math.inf
    for i in range(200):
        rate = 0.1 if i < 60 else 0.7 if i < 130 else 0.3
        n = 100
        bins.append([edge, float(i + 1), n, sum(rng.random() < rate for _ in range(n))])
        edge = float(i + 1)
    leaves = binning.tree_bins(bins, 0.05)
    assert {60.0, 130.0} <= {b[1] for b in leaves}
    assert len(leaves) <= 16 and all(b[2] >= 0.05 * 20_000 for b in leaves) and sum(b[2] for b in leaves) == 20_000
    assert [b[1] for b in leaves[:-1]] == [b[0] for b in leaves[1:]]
    assert binning.tree_bins([], 0.05) == [] and binning.tree_bins(bins[:1], 0.05) == bins[:1]
    same = [[float(i), float(i + 1), 10, 5] for i in range(20)]
    assert binning.tree_bins(same, 0.05) == [[0.0, 20.0, 200, 100]]


def test_tree_cuts_in_spark_do_not_take_more_jobs_with_more_variables(spark):
    df = spark.range(4_000).select(
        (F.col("id") % 1000).cast("double").alias("x"), F.rand(3).alias("z"),
        (F.rand(4) < F.when(F.col("id") % 1000 < 300, 0.2).otherwise(0.8)).cast("int").alias("y"),
    ).cache()
    tracker = spark.sparkContext.statusTracker()

    def jobs(columns):
        group = "-".join(columns)
        spark.sparkContext.setJobGroup(group, group)
        found = binning.fit_binning(df, columns, [], "y", prebins="tree", method="optimal")
        spark.sparkContext.setJobGroup("rest", "rest")
        return len(tracker.getJobIdsForGroup(group)), found

    one, found = jobs(["x"])
    two, _ = jobs(["x", "z"])
    assert two <= one + 1
    cuts = [r.upper for r in found.table.collect() if r.variable == "x" and r.bin >= 0]
    assert any(abs(c - 300) <= 5 for c in cuts)


def noise(spark, n, per_category, seed=0):
    return spark.range(n).select(
        F.col("id").cast("string").alias("k"),
        F.concat(F.lit("c"), (F.col("id") % (n // per_category)).cast("string")).alias("c"),
        (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) < 400).cast("int").alias("y"),
    )


def value(found):
    return {r["variable"]: r["iv"] for r in binning.information_values(found.table).collect()}


def test_noise_in_small_categories_is_not_informative_when_cross_fitted(spark):
    df = noise(spark, 9_000, 3)
    assert value(binning.fit_binning(df, [], ["c"], "y"))["c"] > 0.5
    assert value(binning.fit_binning(df, [], ["c"], "y", folds=5, key="k"))["c"] < 0.02


def test_cross_fitted_rates_against_plain_loops(spark):
    rng = random.Random(4)
    data = [(f"k{i}", rng.choice(["a", "b", "b", "b", "rare" if i % 97 == 0 else "a", None]), rng.randint(0, 1)) for i in range(600)]
    df = spark.createDataFrame(data, "k STRING, c STRING, y INT")
    folded = df.withColumn("f", binning.fold_of("k", 4))
    plain = [(r.c, r.f, r.y) for r in folded.collect()]
    counted = binning.category_counts(df, ["c"], "y", binning.fold_of("k", 4).alias("fold"))
    fitting, scoring, unseen = binning.cross_fitted(counted, 10.0)
    known = [(c, f, y) for c, f, y in plain if c is not None]
    mean = sum(y for *_, y in known) / len(known)
    assert unseen == {"c": pytest.approx(mean)}
    for r in fitting.collect():
        others = [y for c, f, y in known if f != r.fold]
        own = [y for c, f, y in known if f != r.fold and c == r.category]
        assert r.rate == pytest.approx((sum(own) + 10 * sum(others) / len(others)) / (len(own) + 10))
        assert r.n == sum(c == r.category and f == r.fold for c, f, _ in known)
    for r in scoring.collect():
        own = [y for c, _, y in known if c == r.category]
        assert (r.n, r.events) == (len(own), sum(own)) and r.rate == pytest.approx((sum(own) + 10 * mean) / (len(own) + 10))


def informative_rows(spark, n=6_000):
    rng = random.Random(1)
    data = []
    for i in range(n):
        c = rng.choice("abcdefgh")
        x = rng.random()
        y = int(rng.random() < 0.2 + 0.5 * ("abcdefgh".index(c) / 7) * x + 0.1 * x)
        data.append((f"k{i}", x if i % 11 else None, c if i % 13 else None, f"n{i % 2_000}", y))
    return spark.createDataFrame(data, "k STRING, x DOUBLE, c STRING, noise STRING, y INT").repartition(4)


def test_a_cross_fitted_scorecard_holds_on_other_rows(spark):
    df = informative_rows(spark)
    test = scorecard.is_test("k")
    own, folded = (
        scorecard.fit(df, ["x"], ["c", "noise"], "y", where=~test, **options) for options in ({}, {"folds": 5, "key": "k"})
    )

    def auc(model, where):
        pdf = model.score(df).where(where).select("score", "y").toPandas()
        order = pdf.score.rank()
        good = pdf.y == 1
        return (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())

    assert auc(own, test) < auc(own, ~test) - 0.1
    assert auc(folded, test) > auc(own, test) + 0.03
    # An unseen category has the overall rate's bin, a missing one that of missing values.
    probe = spark.createDataFrame([("p", 0.5, "zzz", "n1"), ("q", 0.5, None, "n1")], "k STRING, x DOUBLE, c STRING, noise STRING")
    points = {r.k: r.c_points for r in folded.with_bins(probe, "points", "_points").collect()}
    absent = folded.table.where("variable = 'c' AND bin = -1").first().points
    assert points["q"] == absent and points["p"] in [r.points for r in folded.table.where("variable = 'c' AND bin >= 0").collect()]


def test_scores_of_coded_rows_join_no_categories(spark):
    df = informative_rows(spark, 2_000)
    model = scorecard.fit(df, ["x"], ["c", "noise"], "y", where=~scorecard.is_test("k"))
    scored = model.score(model.coded)
    assert "Join" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.columns == [*df.columns, "score"]
    plain = {r.k: r.score for r in model.score(df).collect()}
    assert {r.k: r.score for r in scored.collect()} == plain and len(plain) == 2_000


def test_a_stored_scorecard_keeps_its_codes(spark, tmp_path):
    df = informative_rows(spark, 2_000)
    for options in ({}, {"folds": 3, "key": "k"}, {"rare": 0.01}):
        model = scorecard.fit(df, ["x"], ["c", "noise"], "y", **options)
        model.write(str(tmp_path / "-".join(options)) + "-m")
        again = scorecard.Scorecard.read(spark, str(tmp_path / "-".join(options)) + "-m")
        strange = df.limit(50).withColumn("noise", F.lit("never seen"))
        for rows_ in (df, strange):
            assert sorted(map(tuple, again.score(rows_).select("k", "score").collect())) == sorted(
                map(tuple, model.score(rows_).select("k", "score").collect())
            )


# Newton steps.


def plain_newton(x, y, penalty):
    x = np.column_stack([np.ones(len(x)), x])
    held = np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve((x.T * (p * (1 - p))) @ x + held, x.T @ (p - y) + held @ b)
    return b


def frame(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    data = [(int(b), *map(float, a)) for a, b in zip(x, y)]
    return spark.createDataFrame(data, "y INT, " + ", ".join(f"{n} DOUBLE" for n in names)).repartition(3), names


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_newton_against_plain_newton(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(1_500, 6)) * [1, 0.1, 3, 1, 1, 0]
    y = rng.random(1_500) < 1 / (1 + np.exp(-(x @ [1, -4, 0.5, 0, 2, 1] - 2)))
    df, names = frame(spark, x, y)
    b, passes = newton.fit(df, "y", names, 0.2, 25)
    assert b == pytest.approx(plain_newton(x, y, 0.2), abs=1e-10) and passes <= 10


def test_newton_where_a_full_step_goes_too_far(spark):
    # A large variable whose rows are nearly told apart by it.
    x = np.array([[-1000.0], [-900.0], [-2.0], [3.0], [800.0], [5000.0]] * 3)
    y = np.array([0, 0, 1, 0, 1, 1] * 3)
    df, names = frame(spark, x, y)
    b, _ = newton.fit(df, "y", names, 1e-6, 200)
    _, slope, _ = newton.sums_at(df, "y", names, b)
    assert np.abs(slope + np.array([0.0, 1e-6]) * b).max() < 1e-6


def test_newton_says_what_it_cannot_do(spark):
    df, names = frame(spark, np.ones((8, 1)), np.ones(8))
    with pytest.raises(ValueError, match="one label"):
        newton.fit(df, "y", names, 0.2, 25)
    with pytest.raises(ValueError, match="no rows"):
        newton.fit(df.where("y = 5"), "y", names, 0.2, 25)
    df, names = frame(spark, np.arange(8.0).reshape(-1, 1), np.array([0, 1, 0, 0, 1, 1, 0, 1]))
    with pytest.raises(ArithmeticError):
        newton.fit(df, "y", names, 0.2, 1)


def test_newton_steps_take_one_pass_each(spark):
    df, names = frame(spark, np.arange(40.0).reshape(-1, 2) / 10, np.array([0, 1] * 10))
    spark.sparkContext.setJobGroup("newton", "newton")
    _, passes = newton.fit(df, "y", names, 0.2, 25)
    spark.sparkContext.setJobGroup("rest", "rest")
    # Adaptive execution runs the frame's own shuffle, that of the sums, and the result as a job each.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("newton")) <= 3 * passes <= 21


def test_a_newton_step_adds_rows_up_without_multiplying_them(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(5000, 3)), rng.integers(0, 2, 5000).astype(float)
    df = spark.createDataFrame(np.column_stack([y, x]).tolist(), "y DOUBLE, a DOUBLE, b DOUBLE, c DOUBLE").repartition(5)
    monkeypatch.setattr(newton.F, "posexplode", None)
    b = np.array([0.3, -1.0, 0.5, 800.0])
    loss, slope, products = newton.sums_at(df, "y", ["a", "b", "c"], b)
    every = np.column_stack([np.ones(len(y)), x])
    z = every @ b
    with np.errstate(over="ignore"):
        p = 1 / (1 + np.exp(-z))
    assert loss == pytest.approx((np.logaddexp(0, z) - y * z).sum(), rel=1e-12)
    assert slope == pytest.approx((p - y) @ every, rel=1e-9, abs=1e-9)
    assert products == pytest.approx((every * (p * (1 - p))[:, None]).T @ every, rel=1e-9, abs=1e-9)
    with pytest.raises(ValueError, match="no rows"):
        newton.sums_at(df.limit(0), "y", ["a", "b", "c"], b)
