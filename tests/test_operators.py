"""Operators against brute force, with skewed and missing keys."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.stat import ChiSquareTest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from callboard.operators import describe, hypothesis, ordering, skew, upsert


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, among them many equal rows."""
    rng = random.Random(7)
    rows = [("hot", rng.randrange(50)) for _ in range(2000)]
    rows += [(f"k{rng.randrange(500)}", rng.randrange(50)) for _ in range(4000)]
    rows += [(None, 1)] * 20
    return spark.createDataFrame(rows, "k STRING, v INT").repartition(6)


def test_hot_keys_finds_the_hot_one(spark, skewed):
    wanted = spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert skew.hot_keys(skewed, [["k"], ["k", "v"]], rows_per_task=300) == [{wanted: 7}, {}]
    assert skew.hot_keys(skewed.limit(0), [["k"]], rows_per_task=300) == [{}]


def test_a_key_of_half_a_percent_is_hot_if_it_fills_tasks(spark):
    rows = spark.range(400_000).select(F.when(F.col("id") % 200 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    (found,) = skew.hot_keys(rows, [["k"]], rows_per_task=1_200)
    assert list(found.values()) == [2]
    # The tasks follow the rows of the key: ten times the rows, ten times the tasks, give or take the sample.
    (found,) = skew.hot_keys(rows.select(F.explode(F.array(*["k"] * 10)).alias("k")), [["k"]], rows_per_task=1_200)
    assert 15 <= max(found.values()) <= 19


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_returns_what_a_join_does(spark, skewed, how):
    small = spark.createDataFrame(
        [("hot", "a"), ("hot", "b")] + [(f"k{i}", str(i)) for i in range(0, 500, 2)] + [(None, "z")], "k STRING, w STRING"
    )
    plain = skewed.join(small, ["k"], how).collect()
    (hot,) = skew.hot_keys(skewed, [["k"]], rows_per_task=100)
    spread = skew.spread_join(skewed, small, ["k"], how, hot=hot).collect()
    assert max(hot.values()) == 20
    assert Counter(map(tuple, spread)) == Counter(map(tuple, plain))


def test_spread_join_divides_the_hot_key(spark, skewed):
    numbered = skewed.withColumn("id", F.monotonically_increasing_id())
    small = spark.createDataFrame([("hot", 1)], "k STRING, w INT")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = skew.spread_join(numbered, small, ["k"], hot=skew.hot_keys(numbered, [["k"]], rows_per_task=100)[0])
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1
    assert max(r["count"] for r in sizes) < 0.8 * sum(r["count"] for r in sizes)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("pieces", [2, 7, 64])
def test_running_totals(spark, descending, pieces):
    rng = random.Random(3)
    rows = [(x, rng.randrange(100)) for x in {round(rng.expovariate(0.1), 2) for _ in range(3000)} | {-5.0, 0.0}]
    df = spark.createDataFrame(rows, "x DOUBLE, n LONG").repartition(5)
    found = {r.x: r.n_running for r in ordering.running_totals(df, "x", ["n"], descending, pieces).collect()}
    total, expected = 0, {}
    for x, n in sorted(rows, reverse=descending):
        total += n
        expected[x] = total
    assert found == expected


def test_running_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "x DOUBLE, n LONG")
    assert ordering.running_totals(empty, "x", ["n"]).collect() == []


def brute_cuts(values, parts):
    """Value at rank floor(k n / parts) + 1."""
    values = sorted(values)
    return sorted({values[k * len(values) // parts] for k in range(1, parts)}) if values else []


@pytest.mark.parametrize(("accuracy", "sorted_values"), [(100, 250_000), (10_000, 250_000), (100, 3), (10_000, 1)])
def test_rank_cuts(spark, accuracy, sorted_values):
    rng = random.Random(11)
    rows = []
    for _ in range(5000):
        rows.append(
            (
                rng.gauss(0, 1),
                float(rng.choice([1, 1, 1, 2, 3, 9])),
                None if rng.random() < 0.5 else rng.expovariate(1),
                float("nan") if rng.random() < 0.3 else 1e9 + rng.random(),
                4.0,
                None,
            )
        )
    names = ["gauss", "few", "gaps", "nans", "same", "none"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} DOUBLE" for n in names)).repartition(4)
    found = ordering.rank_cuts(df, names, 20, accuracy=accuracy, sorted_values=sorted_values)
    for i, name in enumerate(names):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        assert found[name] == brute_cuts(values, 20), name


def test_rank_cuts_with_weights(spark):
    rng = random.Random(5)
    rows = [(rng.random(), rng.randrange(1, 40)) for _ in range(300)]
    found = ordering.rank_cuts(spark.createDataFrame(rows, "x DOUBLE, w LONG"), ["x"], 20, weight="w")
    assert found["x"] == brute_cuts([x for x, w in rows for _ in range(w)], 20)


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (0.02,), (0.999,), (1.0,), (None,), (float("nan"),)], "x DOUBLE")
    rows = describe.histograms(df, "x", {"all": F.lit(True), "none": F.lit(False)}).collect()
    assert len(rows) == 50
    assert {r.bin: r["count"] for r in rows if r["count"]} == {1: 1, 2: 1, 50: 2}


def test_histogram_agrees_with_numpy_and_handles_one_value(spark):
    rng = random.Random(1)
    values = [rng.gauss(5, 2) for _ in range(2000)]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)] + [(7.0, 3)], "x DOUBLE, g INT")
    rows = describe.histograms(df, "x", {"zero": F.col("g") == 0, "single": F.col("g") == 3}).collect()
    counts, edges = np.histogram(values[::2], bins=50)
    found = sorted((r for r in rows if r.population == "zero"), key=lambda r: r.bin)
    assert [r["count"] for r in found] == counts.tolist()
    assert [r.lower for r in found] == pytest.approx(edges[:-1].tolist())
    single = [r for r in rows if r.population == "single" and r["count"]]
    assert [(r["count"], r.lower <= 7.0 <= r.upper) for r in single] == [(1, True)]


def test_groups_with_missing_keys_are_left_out(spark):
    rows = [("a", "x", "1"), ("a", "x", None), (None, "x", "2"), ("a", None, "3")]
    df = spark.createDataFrame(rows, "e STRING, i STRING, c STRING")
    assert [tuple(r) for r in describe.count_by(df, ["e", "i"], "c", "n").collect()] == [("a", "x", 1)]


def test_t_test(spark):
    rows = [(0, 1.0), (0, 2.0), (0, 3.0), (1, 2.0), (1, 4.0), (1, 6.0), (1, None), (1, float("nan")), (None, 9.0)]
    r = hypothesis.t_test(spark.createDataFrame(rows, "g INT, x DOUBLE"), "g", ["x"]).first()
    assert r.statistic == pytest.approx(-1.5492, abs=1e-4)
    assert r.df == 4
    assert r.p_value == pytest.approx(0.1963, abs=1e-3)


def test_t_test_without_spread_or_values(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, 1.0, 2.0), (0, 1.0, None)], "g INT, x DOUBLE, y DOUBLE")
    rows = {r.attribute: r for r in hypothesis.t_test(df, "g", ["x", "y"]).collect()}
    assert rows["x"].statistic is None and rows["x"].p_value is None
    assert rows["y"].statistic is None and rows["y"].p_value is None


def table_rows(spark, table):
    rows = [(g, v) for g, line in enumerate(table) for v, n in enumerate(line) for _ in range(n)]
    return spark.createDataFrame(rows, "g INT, v INT")


def test_chi_square_two_by_two(spark):
    df = table_rows(spark, [[10, 20], [30, 40]])
    assert hypothesis.chi_square(df, "g", ["v"]).first().statistic == pytest.approx(0.4464, abs=1e-4)
    plain = hypothesis.chi_square(df, "g", ["v"], correction=False).first()
    assert (plain.statistic, plain.df) == (pytest.approx(0.7937, abs=1e-4), 1.0)


def test_chi_square_agrees_with_spark_ml(spark):
    df = table_rows(spark, [[10, 0, 7, 3], [4, 9, 12, 1]])
    ours = hypothesis.chi_square(df, "g", ["v"]).first()
    vectors = VectorAssembler(inputCols=["v"], outputCol="f").transform(df)
    theirs = ChiSquareTest.test(vectors, "f", "g").first()
    assert ours.statistic == pytest.approx(theirs.statistics[0])
    assert ours.df == theirs.degreesOfFreedom[0]
    assert ours.p_value == pytest.approx(theirs.pValues[0], rel=1e-9)


def test_chi_square_with_one_label(spark):
    r = hypothesis.chi_square(table_rows(spark, [[3, 4]]), "g", ["v"]).first()
    assert (r.statistic, r.df, r.p_value) == (0.0, 0.0, 1.0)


def test_upsert(spark):
    current = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("b", 2, 3.0)], "k STRING, i INT, v DOUBLE")
    rng = random.Random(2)
    writes = [("b", 1, float(n), n) for n in range(50)] + [("c", 9, None, 1)]
    rng.shuffle(writes)
    changes = spark.createDataFrame(writes, "k STRING, i INT, v DOUBLE, n INT")
    once = upsert.upsert(current, changes, ["k", "i"], ["n"])
    expected = {("a", 1, 1.0), ("b", 1, 49.0), ("b", 2, 3.0), ("c", 9, None)}
    assert {tuple(r) for r in once.collect()} == expected
    twice = upsert.upsert(once, changes, ["k", "i"], ["n"])
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_upsert_reads_each_side_once(spark, tmp_path):
    for name in ("current", "changes"):
        spark.createDataFrame([("a", 1.0)], "k STRING, v DOUBLE").write.parquet(f"{tmp_path}/{name}")
    current, changes = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("current", "changes"))
    plan = upsert.upsert(current, changes, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 2 and "Join" not in plan


def test_means_by_label(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (0, None), (1, float("nan")), (None, 5.0)], "g INT, x DOUBLE")
    assert {r.g: r.x for r in describe.means_by_label(df, "g", ["x"]).collect()} == {0: 2.0, 1: None}


def test_frequencies_are_ordered(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "x STRING")
    assert [tuple(r) for r in describe.frequencies(df, "x").collect()] == [("b", 2), ("a", 1), ("c", 1)]


def test_columns_by_kind(spark):
    df = spark.createDataFrame([], "a STRING, b INT, c DOUBLE, d BOOLEAN, e DATE")
    assert describe.columns_by_kind(df) == (["a", "d"], ["b", "c"])


def test_crosstab_fills_empty_cells(spark):
    df = spark.createDataFrame([(0, "x"), (1, "y"), (1, "y"), (None, "x")], "g INT, v STRING")
    rows = {r.g: (r.x, r.y) for r in describe.crosstab(df, "g", "v").collect()}
    assert rows == {0: (1, 0), 1: (0, 2)}
    long = defaultdict(int, {(r.g, r.v): r["count"] for r in describe.cells(df, "g", "v").collect()})
    assert long == {(0, "x"): 1, (1, "y"): 2}
