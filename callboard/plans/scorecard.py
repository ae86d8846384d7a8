"""Binned logistic scorecard: fit, points per bin, scores."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import real
from ..operators import newton
from ..session import materialize
from .binning import CODE, MISSING, Binning, evidence, fit_binning, informative, information_values

# Fixed values of the model.
INVERSE_REGULARISATION = 5.0
MOST_ITERATIONS = 5000
LOWEST, HIGHEST = 0.0, 100.0
TEST_PARTS, ALL_PARTS = 1, 5

MODEL_SCHEMA = (
    "numeric ARRAY<STRING>, categorical ARRAY<STRING>, others MAP<STRING, DOUBLE>, variables ARRAY<STRING>, "
    "intercept DOUBLE, coefficients MAP<STRING, DOUBLE>, lowest DOUBLE, highest DOUBLE, passes INT, "
    "cuts MAP<STRING, ARRAY<DOUBLE>>"
)


def is_test(key: Column | str) -> Column:
    """True for the fifth of the cases that is kept for testing.

    Decided by a hash of the case key alone, so a case falls on the same side however
    the rows are partitioned and whenever a task is run again.
    """
    key = F.col(key) if isinstance(key, str) else key
    number = F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("int")
    return F.pmod(number, F.lit(ALL_PARTS)) < TEST_PARTS


def split(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows."""
    return df.where(~is_test(key)), df.where(is_test(key))


def _by_bin(value: Column, bins: list, what: str, otherwise: float) -> Column:
    """CASE over the upper edges of a variable's bins."""
    result = None
    for b in bins[:-1]:
        result = (F if result is None else result).when(value < b["upper"], F.lit(b[what]))
    last = F.lit(bins[-1][what])
    inside = last if result is None else result.otherwise(last)
    return F.when(value.isNull(), F.lit(otherwise)).otherwise(inside)


@dataclass
class Scorecard:
    """``table`` is the detailed table, a few rows per variable; ``passes`` is what the fit took.

    ``coded`` has all rows that were given to the fit, with the codes of their categories, in the shared
    folder: scoring them looks no category up again.
    """

    binning: Binning
    variables: list[str]
    intercept: float
    coefficients: dict[str, float]
    table: DataFrame
    lowest: float
    highest: float
    passes: int = 0
    coded: DataFrame | None = None

    def with_bins(self, df: DataFrame, what: str, suffix: str) -> DataFrame:
        """Add ``<variable><suffix>`` with the ``what`` of the row's bin.

        Missing values and categories not seen in training get the value of the missing
        bin. The number of rows stays the same.
        """
        return _with_bins(df, self.binning, self.table.collect(), self.variables, what, suffix)

    def category_bins(self) -> DataFrame:
        """(variable, bin, category, n, events, woe, points): which categories are in which bin."""
        rows = self.table.collect()
        rates = self.binning.rates.where(F.col("variable").isin([v for v in self.variables if v in self.binning.categorical]))
        values = {}
        for what in ("bin", "woe", "points"):
            cases = None
            for v in self.binning.categorical:
                bins = sorted((r for r in rows if r["variable"] == v and r["bin"] >= 0), key=lambda r: r["bin"])
                if bins:
                    here = _by_bin(F.col("rate"), bins, what, 0.0)
                    cases = (F if cases is None else cases).when(F.col("variable") == v, here)
            values[what] = cases if cases is not None else F.lit(None)
        return rates.select(
            "variable", values["bin"].cast("int").alias("bin"), "category", "n", "events",
            values["woe"].cast("double").alias("woe"), values["points"].cast("double").alias("points"),
        )

    def write(self, path: str) -> None:
        """Store the scorecard, its category rates among it, in a folder of its own."""
        spark = self.table.sparkSession
        self.table.write.mode("overwrite").parquet(f"{path}/table")
        if self.binning.rates is not None:
            self.binning.rates.write.mode("overwrite").parquet(f"{path}/rates")
        one = (
            self.binning.numeric, self.binning.categorical, self.binning.others, self.variables, self.intercept,
            self.coefficients, self.lowest, self.highest, self.passes, self.binning.cuts,
        )
        spark.createDataFrame([one], MODEL_SCHEMA).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Scorecard:
        """A scorecard that was stored with :meth:`write`."""
        one = spark.read.schema(MODEL_SCHEMA).parquet(f"{path}/model").first()
        table = spark.read.parquet(f"{path}/table")
        rates = spark.read.parquet(f"{path}/rates") if one["categorical"] else None
        bins = table.select("variable", "bin", "lower", "upper", "n", "events")
        cuts = {v: list(found) for v, found in one["cuts"].items()}
        binning = Binning(list(one["numeric"]), list(one["categorical"]), bins, rates, one["others"], cuts)
        return Scorecard(
            binning, list(one["variables"]), one["intercept"], one["coefficients"], table,
            one["lowest"], one["highest"], one["passes"],
        )

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Add the score: the sum of the points of the row's bins. Codes that are there already are used and left out."""
        points = self.with_bins(df, "points", "_points")
        total = sum((F.col(f"{v}_points") for v in self.variables), F.lit(0.0))
        codes = {v + CODE for v in self.binning.categorical}
        return points.withColumn(name, total).select(*(c for c in df.columns if c not in codes), name)


def _with_bins(
    df: DataFrame, binning: Binning, rows: list, variables: Sequence[str], what: str, suffix: str, fitted: bool = False
) -> DataFrame:
    """Add what the bins of each row say: ranges of numbers, and of codes, which are added where they are not there yet."""
    df = df if binning.is_coded(df) and not fitted else binning.coded(df, fitted)
    added = {}
    for v in variables:
        bins = sorted((r for r in rows if r["variable"] == v and r["bin"] >= 0), key=lambda r: r["bin"])
        absent = next((r[what] for r in rows if r["variable"] == v and r["bin"] == MISSING), 0.0)
        if not bins:
            added[v + suffix] = F.lit(absent)
        elif v in binning.numeric:
            added[v + suffix] = _by_bin(real(v), bins, what, absent)
        else:
            cuts = binning.cuts[v]
            ranges = [{what: b[what], "upper": bisect_right(cuts, b["upper"])} for b in bins]
            added[v + suffix] = _by_bin(F.col(v + CODE), ranges, what, absent)
    return df.withColumns(added) if added else df


def fit(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str,
    inverse_regularisation: float = INVERSE_REGULARISATION,
    iterations: int = MOST_ITERATIONS,
    lowest: float = LOWEST,
    highest: float = HIGHEST,
    reverse: bool = True,
    select: tuple[float, float] | None = None,
    missing: str = "zero",
    where: Column | None = None,
    **binning_options,
) -> Scorecard:
    """Fit a scorecard on rows with a 0/1 label, or on those of them that meet ``where``.

    ``select`` keeps only variables whose information value lies between the two bounds.
    ``missing`` is ``zero`` (a missing value speaks neither way) or ``empirical`` (it has
    the weight of evidence of the missing rows seen in training). With ``reverse`` a
    better chance of label 1 gives a higher score.
    """
    train = df if where is None else df.where(where)
    binning = fit_binning(train, numeric, categorical, label, **binning_options)
    variables = [*binning.numeric, *binning.categorical]
    if select:
        kept = informative(information_values(binning.table), *select)
        variables = [r["variable"] for r in kept.collect()]
        if not variables:
            raise ValueError("no variable has an information value within the bounds")
    table = evidence(binning.table)
    # A few rows per variable.
    rows = [r.asDict() for r in table.where(F.col("variable").isin(variables)).collect()]
    for r in rows:
        r["used"] = 0.0 if r["bin"] == MISSING and missing == "zero" else r["woe"]
    coded = materialize(binning.coded(df), "coded") if categorical else df
    if binning.folded is None:
        train = coded if where is None else coded.where(where)
    intercept, weights, passes = _logistic(train, binning, rows, variables, label, inverse_regularisation, iterations)
    _add_points(rows, variables, intercept, weights, lowest, highest, reverse)
    for r in rows:
        r["coefficient"] = weights[r["variable"]]
    names = [
        "variable", "bin", "lower", "upper", "n", "share", "non_events", "events",
        "event_rate", "woe", "iv", "js", "coefficient", "points",
    ]
    schema = ", ".join(
        f"{c} {'STRING' if c == 'variable' else 'INT' if c == 'bin' else 'LONG' if c in ('n', 'events', 'non_events') else 'DOUBLE'}"
        for c in names
    )
    detailed = df.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)
    return Scorecard(binning, variables, intercept, weights, detailed, lowest, highest, passes, coded)


def _logistic(
    df: DataFrame, binning: Binning, rows: list, variables: list[str], label: str, c: float, iterations: int
) -> tuple[float, dict[str, float], int]:
    """Intercept and coefficients over the weights of evidence, and the passes that took.

    The weights of every row are written to the shared folder, which each pass reads.
    """
    binned = _with_bins(df.where(F.col(label).isNotNull()), binning, rows, variables, "used", "_woe", fitted=binning.folded is not None)
    names = [f"{v}_woe" for v in variables]
    data = materialize(binned.select(F.col(label).cast("double").alias("_label"), *names), "weights-of-evidence")
    found, passes = newton.fit(data, "_label", names, 1 / c, iterations)
    return float(found[0]), dict(zip(variables, found[1:].tolist())), passes


def _add_points(
    rows: list, variables: list[str], intercept: float, weights: dict, lowest: float, highest: float, reverse: bool
) -> None:
    """Give every bin its points, so that their sum runs from ``lowest`` to ``highest``."""
    # Weight of evidence 0 is always possible: a missing value or an unseen category.
    ends = {
        v: (
            min(0.0, *(weights[v] * r["used"] for r in rows if r["variable"] == v)),
            max(0.0, *(weights[v] * r["used"] for r in rows if r["variable"] == v)),
        )
        for v in variables
    }
    span = sum(hi - lo for lo, hi in ends.values())
    slope = (highest - lowest) / span if span > 0 else 0.0
    for r in rows:
        lo, hi = ends[r["variable"]]
        part = weights[r["variable"]] * r["used"]
        r["points"] = lowest / len(variables) + slope * (part - lo if reverse else hi - part)
    # Rows without a missing bin still need its points for scoring.
    have = {r["variable"] for r in rows if r["bin"] == MISSING}
    for v in variables:
        if v not in have:
            lo, hi = ends[v]
            rows.append(
                {
                    "variable": v, "bin": MISSING, "lower": None, "upper": None, "n": 0, "share": 0.0,
                    "non_events": 0, "events": 0, "event_rate": None, "woe": 0.0, "iv": 0.0, "js": 0.0, "used": 0.0,
                    "points": lowest / len(variables) + slope * (-lo if reverse else hi),
                }
            )

