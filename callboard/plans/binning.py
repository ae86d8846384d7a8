"""Bins, weight of evidence and information value of each variable.

Numeric variables are cut at exact quantiles, or by a small decision tree over a histogram of both
classes; a category takes the share of events among its rows as its value and is then cut the same
way. Neighbouring bins are joined until each is large enough, has rows of both classes, and the event
rate goes one way, or so that of all ways to join them the information value is the greatest.

A category's share of events can leave out the row's own fold of the cases (``folds``): rows then never
take part in their own value, and categories with few rows do not look informative by chance.
"""

from __future__ import annotations

import math
import sys
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import real
from ..operators.ordering import bucketed, rank_cuts
from ..session import materialize

PREBINS = 20
SMALLEST_BIN = 0.05
MISSING = -1
# Parts of the histogram that tree cuts are chosen from, and how often a part is cut in two.
HISTOGRAM_PARTS, TREE_DEPTH = 200, 4
# Rows' worth of the overall rate that a category's rate is mixed with when it comes from other folds.
SHRINK = 20.0
# What a category's code is called beside its column.
CODE = "_code"
# Shapes of the event rate over the bins: it rises (True) or falls, or one after the other.
SHAPES = {
    "ascending": [(True,)],
    "descending": [(False,)],
    "auto": [(True,), (False,)],
    "peak": [(True, False)],
    "valley": [(False, True)],
    "turning": [(True, False), (False, True)],
}
# Category that rare ones are put together in, and unseen ones where there is one.
OTHER = "Other"

BIN_SCHEMA = "variable STRING, bin INT, lower DOUBLE, upper DOUBLE, n LONG, events LONG"


def fold_of(key: Column | str, folds: int) -> Column:
    """Fold of a case, by a hash of its key that the split into training and test rows does not use."""
    key = F.col(key) if isinstance(key, str) else key
    number = F.conv(F.substring(F.md5(key.cast("string")), 5, 4), 16, 10).cast("int")
    return F.pmod(number, F.lit(folds))


def category_counts(df: DataFrame, columns: Sequence[str], label: str, *by: Column) -> DataFrame:
    """(variable, category, n, events) of all categorical variables in one pass, apart for each value of ``by``.

    Rows without a category are counted under a NULL one.
    """
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("category")) for c in columns]
    rows = df.select(label, *by, F.inline(F.array(*pairs)))
    keys = ["variable", "category", *rows.columns[1 : 1 + len(by)]]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("events"))


def category_rates(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(variable, category, n, events, rate) of all categorical variables in one pass."""
    return category_counts(df, columns, label).withColumn("rate", F.col("events") / F.col("n"))


def cross_fitted(counted: DataFrame, shrink: float = SHRINK) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Rates from counts by variable, category and fold: (for fitting, for scoring, of unseen categories).

    For fitting, a category has in each fold the rate that its rows have in all others; for scoring,
    that of all its rows. Either is mixed with ``shrink`` rows' worth of the variable's rate over the same
    folds, which is also the rate of unseen categories. Counts of a category meet in at most as many rows as
    there are folds; totals by variable and fold are few.
    """
    known = counted.where(F.col("category").isNotNull())
    totals: dict[str, list] = {}
    for r in known.groupBy("variable", "fold").agg(F.sum("n").alias("n"), F.sum("events").alias("events")).collect():
        totals.setdefault(r["variable"], []).append(r)
    everywhere = {v: sum(r["events"] for r in rows) / sum(r["n"] for r in rows) for v, rows in totals.items()}
    means = []
    for v, rows in totals.items():
        n, events = sum(r["n"] for r in rows), sum(r["events"] for r in rows)
        for r in rows:
            # One fold alone has no others.
            rest = n - r["n"]
            means.append((v, r["fold"], (events - r["events"]) / rest if rest else everywhere[v]))
    spark = counted.sparkSession
    outside = F.broadcast(spark.createDataFrame(means, "variable STRING, fold INT, _outside DOUBLE"))
    overall = F.broadcast(spark.createDataFrame(list(everywhere.items()), "variable STRING, _overall DOUBLE"))
    own = Window.partitionBy("variable", "category")
    n, events = F.sum("n").over(own) - F.col("n"), F.sum("events").over(own) - F.col("events")
    fitting = known.join(outside, ["variable", "fold"]).select(
        "variable", "category", "fold", "n", "events", ((events + shrink * F.col("_outside")) / (n + shrink)).alias("rate")
    )
    summed = known.groupBy("variable", "category").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    scoring = summed.join(overall, "variable").select(
        "variable", "category", "n", "events",
        ((F.col("events") + shrink * F.col("_overall")) / (F.col("n") + shrink)).alias("rate"),
    )
    return fitting, scoring, everywhere


def with_rare_folded(counted: DataFrame, rare: float) -> DataFrame:
    """Put categories with less than ``rare`` of their variable's rows together as ``OTHER``.

    A category with a few rows takes an event rate that is mostly chance; on pure noise that
    alone looks informative.
    """
    known = counted.where(F.col("category").isNotNull())
    # One row per variable.
    totals = known.groupBy("variable").agg(F.sum("n").alias("_total"))
    folded = F.when(F.col("n") < rare * F.col("_total"), OTHER).otherwise(F.col("category"))
    known = known.join(F.broadcast(totals), "variable").withColumn("category", folded)
    rows = known.select("variable", "category", "n", "events").unionByName(
        counted.where(F.col("category").isNull()).select("variable", "category", "n", "events")
    )
    summed = rows.groupBy("variable", "category").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    return summed.withColumn("rate", F.col("events") / F.col("n"))


def prebin_counts(df: DataFrame, cuts: dict[str, list[float]], label: str) -> DataFrame:
    """(variable, prebin, n, events) of numeric variables; prebin -1 holds missing values.

    Each row meets its bins inside the task; only the few sums are shuffled.
    """
    cut = bucketed(df, cuts, "_bin")
    pairs = [
        F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(f"{c}_bin"), F.lit(MISSING)).alias("prebin")) for c in cuts
    ]
    return (
        cut.select(label, F.inline(F.array(*pairs)))
        .groupBy("variable", "prebin")
        .agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("events"))
    )


def _one_way(bins: list[list], rising: bool) -> list[list]:
    """Pool neighbours until the event rate only rises (or only falls)."""
    pooled: list[list] = []
    for row in bins:
        pooled.append(list(row))
        while len(pooled) > 1:
            (_, _, n0, e0), (_, _, n1, e1) = pooled[-2], pooled[-1]
            # Rates compared as fractions of whole numbers.
            in_order = e0 * n1 < e1 * n0 if rising else e0 * n1 > e1 * n0
            if in_order:
                break
            last = pooled.pop()
            pooled[-1] = [pooled[-1][0], last[1], n0 + n1, e0 + e1]
    return pooled


def _information(bins: list[list]) -> float:
    total_events = sum(e for *_, e in bins)
    total_rest = sum(n - e for _, _, n, e in bins)
    value = 0.0
    for _, _, n, e in bins:
        if e > 0 and n > e and total_events and total_rest:
            p, q = (n - e) / total_rest, e / total_events
            value += (p - q) * math.log(p / q)
    return value


def joined_bins(bins: list[list], smallest: float, trend: str | None) -> list[list]:
    """[lower, upper, n, events] rows in order -> the joined ones. At most ``PREBINS`` rows."""
    total = sum(n for _, _, n, _ in bins)
    large: list[list] = []
    current = None
    for lower, upper, n, events in bins:
        current = [lower, upper, n, events] if current is None else [current[0], upper, current[2] + n, current[3] + events]
        if current[2] >= smallest * total and 0 < current[3] < current[2]:
            large.append(current)
            current = None
    if current is not None:
        if large:
            last = large[-1]
            large[-1] = [last[0], current[1], last[2] + current[2], last[3] + current[3]]
        else:
            large.append(current)
    if trend is None:
        return large
    ways = {"ascending": [True], "descending": [False], "auto": [True, False]}[trend]
    return max((_one_way(large, rising) for rising in ways), key=_information)


def optimal_bins(bins: list[list], smallest: float, trend: str | None) -> list[list]:
    """[lower, upper, n, events] rows in order -> those joined so that the information value is the greatest.

    Of all ways to join neighbours into bins that are large enough, have rows of both classes, and whose
    event rate goes as ``trend`` says (see ``SHAPES``; ``None``: any way). A dynamic programme over (first, last)
    row of the last bin, as the rate of the next is compared with that one alone: the cube of at most
    ``PREBINS`` steps. Where no way meets the conditions, one bin holds everything.
    """
    m = len(bins)
    if not m:
        return []
    upto_n, upto_e = [0], [0]
    for _, _, n, e in bins:
        upto_n.append(upto_n[-1] + n)
        upto_e.append(upto_e[-1] + e)
    total, events = upto_n[-1], upto_e[-1]
    spans: dict[tuple[int, int], tuple[int, int, float]] = {}
    for i in range(m):
        for j in range(i + 1, m + 1):
            n, e = upto_n[j] - upto_n[i], upto_e[j] - upto_e[i]
            if n >= smallest * total and 0 < e < n:
                p, q = (n - e) / (total - events), e / events
                spans[i, j] = n, e, (p - q) * math.log(p / q)

    def follows(left: tuple[int, int], right: tuple[int, int], rising: bool | None) -> bool:
        (n0, e0, _), (n1, e1, _) = spans[left], spans[right]
        return rising is None or (e0 * n1 < e1 * n0 if rising else e0 * n1 > e1 * n0)

    best: tuple[float, list[tuple[int, int]]] | None = None
    for shape in SHAPES[trend] if trend else [(None,)]:
        # The best way that ends with a bin, in each leg of the shape.
        ways: dict[tuple[int, tuple[int, int]], tuple[float, list[tuple[int, int]]]] = {}
        for span in sorted(spans, key=lambda s: s[1]):
            for leg, rising in enumerate(shape):
                before = [
                    ways[at, left]
                    for at in range(leg + 1)
                    for left in ((h, span[0]) for h in range(span[0]))
                    if (at, left) in ways and follows(left, span, rising)
                ]
                if span[0] and not before or leg and not span[0]:
                    continue
                value, path = max(before, key=lambda w: w[0]) if before else (0.0, [])
                ways[leg, span] = value + spans[span][2], [*path, span]
        whole = [way for (_, span), way in ways.items() if span[1] == m]
        best = max([*whole, *([best] if best else [])], key=lambda w: w[0], default=None)
    chosen = best[1] if best else [(0, m)]
    return [[bins[i][0], bins[j - 1][1], upto_n[j] - upto_n[i], upto_e[j] - upto_e[i]] for i, j in chosen]


def tree_bins(bins: list[list], smallest: float, depth: int = TREE_DEPTH) -> list[list]:
    """[lower, upper, n, events] rows of a histogram in order -> the leaves of a decision tree over them.

    Level by level, each leaf is cut where the impurity (events * others / rows) falls most, of equal falls
    at the lowest place, if both sides have at least ``smallest`` of all rows and it falls at all.
    """
    total = sum(n for _, _, n, _ in bins)
    leaves = [bins] if bins else []

    def impurity(n: int, e: int) -> float:
        return e * (n - e) / n

    for _ in range(depth):
        grown: list[list[list]] = []
        for leaf in leaves:
            n, e = sum(b[2] for b in leaf), sum(b[3] for b in leaf)
            best, place, n0, e0 = 0.0, 0, 0, 0
            for i, b in enumerate(leaf[:-1], 1):
                n0, e0 = n0 + b[2], e0 + b[3]
                if min(n0, n - n0) < smallest * total or not 0 < n0 < n:
                    continue
                fall = impurity(n, e) - (impurity(n0, e0) + impurity(n - n0, e - e0))
                if fall > best:
                    best, place = fall, i
            grown += [leaf[:place], leaf[place:]] if place else [leaf]
        leaves = grown
    return [[leaf[0][0], leaf[-1][1], sum(b[2] for b in leaf), sum(b[3] for b in leaf)] for leaf in leaves]


def merge_bins(
    prebins: DataFrame, smallest: float = SMALLEST_BIN, trend: str | None = "auto", join=joined_bins, tree: Sequence[str] = ()
) -> DataFrame:
    """(variable, bin, lower, upper, n, events) from pre-bins with their edges.

    A group is one variable's pre-bins, at most ``PREBINS`` + 1 rows, or those of a histogram for variables
    in ``tree``, whose pre-bins are the leaves of a tree. ``join`` is ``joined_bins`` or ``optimal_bins``.
    """
    tree = set(tree)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("prebin")
        known = rows[rows.prebin != MISSING]
        bins = [list(r) for r in known[["lower", "upper", "n", "events"]].itertuples(index=False)]
        if rows.variable.iloc[0] in tree:
            bins = tree_bins(bins, smallest)
        bins = join(bins, smallest, trend)
        out = [[i, *b] for i, b in enumerate(bins)]
        out += [[MISSING, None, None, r.n, r.events] for r in rows[rows.prebin == MISSING].itertuples()]
        result = pd.DataFrame(out, columns=["bin", "lower", "upper", "n", "events"])
        result.insert(0, "variable", rows.variable.iloc[0])
        # Joined bins meet: a pre-bin without rows leaves no gap.
        inner = result[result.bin >= 0]
        if len(inner):
            result.loc[inner.index[0], "lower"] = -math.inf
            result.loc[inner.index[-1], "upper"] = math.inf
            result.loc[inner.index[:-1], "upper"] = inner.lower.iloc[1:].values
        return result

    return prebins.groupBy("variable").applyInPandas(merge, BIN_SCHEMA)


def _edges(cuts: dict[str, list[float]], prebins: DataFrame) -> DataFrame:
    """Add the edges of each pre-bin; a bin holds lower <= value < upper."""
    rows = [
        (c, i, lo, hi)
        for c, inner in cuts.items()
        for i, (lo, hi) in enumerate(zip([-math.inf, *inner], [*inner, math.inf]))
    ]
    edges = prebins.sparkSession.createDataFrame(rows, "variable STRING, prebin INT, lower DOUBLE, upper DOUBLE")
    return prebins.join(F.broadcast(edges), ["variable", "prebin"], "left")


def evidence(bins: DataFrame) -> DataFrame:
    """Add share, event rate, weight of evidence, information value and Jensen-Shannon divergence.

    ``bins`` has a few rows per variable. A bin without events or without non-events
    has weight of evidence 0 and adds nothing.
    """
    every = Window.partitionBy("variable")
    n, events = F.col("n"), F.col("events")
    rest = n - events
    p = rest / F.sum(rest).over(every)
    q = events / F.sum(events).over(every)
    m = (p + q) / 2
    both = (rest > 0) & (events > 0)
    return bins.select(
        "*",
        (n / F.sum(n).over(every)).alias("share"),
        rest.alias("non_events"),
        (events / n).alias("event_rate"),
        F.when(both, F.ln(p / q)).otherwise(0.0).alias("woe"),
        F.when(both, (p - q) * F.ln(p / q)).otherwise(0.0).alias("iv"),
        F.when(both, (p * F.ln(p / m) + q * F.ln(q / m)) / 2).otherwise(0.0).alias("js"),
    )


def information_values(bins: DataFrame) -> DataFrame:
    """(variable, iv), the most informative variable first."""
    return evidence(bins).groupBy("variable").agg(F.sum("iv").alias("iv")).orderBy(F.desc("iv"), F.asc("variable"))


def informative(values: DataFrame, least: float = 0.005, most: float = 0.5) -> DataFrame:
    """Variables whose information value lies within the bounds, highest first."""
    return values.where(F.col("iv").between(least, most)).orderBy(F.desc("iv"), F.asc("variable"))


@dataclass
class Binning:
    """What ``fit_binning`` found.

    ``table`` has (variable, bin, lower, upper, n, events), a few rows per variable.
    ``rates`` has one row per category and lies in the shared folder; it may be large. A category's
    ``code`` is how many of its variable's ``cuts`` are at or below its rate, so bins are ranges of codes.
    ``others`` has the event rate of unseen categories, for each variable that has one.
    ``folded`` has codes by variable, category and fold, for the rows that were fitted, if rates come
    from other folds.
    """

    numeric: list[str]
    categorical: list[str]
    table: DataFrame
    rates: DataFrame | None = None
    others: dict[str, float] = field(default_factory=dict)
    cuts: dict[str, list[float]] = field(default_factory=dict)
    folded: DataFrame | None = None
    folds: int = 0
    key: str = ""

    def coded(self, df: DataFrame, fitted: bool = False) -> DataFrame:
        """``df`` with the code of every categorical variable beside it; NULL where it has no category or an unseen one.

        With ``fitted``, codes of the rows that were fitted, which leave out their own fold.
        """
        folded = fitted and self.folded is not None
        out = df.withColumn("_fold", fold_of(self.key, self.folds)) if folded else df
        for v in self.categorical:
            on = {"category": f"_{v}", "code": v + CODE} | ({"fold": "_fold"} if folded else {})
            of_variable = (self.folded if folded else self.rates).where(F.col("variable") == v)
            codes = of_variable.select(*(F.col(old).alias(new) for old, new in on.items()))
            # A plain join with a stored table: Spark broadcasts it if it is small, else it splits hot categories.
            keys = [f"_{v}", *(["_fold"] if folded else [])]
            out = out.withColumn(f"_{v}", F.col(v).cast("string")).join(codes, keys, "left")
            if v in self.others:
                unseen = F.when(F.col(f"_{v}").isNotNull(), F.lit(bisect_right(self.cuts[v], self.others[v])))
                out = out.withColumn(v + CODE, F.coalesce(F.col(v + CODE), unseen))
            out = out.drop(f"_{v}")
        return out.drop("_fold") if folded else out

    def is_coded(self, df: DataFrame) -> bool:
        return all(v + CODE in df.columns for v in self.categorical)


def _with_codes(rates: DataFrame, columns: Sequence[str], parts: int) -> tuple[DataFrame, dict[str, list[float]]]:
    """Add ``code`` to rates of categories, by cuts of about equal numbers of rows; and those cuts."""
    # One column per variable, so that the rates are cut as numeric variables are.
    wide = rates.select("*", *[F.when(F.col("variable") == c, F.col("rate")).alias(f"_{c}") for c in columns])
    names = [f"_{c}" for c in columns]
    cuts = rank_cuts(wide, names, parts, weight="n")
    code = F.coalesce(*[F.col(f"{c}_code") for c in names]).alias("code")
    coded = materialize(bucketed(wide, cuts, "_code").select(*rates.columns, code), "category-codes")
    return coded, {c.removeprefix("_"): sorted(found) for c, found in cuts.items()}


def fit_binning(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str,
    parts: int = PREBINS,
    smallest: float = SMALLEST_BIN,
    trend: str | None = "auto",
    rare: float = 0.0,
    method: str = "pooled",
    prebins: str = "quantile",
    folds: int = 0,
    key: str | None = None,
) -> Binning:
    """Bin all variables against a 0/1 label. ``df`` is read several times; keep it cheap to read.

    ``method`` is ``pooled`` (neighbours are pooled until the conditions hold) or ``optimal`` (the
    greatest information value; ``trend`` may then be any of ``SHAPES``). ``prebins`` of numeric variables
    are ``quantile`` or ``tree``. With ``rare`` above 0, categories with less than that share of the rows
    are one category, which unseen ones join when rows are scored. With ``folds`` of the cases (by their
    ``key``), a row's categories take their event rates from the other folds.
    """
    if folds and (rare or not key):
        raise ValueError("folds need the key of a case and leave no use for rare")
    numeric, categorical = list(numeric), list(categorical)
    tree = numeric if prebins == "tree" else []
    known = df.where(F.col(label).isNotNull())
    found: list[DataFrame] = []
    if numeric:
        values = known.select(label, *[real(c).alias(c) for c in numeric])
        cuts = rank_cuts(values, numeric, HISTOGRAM_PARTS if tree else parts)
        found.append(_edges(cuts, prebin_counts(values, cuts, label)))

    result = Binning(numeric, categorical, df)
    if categorical:
        if folds:
            fold = fold_of(key, folds).alias("fold")
            counted = materialize(category_counts(known, categorical, label, fold), "category-folds")
            rates, scoring, result.others = cross_fitted(counted)
            result.folds, result.key = folds, key
        else:
            counted = category_rates(known, categorical, label)
            counted = materialize(with_rare_folded(counted, rare) if rare else counted, "category-rates")
            rates = counted.where(F.col("category").isNotNull())
            if rare:
                result.others = {r["variable"]: r["rate"] for r in rates.where(F.col("category") == OTHER).collect()}
        coded, result.cuts = _with_codes(rates, categorical, parts)
        if folds:
            result.folded = coded
            cuts = {c: result.cuts[c] for c in categorical}
            wide = scoring.select("*", *[F.when(F.col("variable") == c, F.col("rate")).alias(f"_{c}") for c in categorical])
            code = F.coalesce(*[F.col(f"_{c}_code") for c in categorical]).alias("code")
            own = bucketed(wide, {f"_{c}": cuts[c] for c in categorical}, "_code").select(*scoring.columns, code)
            result.rates = materialize(own, "category-codes")
        else:
            result.rates = coded
        summed = [F.sum("n").alias("n"), F.sum("events").alias("events")]
        present = coded.groupBy("variable", F.col("code").alias("prebin")).agg(*summed)
        missing = counted.where(F.col("category").isNull()).groupBy("variable").agg(*summed)
        missing = missing.select("variable", F.lit(MISSING).alias("prebin"), "n", "events")
        found.append(_edges(result.cuts, present.unionByName(missing)))

    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    # A few rows per variable; kept as such, since every later step needs them.
    join = {"pooled": joined_bins, "optimal": optimal_bins}[method]
    rows = merge_bins(every, smallest, trend, join, tree).collect()
    result.table = df.sparkSession.createDataFrame(rows, BIN_SCHEMA)
    return result


# Workers get the merging functions by value, so nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
