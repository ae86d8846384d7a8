"""ROC curve, area under it, and the Kolmogorov-Smirnov distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import real
from ..operators.ordering import running_totals
from ..session import materialize


def curve(df: DataFrame, score: str, label: str, pieces: int | None = None) -> DataFrame:
    """One point per distinct score, from the highest down.

    (score, positives, negatives, tp, fp, tpr, fpr): rows with this score, and with this
    score or a higher one. Rows are counted per score first. The counts are written once,
    since the totals, the cut into pieces and the running sums each read them; the running
    sums are spread over many tasks.
    """
    rows = df.select(real(score).alias("score"), F.col(label).cast("long").alias("label")).dropna()
    counts = rows.groupBy("score").agg(
        F.sum("label").alias("positives"), F.sum(1 - F.col("label")).alias("negatives")
    )
    counts = materialize(counts, "score-counts")
    totals = counts.agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
    running = running_totals(counts, "score", ["positives", "negatives"], descending=True, pieces=pieces)
    return running.select(
        "score",
        "positives",
        "negatives",
        F.col("positives_running").alias("tp"),
        F.col("negatives_running").alias("fp"),
        F.try_divide(F.col("positives_running"), totals.select("p").scalar()).alias("tpr"),
        F.try_divide(F.col("negatives_running"), totals.select("n").scalar()).alias("fpr"),
    )


def area(points: DataFrame) -> DataFrame:
    """(auc, n_positive, n_negative) of a curve by the trapezoid rule.

    Counted in pairs: a score's negatives are beaten by all positives above them and by half
    of those beside them. As doubles, since the number of pairs outgrows a long.
    """
    above = F.col("tp").cast("double") - F.col("positives") / 2
    beaten = above * F.col("negatives")
    sums = points.agg(
        F.sum(beaten).alias("pairs"), F.sum("positives").alias("n_positive"), F.sum("negatives").alias("n_negative")
    )
    auc = F.try_divide(F.col("pairs"), F.col("n_positive").cast("double") * F.col("n_negative"))
    return sums.select(auc.alias("auc"), "n_positive", "n_negative")


def distance(points: DataFrame) -> DataFrame:
    """(ks, score): the greatest gap between the two rates, and the highest score that has it."""
    gap = F.abs(F.col("tpr") - F.col("fpr"))
    best = points.agg(F.max(F.struct(gap.alias("ks"), F.col("score"))).alias("best"))
    return best.select("best.ks", "best.score")
