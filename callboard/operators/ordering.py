"""Exact ranks and running totals over a whole table without sorting it in one task.

A window without a partition would send every row to a single task. Here the values are first
cut into ranges. Totals of ranges are few, so their running totals are cheap, and inside a range a
window works on a bounded number of rows. Where the cuts fall decides only how even the ranges
are; the results are exact for any of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import real
from ..session import materialize

# Rows, or different values, that a window sorts at a time.
ROWS_PER_PIECE = 250_000
# Parts that a bracket which is too wide is cut into.
FINER = 200


def splits(cuts: Sequence[float]) -> list[float]:
    """Strictly increasing edges around ``cuts``, open at both ends."""
    inner = sorted({float(c) for c in cuts if c is not None and math.isfinite(c)})
    return [-math.inf, *inner, math.inf]


def bucketed(df: DataFrame, cuts: dict[str, Sequence[float]], suffix: str) -> DataFrame:
    """Add ``<column><suffix>``: how many of the column's cuts are <= its value."""
    names = list(cuts)
    # A Bucketizer needs three edges; a column without cuts gets a constant instead.
    cut = [c for c in names if len(splits(cuts[c])) > 2]
    out = df
    if cut:
        out = Bucketizer(
            splitsArray=[splits(cuts[c]) for c in cut],
            inputCols=cut,
            outputCols=[c + suffix for c in cut],
            handleInvalid="keep",
        ).transform(df)
    columns = {c + suffix: F.when(F.col(c).isNotNull(), F.col(c + suffix).cast("int")) for c in cut}
    columns |= {c + suffix: F.when(F.col(c).isNotNull(), 0) for c in names if c not in cut}
    return out.withColumns(columns)


def running_totals(
    df: DataFrame,
    order: str,
    totals: Sequence[str],
    descending: bool = False,
    pieces: int | None = None,
) -> DataFrame:
    """Add ``<column>_running`` for each of ``totals``: its sum up to this row by ``order``.

    ``order`` is a double without NULL and with one row per value, as it comes out of
    a ``groupBy(order)``. Spark deals the rows into ranges of ``order``, as many as their
    number asks for; the ranges are written once, with their number beside each row.
    """
    if pieces is None:
        pieces = max(1, math.ceil(df.count() / ROWS_PER_PIECE))
    dealt = df.repartitionByRange(pieces, order).withColumn("_piece", F.spark_partition_id())
    cut, piece = materialize(dealt, "ranges"), "_piece"
    direction = F.desc if descending else F.asc

    # One row per range, so one task and a broadcast are enough for them.
    sums = cut.groupBy(piece).agg(*[F.sum(c).alias(c) for c in totals])
    before = Window.orderBy(direction(piece)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(piece, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in totals])

    inside = (
        Window.partitionBy(piece).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.join(F.broadcast(offsets), piece)
        .withColumns({f"{c}_running": F.col(f"_{c}") + F.sum(c).over(inside) for c in totals})
        .drop(piece, *[f"_{c}" for c in totals])
    )


def rank_cuts(
    df: DataFrame,
    columns: Sequence[str],
    parts: int = 20,
    weight: str | None = None,
    accuracy: int = 10_000,
    sorted_values: int = ROWS_PER_PIECE,
) -> dict[str, list[float]]:
    """Exact cuts of each column into ``parts`` of about equal weight.

    Cut k is the value at rank ``floor(k * n / parts) + 1`` of the non-missing values.

    A sketch puts brackets around every wanted rank, and the weights between the brackets
    are summed. Brackets that hold a wanted rank and more than ``sorted_values`` different
    values are cut again by a sketch of their own, until none is left. Then the values in
    the brackets with a wanted rank are sorted, a bracket at a time. Every pass sums inside
    tasks first; what comes to the driver is a number of figures per column and part.
    """
    columns = list(columns)
    if not columns:
        return {}
    spark = df.sparkSession
    load = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    data = df.select(*[real(c).alias(c) for c in columns], load.alias("_weight"))

    near = sorted({min(1.0, max(0.0, k / parts + d)) for k in range(1, parts) for d in (-2 / accuracy, 2 / accuracy)})
    row = data.agg(*[F.percentile_approx(c, near, F.lit(accuracy)).alias(c) for c in columns]).first()
    edges = {c: sorted(set(row[c] or [])) for c in columns}
    finer = [i / FINER for i in range(FINER + 1)]
    while True:
        rows = _in_pieces(data, edges)
        held: dict[int, list[tuple[int, int, int]]] = {}
        found = rows.groupBy("v", "piece").agg(F.sum("_weight").alias("n"), F.approx_count_distinct("value").alias("values"))
        for r in found.collect():
            held.setdefault(r["v"], []).append((r["piece"], r["n"], r["values"]))
        wanted, wide = [], set()
        for v, pieces in held.items():
            total, before = sum(n for _, n, _ in pieces), 0
            ranks = [k * total // parts + 1 for k in range(1, parts)]
            for piece, n, values in sorted(pieces):
                inside = [(v, piece, rank - before) for rank in ranks if before < rank <= before + n]
                wanted += inside
                if inside and values > sorted_values:
                    wide.add((v, piece))
                before += n
        if not wanted:
            return {c: [] for c in columns}
        known = {c: len(e) for c, e in edges.items()}
        if wide:
            few = F.broadcast(spark.createDataFrame(sorted(wide), "v INT, piece INT"))
            sketch = F.percentile_approx("value", finer, F.lit(accuracy)).alias("cuts")
            for r in rows.join(few, ["v", "piece"]).groupBy("v", "piece").agg(sketch).collect():
                # A value that fills a bracket alone gets an edge on either side.
                more = {x for cut in r["cuts"] for x in (cut, math.nextafter(cut, math.inf))}
                edges[columns[r["v"]]] = sorted({*edges[columns[r["v"]]], *more})
        if known == {c: len(e) for c, e in edges.items()}:
            break

    targets = F.broadcast(spark.createDataFrame(sorted(set(wanted)), "v INT, piece INT, rank LONG"))
    pieces = F.broadcast(spark.createDataFrame(sorted({w[:2] for w in wanted}), "v INT, piece INT"))
    upto = Window.partitionBy("v", "piece").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = (
        rows.join(pieces, ["v", "piece"])
        .groupBy("v", "piece", "value")
        .agg(F.sum("_weight").alias("n"))
        .withColumn("last", F.sum("n").over(upto))
        .join(targets, ["v", "piece"])
        .where((F.col("rank") <= F.col("last")) & (F.col("rank") > F.col("last") - F.col("n")))
        .select("v", "value")
        .distinct()
        .collect()
    )
    cuts: dict[str, list[float]] = {c: [] for c in columns}
    for r in sorted(values):
        cuts[columns[r["v"]]].append(r["value"])
    return cuts


def _in_pieces(data: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(_weight, v, piece, value): every value of every column with the bracket it falls in."""
    cut = bucketed(data, edges, "_piece")
    every = [
        F.struct(F.lit(i).alias("v"), F.col(f"{c}_piece").alias("piece"), F.col(c).alias("value"))
        for i, c in enumerate(edges)
    ]
    return cut.select("_weight", F.inline(F.array(*every))).where(F.col("value").isNotNull())
