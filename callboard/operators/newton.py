"""Logistic regression by iterated weighted least squares, each step one aggregate.

A step needs, at the present coefficients, the loss, its gradient and the cross products of all
variables weighted by p * (1 - p). Each task adds its rows up batch by batch, as products of small matrices,
and gives one row of the sums per variable; Spark adds those of all tasks, and k * k numbers, whatever the
rows, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A step below this is the last: the error after it is about its square.
SMALL_STEP = 1e-7
MOST_HALVINGS = 30


def sums_at(df: DataFrame, label: str, names: Sequence[str], b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, weighted cross products) of all rows; the first place is the intercept's."""
    k = len(b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, loss, slope, products = 0, 0.0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y, *columns = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            x = np.column_stack([np.ones(len(y)), *columns])
            z = x @ b
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-z))
            rows += len(y)
            loss += float((np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0.0) - y * z).sum())
            slope += (p - y) @ x
            products += (x * (p * (1 - p))[:, None]).T @ x
        if rows:
            made = [pa.array(range(k), pa.int32()), pa.array([loss] * k), pa.array(slope), pa.array(products.tolist())]
            yield pa.RecordBatch.from_arrays(made, names=["place", "loss", "slope", "products"])

    plain = df.select(*(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([label, *names])))
    rows = plain.mapInArrow(work, "place INT, loss DOUBLE, slope DOUBLE, products ARRAY<DOUBLE>")
    found = rows.groupBy("place").agg(
        F.sum("loss").alias("loss"),
        F.sum("slope").alias("slope"),
        F.array(*(F.sum(F.col("products")[j]) for j in range(k))).alias("products"),
    )
    lines = sorted(found.collect(), key=lambda r: r["place"])
    if not lines:
        raise ValueError("there are no rows to fit")
    return lines[0]["loss"], np.array([r["slope"] for r in lines]), np.array([r["products"] for r in lines])


def fit(df: DataFrame, label: str, names: Sequence[str], penalty: float, most: int) -> tuple[np.ndarray, int]:
    """(intercept and coefficients, passes over ``df``) that minimise loss + penalty / 2 * |coefficients|^2.

    ``df`` has a 0/1 label and no missing values. The intercept bears no penalty. A step that does not
    lower the sum is halved. Raises if one label is all there is or ``most`` passes do not get there.
    """
    held = np.array([0.0] + [penalty] * len(names))
    b, step, before = np.zeros(len(held)), None, np.inf
    halvings = 0
    for passes in range(1, most + 1):
        loss, slope, products = sums_at(df, label, names, b)
        if passes == 1:
            # Everything has p = 1/2 here.
            rows = 4 * products[0, 0]
            if abs(slope[0]) >= rows / 2 - 0.25:
                raise ValueError("the rows have one label only")
        value = loss + held @ (b * b) / 2
        if value > before + 1e-12 * abs(before):
            halvings += 1
            if halvings > MOST_HALVINGS:
                raise ArithmeticError("no step lowers the loss")
            step = step / 2
            b = b - step
            continue
        before, halvings = value, 0
        step = -np.linalg.solve(products + np.diag(held), slope + held * b)
        b = b + step
        if np.abs(step).max() <= SMALL_STEP:
            return b, passes
    raise ArithmeticError(f"no end after {most} passes")
