"""A caller's loss as the thing that is fitted (O73, O104): Newton steps, one DataFrame aggregate each.

The model is link(x . beta). A loss is a function of two Columns, prediction and label, for one row; row weights are a Column. Its slope and
curvature in x . beta are central differences of that Column, so any smooth loss will do. A step's sums (gradient, Hessian
and loss, (d + 1)(d + 2) numbers) are added up by tasks over Arrow batches and then by a grouped aggregate: no row reaches the driver, and the rows
are read once per step. Curvature that is not positive is replaced by a small one, and steps that don't lower the loss are halved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the central differences in x . beta, and the least curvature of a row.
WIDTH, CURVATURE = 1e-4, 1e-9

Loss = Callable[[Column, Column], Column]
LINKS: dict[str, Callable[[Column], Column]] = {"identity": lambda e: e, "logit": lambda e: 1 / (1 + F.exp(-e))}


def squared(pred: Column, label: Column) -> Column:
    return (pred - label) * (pred - label)


def exp_weighted(alpha: float = 0.3) -> Loss:
    """Squared error weighted by exp(alpha * label)."""
    return lambda pred, label: F.exp(F.lit(alpha) * label) * squared(pred, label)


class Fit:
    """Coefficients (intercept first), the mean loss at them, steps taken, and whether they settled."""

    def __init__(self, beta: np.ndarray, loss: float, steps: int, settled: bool, link: str) -> None:
        self.beta, self.loss, self.steps, self.settled, self.link = beta, loss, steps, settled, link

    def predict(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        return df.withColumn(out, LINKS[self.link](linear(features, self.beta)))


def linear(features: str, beta: np.ndarray) -> Column:
    """x . beta with the intercept first; features are an array of numbers."""
    weights = F.array(*[F.lit(float(b)) for b in beta[1:]])
    dot = F.aggregate(F.zip_with(F.col(features), weights, lambda x, b: x.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    return F.lit(float(beta[0])) + dot


def step_sums(df: DataFrame, beta: np.ndarray, loss: Loss, link: str, features: str, label: str, weight: Column | None) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(weight sum, loss sum, gradient, Hessian) at ``beta``; rows with a null label, weight or feature take no part."""
    d = len(beta)
    w = F.lit(1.0) if weight is None else weight.cast("double")
    y = F.col(label).cast("double")
    at = lambda shift: w * loss(LINKS[link](F.col("_eta") + shift), y)
    rows = df.withColumn("_eta", linear(features, beta)).select(
        F.transform(F.col(features), lambda v: v.cast("double")).alias("x"), w.alias("w"), at(-WIDTH).alias("lo"), at(0.0).alias("mid"), at(WIDTH).alias("hi"))
    rows = rows.where("w is not null and mid is not null and not isnan(mid)")
    size = 2 + d + d * d

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, d - 1)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            w, lo, mid, hi = (b.column(i).to_numpy() for i in range(1, 5))
            slope = (hi - lo) / (2 * WIDTH)
            curve = np.maximum((hi - 2 * mid + lo) / WIDTH**2, CURVATURE * w)
            total[0] += w.sum()
            total[1] += mid.sum()
            total[2:2 + d] += x.T @ slope
            total[2 + d:] += ((x * curve[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "s"])

    out = np.zeros(size)
    for r in rows.mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # ``size`` rows
        out[r.i] = r.s
    return out[0], out[1], out[2:2 + d], out[2 + d:].reshape(d, d)


def fit_loss(df: DataFrame, dim: int, loss: Loss = squared, link: str = "logit", features: str = "features", label: str = "label", weight: Column | None = None,
             ridge: float = 0.0, tolerance: float = 1e-8, max_steps: int = 50) -> Fit:
    """Coefficients that minimise the weighted mean of ``loss`` (+ ridge / 2 x their squares, the intercept left out).

    ``dim`` is the length of ``features``. Newton steps from zero end when no coefficient moves by more than ``tolerance``. The row
    set should be stored or cached: it is read once per step.
    """
    beta, fine = np.zeros(dim + 1), np.append(0.0, np.full(dim, ridge))
    n, total, gradient, hessian = step_sums(df, beta, loss, link, features, label, weight)
    if not n:
        return Fit(beta, float("nan"), 0, True, link)
    value = lambda t, m, b: t / m + 0.5 * float(fine @ (b * b))
    now = value(total, n, beta)
    for step in range(1, max_steps + 1):
        move = np.linalg.lstsq(hessian / n + np.diag(fine), -(gradient / n + fine * beta), rcond=None)[0]
        for _ in range(20):
            n, total, g, h = step_sums(df, beta + move, loss, link, features, label, weight)
            if value(total, n, beta + move) <= now + 1e-12 or np.abs(move).max() <= tolerance:
                break
            move = move / 2
        beta, gradient, hessian, now = beta + move, g, h, value(total, n, beta + move)
        if np.abs(move).max() <= tolerance:
            return Fit(beta, now, step, True, link)
    return Fit(beta, now, max_steps, False, link)
