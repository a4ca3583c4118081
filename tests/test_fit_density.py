"""Fits of a caller's loss against a dense solver; densities against the direct sum."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsim.functions.scores import zero_weight
from pairsim.operators import density as D
from pairsim.operators import fit as L


def sample(seed=1, n=800, d=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    y = 1 / (1 + np.exp(-(x @ np.arange(1, d + 1) / 2 + rng.standard_normal(n)))) * (rng.random(n) > 0.4)
    return x, y


def frame(spark, x, y, extra=()):
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y)] + list(extra)
    return spark.createDataFrame(rows, "features array<double>, label double").repartition(4).cache()


def dense(x, y, w, steps=200):
    """Gauss-Newton with halved steps for sum w (sigmoid(x b) - y)^2, analytic derivatives."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    b = np.zeros(x.shape[1])
    loss = lambda b: float((w * (1 / (1 + np.exp(-x @ b)) - y) ** 2).sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        s = p * (1 - p)
        move = np.linalg.solve((x * (2 * w * s * s)[:, None]).T @ x, -(x.T @ (2 * w * (p - y) * s)))
        while loss(b + move) > loss(b) and np.abs(move).max() > 1e-12:
            move /= 2
        b = b + move
    return b


def test_weighted_fits_equal_a_dense_solver(spark):
    x, y = sample()
    rows = frame(spark, x, y, [([1.0, 2.0, 3.0], None)])  # a row without a label takes no part
    for loss, weight, w in ((L.exp_weighted(0.3), None, np.exp(0.3 * y)), (L.squared, zero_weight(F.col("label")), np.where(y == 0, 0.001, 1.0))):
        got = L.fit_loss(rows, 3, loss, "logit", weight=weight)
        assert got.settled and np.abs(got.beta - dense(x, y, w)).max() < 1e-4
    pred = got.predict(rows.where("label is not null")).agg(F.sum(zero_weight(F.col("label")) * L.squared(F.col("prediction"), F.col("label"))).alias("s")).first().s
    assert abs(pred / w.sum() - got.loss) < 1e-9


def test_any_smooth_column_is_a_loss(spark):
    x, y = sample(2)
    rows = frame(spark, x, y)
    # Pseudo-Huber loss on a line: its gradient vanishes at the fit.
    got = L.fit_loss(rows, 3, lambda p, t: F.sqrt(1 + (p - t) * (p - t)) - 1, "identity")
    full = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    r = full @ got.beta - y
    assert got.settled and np.abs(full.T @ (r / np.sqrt(1 + r * r))).max() / len(y) < 1e-6
    # A ridge pulls the slopes, not the intercept; the squared loss then has a closed form.
    got = L.fit_loss(rows, 3, L.squared, "identity", ridge=0.5)
    want = np.linalg.solve(2 * full.T @ full / len(y) + np.diag([0, 0.5, 0.5, 0.5]), 2 * full.T @ y / len(y))
    assert np.abs(got.beta - want).max() < 1e-5
    assert L.fit_loss(rows.limit(0), 3).steps == 0


@pytest.mark.parametrize("step", [0.1, 0.3])
def test_density_within_the_bound_of_the_direct_sum(spark, step):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 1200), rng.normal([3, -2], 0.2, (500, 2)), np.tile([[1.0, 1.0]], (300, 1))])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(5000, None, 1.0), (5001, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "i long, score double, pred double")
    got = {r.i: r.density for r in D.kernel_density(df, step=step).collect()}
    cov = np.cov(p.T) * len(p) ** (-1 / 3)
    inv, peak = np.linalg.inv(cov), 1 / (2 * math.pi * math.sqrt(np.linalg.det(cov)))
    diff = p[:, None, :] - p[None, :, :]
    want = peak * np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", diff, inv, diff)).mean(axis=1)
    bound = D.error_bound(D.scott_transform(df.where("i < 5000"), "score", "pred"), step)
    error = max(abs(got[i] - want[i]) for i in range(len(p)))
    assert error <= bound and bound < peak * 0.05
    assert got[5000] is None and got[5001] is None
    ranked = D.densest_last(D.kernel_density(df, step=step), "i").collect()
    assert sorted(r.position for r in ranked) == list(range(1, len(rows) + 1))
    order = [r.density for r in sorted(ranked, key=lambda r: r.position) if r.density is not None]
    assert order == sorted(order)


def test_points_on_a_line_have_no_density(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(9)], "score double, pred double")
    assert {r.density for r in D.kernel_density(df).collect()} == {None}
    assert D.kernel_density(df.limit(0)).collect() == []
