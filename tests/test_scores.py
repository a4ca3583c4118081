"""Score strata and slices for NULL/NaN/edge values (FIXTURES C.2), weights, histograms."""

import numpy as np
from pyspark.sql import functions as F

from pairsim.functions.scores import banded_weight, slice_flags, stratum
from pairsim.operators.evaluate import diff_histogram, hist2d, slice_metrics


def test_stratum_edges(spark):
    vals = [None, float("nan"), 0.0, 1e-12, 0.5, 0.5000001, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s double")
    got = [r["st"] for r in df.orderBy("i").select(stratum(F.col("s")).alias("st")).collect()]
    assert got == [None, None, "zero", "middle", "middle", "middle", "one"]


def test_upper_half_slice_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,), (1.0,)], "s double")
    f = slice_flags(F.col("s"))
    got = [r[0] for r in df.select(f["upper_half"]).collect()]
    assert got == [False, True, False]


def test_slice_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    y = np.round(rng.choice([0.0, 0.0, 0.3, 0.7, 1.0], 200), 4)
    p = np.round(rng.random(200), 4)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "score double, pred double")
    m = {r["slice"]: r for r in slice_metrics(df).collect()}
    nz = y != 0
    assert abs(m["all"]["mse"] - np.mean((y - p) ** 2)) < 1e-12
    assert abs(m["nonzero"]["mae"] - np.mean(np.abs(y[nz] - p[nz]))) < 1e-12
    assert abs(m["all"]["mape"] - 100 * np.mean(np.abs((y[nz] - p[nz]) / y[nz]))) < 1e-9


def test_banded_weight_first_match_wins(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.15,), (0.3,), (0.6,), (0.9,), (1.0,), (1.5,)], "s double")
    got = [r[0] for r in df.select(banded_weight(F.col("s"))).collect()]
    assert got == [0.01, 0.32, 5.71, 5.93, 28.01, 52.94, 92.13, -1.0]


def test_diff_histogram_matches_numpy(spark):
    rng = np.random.default_rng(7)
    y, p = rng.random(500), rng.random(500)
    y[0], p[0] = 1.0, 0.0   # exact max
    y[1], p[1] = 0.0, 1.0   # exact min
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "score double, pred double")
    got = [r["n"] for r in diff_histogram(df).orderBy("bin").collect()]
    want, _ = np.histogram(y - p, bins=50)
    assert got == list(want)


def test_hist2d_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (-0.1, 0.5), (1.1, 0.5)], "score double, pred double")
    cells = sorted((r["bx"], r["by"], r["n"]) for r in hist2d(df).collect())
    assert cells == [(0, 99, 1), (99, 99, 1)]
