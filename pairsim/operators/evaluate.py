"""Evaluation aggregates over (truth, prediction) columns (O52, O55-O59, O67-O74, O103).

Everything is a grouped aggregate: only bins and metrics reach the driver.
Two-pass operators (histograms over the data range) compute the range as a
one-row aggregate and attach it with a one-row broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsim.functions.scores import SLICES, clean_score, slice_names, zero_weight


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slice_metrics(df: DataFrame, truth: str = "score", pred: str = "pred", slices=SLICES) -> DataFrame:
    """MSE / MAE / MAPE for every (overlapping) slice in one pass.

    Each row is exploded into the slices it belongs to, then one grouped
    aggregate. MAPE skips zero truths (division by zero), in percent.
    """
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    names = slice_names(F.col(truth))
    if tuple(slices) != tuple(SLICES):
        keep = F.array(*[F.lit(s) for s in slices])
        names = F.filter(names, lambda x: F.array_contains(keep, x))
    # A row without truth is in no slice; one without a prediction has no error.
    e = df.where(clean_score(p).isNotNull()).select(F.explode(names).alias("slice"), (y - p).alias("_e"), y.alias("_y"))
    return e.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("_e") * F.col("_e")).alias("mse"),
        F.avg(F.abs("_e")).alias("mae"),
        (F.lit(100.0) * F.avg(F.abs(F.try_divide(F.col("_e"), F.col("_y"))))).alias("mape"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Unique values with their counts (order by value when presenting)."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """Inverse-frequency weights total / (n_classes * n_c)."""
    per = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    tot = per.agg(F.struct(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))).scalar()  # scalar subquery
    per = per.withColumn("_tot", tot)                                  # attached once
    return per.select(cls, "n", (F.col("_tot.t") / (F.col("_tot.k") * F.col("n"))).alias("weight"))


def diff_histogram(df: DataFrame, truth: str = "score", pred: str = "pred", bins: int = 50) -> DataFrame:
    """Equal-width histogram of truth - prediction between its min and max; last bin closed.

    Bin i holds lo + i*w <= x < lo + (i+1)*w (the last one includes hi), with
    the edge test done against the computed edges so that values on an edge
    fall the same way as with linspace edges. Empty bins are present with n = 0.
    """
    x = (F.col(truth).cast("double") - F.col(pred).cast("double")).alias("_x")
    d = df.select(x).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    rng = d.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("r")).scalar()  # scalar subquery
    # Attach the range once as a column; every later expression reads the column, not the subquery.
    j = d.select("_x", rng.alias("_r"))
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    w = (hi - lo) / F.lit(bins)
    raw = F.floor((F.col("_x") - lo) * (F.lit(bins) / (hi - lo)))
    i0 = F.when(hi == lo, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")
    j = j.withColumn("_i", i0)
    edge = lambda k: lo + k * w
    j = j.withColumn("_i", F.when(F.col("_x") < edge(F.col("_i")), F.col("_i") - 1)
                     .when((F.col("_x") >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1), F.col("_i") + 1)
                     .otherwise(F.col("_i")))
    counts = j.groupBy("_i").agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), rng.alias("_r"))
    out = all_bins.join(counts, all_bins["bin"] == counts["_i"], "left")
    return out.select("bin", (lo + F.col("bin") * w).alias("lower"), (lo + (F.col("bin") + 1) * w).alias("upper"),
                      F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def _cell(c: Column, bins: int) -> Column:
    return F.least(F.floor(c * F.lit(bins)), F.lit(bins - 1)).cast("int")


def hist2d(df: DataFrame, x: str = "score", y: str = "pred", bins: int = 100) -> DataFrame:
    """Bins x bins histogram over [0,1]^2; values outside are dropped; 1.0 falls in the last bin.

    (``width_bucket(1.0, 0, 1, n)`` would give n+1, hence the explicit least().)
    """
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) <= 1)
    d = df.filter(inside(x) & inside(y))
    g = d.groupBy(_cell(F.col(x), bins).alias("bx"), _cell(F.col(y), bins).alias("by")).agg(
        F.count(F.lit(1)).alias("n"))
    return g.withColumn("log_n", F.log10("n"))


def hexbin(df: DataFrame, x: str = "score", y: str = "pred", gridsize: int = 500) -> DataFrame:
    """Hexagonal binning on two offset rectangular lattices; each point goes to the nearer centre.

    Extent = data min/max padded by 1e-9 of the span; ny = int(gridsize / sqrt(3)).
    Returns (lattice, i, j, n) for non-empty cells.
    """
    nx = gridsize
    ny = int(nx / math.sqrt(3))
    d = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    e = d.agg(F.struct(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"),
                       F.max("_y").alias("y1")).alias("e")).scalar()  # scalar subquery
    d = d.select("_x", "_y", e.alias("_e"))   # attach the extent once as a column
    x0, x1, y0, y1 = F.col("_e.x0"), F.col("_e.x1"), F.col("_e.y0"), F.col("_e.y1")
    xpad, ypad = (x1 - x0) * F.lit(1e-9), (y1 - y0) * F.lit(1e-9)
    xmin, xmax, ymin, ymax = x0 - xpad, x1 + xpad, y0 - ypad, y1 + ypad
    sx = (xmax - xmin) / F.lit(nx)
    sy = (ymax - ymin) / F.lit(ny)
    j = d.select(F.try_divide(F.col("_x") - xmin, sx).alias("u"), F.try_divide(F.col("_y") - ymin, sy).alias("v"))
    i1, j1 = F.rint("u"), F.rint("v")
    i2, j2 = F.floor("u"), F.floor("v")
    d1 = (F.col("u") - i1) ** 2 + F.lit(3.0) * (F.col("v") - j1) ** 2
    d2 = (F.col("u") - i2 - 0.5) ** 2 + F.lit(3.0) * (F.col("v") - j2 - 0.5) ** 2
    first = d1 < d2
    cell = j.select(F.when(first, F.lit(1)).otherwise(F.lit(2)).alias("lattice"),
                    F.when(first, i1).otherwise(i2).cast("long").alias("i"),
                    F.when(first, j1).otherwise(j2).cast("long").alias("j"))
    return cell.groupBy("lattice", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def binned_density(df: DataFrame, x: str = "score", y: str = "pred", bins: int = 100, radius: int = 2,
                   sigma: float = 1.0) -> DataFrame:
    """Gaussian kernel density on the O68 grid (binned KDE), densest last.

    Each occupied cell spreads its count to the cells within ``radius`` with
    weight exp(-(dx^2+dy^2) / (2 sigma^2)); density = sum / total count. The
    quadratic point-to-point KDE becomes a join of the grid with a
    (2r+1)^2-row offset table. Only occupied cells are reported.
    """
    g = hist2d(df, x, y, bins).select("bx", "by", "n")
    kernel = [(dx, dy, math.exp(-(dx * dx + dy * dy) / (2.0 * sigma * sigma)))
              for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)]
    offs = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(wt).alias("w"))
                               for dx, dy, wt in kernel])).alias("o")
    spread = g.select("bx", "by", "n", offs).select(
        (F.col("bx") + F.col("o.dx")).alias("tx"), (F.col("by") + F.col("o.dy")).alias("ty"),
        (F.col("n") * F.col("o.w")).alias("m"))
    dens = spread.groupBy("tx", "ty").agg(F.sum("m").alias("_m"))
    tot = g.agg(F.sum("n")).scalar()  # scalar subquery
    out = g.join(dens, (g["bx"] == dens["tx"]) & (g["by"] == dens["ty"]))
    return out.select("bx", "by", "n", (F.col("_m") / tot).alias("density"))


def weighted_loss(df: DataFrame, truth: str = "score", pred: str = "pred", by: list[str] | None = None,
                  zero: float = 0.001, nonzero: float = 1.0) -> DataFrame:
    """Squared error weighted by zero_weight; reported as sum(w*se)/n and sum(w*se)/sum(w)."""
    w = zero_weight(F.col(truth), zero, nonzero)
    se = (F.col(truth) - F.col(pred)) ** 2
    df = df.where(clean_score(F.col(truth)).isNotNull() & clean_score(F.col(pred)).isNotNull())  # rows without a score have no loss
    return df.groupBy(*(by or [])).agg(
        (F.sum(w * se) / F.count(F.lit(1))).alias("loss_mean"),
        (F.sum(w * se) / F.sum(w)).alias("loss_weighted"),
        F.sum(w).alias("weight_sum"))


def exp_weighted_loss(df: DataFrame, truth: str = "score", pred: str = "pred", alpha: float = 0.3,
                      by: list[str] | None = None) -> DataFrame:
    """mean(exp(alpha * y) * (y - p)^2)."""
    y, p = F.col(truth), F.col(pred)
    return df.groupBy(*(by or [])).agg(F.avg(F.exp(F.lit(alpha) * y) * (y - p) ** 2).alias("exp_loss"))
