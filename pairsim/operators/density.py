"""Kernel density of points by the data's own bandwidth (O70), densest last.

Scott's rule: the kernel's covariance is the points' covariance times n^(-1/3). In coordinates u where that is the identity, a
grid of step ``step`` takes every point's weight in linear shares of the four cells around it, the grid is convolved with a
truncated Gaussian along one axis and then along the other, and a point's density is read off the four cells around it.

Error bound: sharing and reading are linear interpolations of a kernel whose second derivatives are at most 1, each off by at most
step^2 / 8 per axis; truncation loses at most 2 exp(-radius^2 / 2). So densities are within (step^2 / 2 + 2 exp(-radius^2 / 2)) x peak of
the direct sum, where peak = 1 / (2 pi sqrt(det)) is the density of a point on itself.

Work is per occupied cell and kernel offset, not per pair of points; covariance is one aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsim.operators.ranking import sorted_positions
from pairsim.session import cut_lineage

STEP, RADIUS = 0.1, 5.0


def scott_transform(points: DataFrame, x: str, y: str) -> dict[str, float] | None:
    """n, the means, and the lower triangle (a, 0; b, c) of the kernel covariance's Cholesky factor; None if it is singular."""
    m = points.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("vxy")).first()
    if m.n < 2 or not m.vx or m.vx * m.vy - m.vxy**2 <= 1e-12 * m.vx * m.vy:
        return None
    shrink = m.n ** (-1.0 / 3.0)
    a = math.sqrt(m.vx * shrink)
    b = m.vxy * shrink / a
    return {"n": m.n, "mx": m.mx, "my": m.my, "a": a, "b": b, "c": math.sqrt(m.vy * shrink - b * b)}


def error_bound(t: dict[str, float], step: float = STEP, radius: float = RADIUS) -> float:
    return (step * step / 2 + 2 * math.exp(-radius * radius / 2)) / (2 * math.pi * t["a"] * t["c"])


def kernel_density(points: DataFrame, x: str = "score", y: str = "pred", step: float = STEP, radius: float = RADIUS, out: str = "density") -> DataFrame:
    """``points`` with their density; null for points with a null or NaN coordinate, and for all if they lie on a line."""
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    t = scott_transform(known, x, y)
    if t is None:
        return points.withColumn(out, F.lit(None).cast("double"))
    # Equal points are one row here; their number is their weight.
    where = known.groupBy(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    where = where.withColumn("_u", (F.col("_x") - t["mx"]) / t["a"] / step)
    where = cut_lineage(where.withColumn("_v", ((F.col("_y") - t["my"]) - t["b"] * (F.col("_x") - t["mx"]) / t["a"]) / t["c"] / step))
    fu, fv = F.col("_u") - F.floor("_u"), F.col("_v") - F.floor("_v")
    corner = lambda i, j: F.struct((F.floor("_u") + i).alias("cx"), (F.floor("_v") + j).alias("cy"), ((fu if i else 1 - fu) * (fv if j else 1 - fv)).alias("s"))
    shares = where.select("_x", "_y", "_n", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("c")).select("_x", "_y", "_n", "c.*")
    cells = cut_lineage(shares.groupBy("cx", "cy").agg(F.sum(F.col("_n") * F.col("s")).alias("m")))
    reach = int(math.floor(radius / step))
    spread = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("o")
    weight = F.exp(-(F.col("o") * step) * (F.col("o") * step) / 2)
    # Along x to the columns that hold points, then along y to the cells that do.
    columns = cells.select("cx").distinct()
    along = cells.select("cx", "cy", "m", spread).select((F.col("cx") + F.col("o")).alias("cx"), "cy", (F.col("m") * weight).alias("m"))
    along = along.join(columns, "cx", "left_semi").groupBy("cx", "cy").agg(F.sum("m").alias("m"))
    both = along.select("cx", "cy", "m", spread).select("cx", (F.col("cy") + F.col("o")).alias("cy"), (F.col("m") * weight).alias("m"))
    both = both.join(cells.select("cx", "cy"), ["cx", "cy"], "left_semi").groupBy("cx", "cy").agg(F.sum("m").alias("m"))
    peak = 1.0 / (2 * math.pi * t["a"] * t["c"])
    read = shares.join(both, ["cx", "cy"]).groupBy("_x", "_y").agg((F.sum(F.col("s") * F.col("m")) * (peak / t["n"])).alias(out))
    return points.join(read, (F.col(x).cast("double") == F.col("_x")) & (F.col(y).cast("double") == F.col("_y")), "left").drop("_x", "_y")


def densest_last(points: DataFrame, tie: str, density: str = "density", out: str = "position") -> DataFrame:
    """``out`` = 1, 2, 3... in ascending order of density (nulls first), ties by ``tie``: the order in which points are drawn."""
    return sorted_positions(points, [density, tie], out)
