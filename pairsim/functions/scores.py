"""Score-related Column expressions: strata (O19), evaluation slices (O21), weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO, ONE, MIDDLE = "zero", "one", "middle"
STRATA = (ZERO, ONE, MIDDLE)

# The five overlapping evaluation slices, in the order they are reported.
SLICES = ("all", "nonzero", "zero", "between", "upper_half")


def clean_score(score: Column) -> Column:
    """A NaN score (0/0 at collection) is a missing score."""
    return F.nanvl(score.cast("double"), F.lit(None).cast("double"))


def stratum(score: Column) -> Column:
    """zero (=0), one (=1), middle (0<s<1); NULL/NaN or out of range -> NULL."""
    s = clean_score(score)
    return (F.when(s == 0, F.lit(ZERO))
             .when(s == 1, F.lit(ONE))
             .when((s > 0) & (s < 1), F.lit(MIDDLE)))


def slice_flags(score: Column) -> dict[str, Column]:
    """Membership of each (overlapping) evaluation slice. The last slice is strict: 0.5 < s < 1."""
    s = clean_score(score)
    return {
        "all": s.isNotNull(),
        "nonzero": s != 0,
        "zero": s == 0,
        "between": (s != 0) & (s != 1),
        "upper_half": (s > 0.5) & (s < 1),
    }


def slice_names(score: Column) -> Column:
    """Array of the slice names the row belongs to (explode it to aggregate all slices in one pass)."""
    flags = slice_flags(score)
    return F.filter(F.array(*[F.when(flags[n], F.lit(n)) for n in SLICES]), lambda x: x.isNotNull())


def zero_weight(score: Column, zero: float = 0.001, nonzero: float = 1.0) -> Column:
    """Sample weight, ``zero`` when the score is 0 else ``nonzero``; NULL for a missing score (NULL, NaN)."""
    s = clean_score(score)
    return F.when(s == 0, F.lit(zero)).when(s.isNotNull(), F.lit(nonzero))


# The banded weight table, in order; the first matching band wins.
# (lower, upper, upper_inclusive, weight); lower == upper means "score equals lower".
WEIGHT_BANDS = [
    (0.0, 0.0, True, 0.01),
    (0.0, 0.1, True, 0.32),
    (0.1, 0.2, True, 5.71),
    (0.2, 0.5, True, 5.93),
    (0.2, 0.8, True, 28.01),
    (0.8, 1.0, False, 52.94),
    (1.0, 1.0, True, 92.13),
]
BAND_DEFAULT = -1.0


def banded_weight(score: Column, bands=WEIGHT_BANDS, default: float = BAND_DEFAULT) -> Column:
    """Ordered band lookup (lower < s <= upper, or < upper when not inclusive); first match wins."""
    expr = None
    for lo, hi, incl, w in bands:
        if lo == hi:
            cond = score == lo
        else:
            cond = (score > lo) & ((score <= hi) if incl else (score < hi))
        expr = F.when(cond, F.lit(w)) if expr is None else expr.when(cond, F.lit(w))
    return expr.otherwise(F.lit(default))
