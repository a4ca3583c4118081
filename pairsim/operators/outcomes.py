"""Outcome reporting: technique runs vs baseline, merge outcome ratios, thresholds, suites, history (O26, O37, O38, O61-O66, O82, O107)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsim.functions.scores import clean_score


def run_average(runs: DataFrame, group: str = "group_id", technique: str = "technique", run: str = "run",
                size: str = "size") -> DataFrame:
    """Per (group, technique): per-run total size, averaged over the runs."""
    per_run = runs.groupBy(group, technique, run).agg(F.sum(size).alias("_s"))
    return per_run.groupBy(group, technique).agg(F.count(F.lit(1)).alias("runs"), F.avg("_s").alias("avg_size"))


def vs_baseline(avg: DataFrame, baseline: str, group: str = "group_id", technique: str = "technique") -> DataFrame:
    """Each technique's size next to the baseline's in the same group (equi-join on group)."""
    base = avg.filter(F.col(technique) == baseline).select(group, F.col("avg_size").alias("base_size"))
    return avg.filter(F.col(technique) != baseline).join(base, group)


def reduction_pct(size: Column, base: Column) -> Column:
    """100 * (base - size) / base; NULL for a zero base."""
    return F.lit(100.0) * F.try_divide(base - size, base)


def size_reduction(cmp: DataFrame, technique: str = "technique") -> DataFrame:
    """Mean reduction per technique over groups (suite average)."""
    r = cmp.withColumn("reduction", reduction_pct(F.col("avg_size"), F.col("base_size")))
    return r.groupBy(technique).agg(F.count(F.lit(1)).alias("groups"), F.avg("reduction").alias("mean_reduction"))


def technique_wins(cmp: DataFrame, reference: str, group: str = "group_id", technique: str = "technique") -> DataFrame:
    """Per technique: groups where its reduction >= the reference technique's, and groups with negative reduction.

    Reductions are compared at 9 decimals: floating sums merged in a different
    order must not decide a tie.
    """
    r = cmp.withColumn("reduction", F.round(reduction_pct(F.col("avg_size"), F.col("base_size")), 9))
    ref = r.filter(F.col(technique) == reference).select(group, F.col("reduction").alias("_ref"))
    j = r.join(ref, group, "left")
    return j.groupBy(technique).agg(F.count_if(F.col("reduction") >= F.col("_ref")).alias("wins"),
                                    F.count_if(F.col("reduction") < 0).alias("negative"))


def outcome_ratios(outcomes: DataFrame, groups: DataFrame, group: str = "group_name") -> DataFrame:
    """Attempts, profitable % (of attempts), valid %, profitable-of-valid %; 0 attempts -> NULL."""
    a = outcomes.groupBy(group).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("profitable").alias("profitable"),
        F.count_if("valid").alias("valid"), F.count_if(F.col("valid") & F.col("profitable")).alias("valid_profitable"))
    j = groups.join(a, group, "left").fillna(0, ["attempts", "profitable", "valid", "valid_profitable"])
    pct = lambda n, d: F.lit(100.0) * F.try_divide(F.col(n).cast("double"), F.col(d).cast("double"))
    return j.select(group, "attempts", "profitable", "valid",
                    pct("profitable", "attempts").alias("profitable_pct"),
                    pct("valid", "attempts").alias("valid_pct"),
                    pct("valid_profitable", "valid").alias("profitable_of_valid_pct"))


def decision_outcome(decisions: DataFrame, outcomes: DataFrame, key: list[str]) -> DataFrame:
    """Predicted decisions with the observed outcome (left join: undecided/unobserved stay)."""
    return decisions.join(outcomes, key, "left")


def threshold_sweep(best: DataFrame, thresholds=(0.4, 0.5, 0.6), score: str = "score") -> DataFrame:
    """For each threshold t, how many best partners exceed t (merge only if score > t)."""
    th = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    j = best.select(clean_score(F.col(score)).alias(score), th)  # a NaN score exceeds nothing
    return j.groupBy("threshold").agg(F.count_if(F.col(score) > F.col("threshold")).alias("merges"),
                                      F.count(F.lit(1)).alias("entities"))


# Suites by glob pattern over group names; unmatched names are their own suite.
SUITES = [
    ("spec2006", ["4*.*"]),
    ("spec2017", ["5*.*", "6*.*"]),
]


def glob_regex(g: str) -> str:
    out = "^"
    for ch in g:
        out += ".*" if ch == "*" else "." if ch == "?" else ("\\" + ch if ch in ".+()[]{}^$|\\" else ch)
    return out + "$"


def suite_of(name: Column) -> Column:
    """O107: suite of a group name; the first matching pattern wins, else the name itself."""
    expr = None
    for suite, pats in SUITES:
        for p in pats:
            cond = name.rlike(glob_regex(p))
            expr = F.when(cond, F.lit(suite)) if expr is None else expr.when(cond, F.lit(suite))
    return expr.otherwise(name)


def history_best(hist: DataFrame, trial: str = "trial", step: str = "step", metric: str = "val_mse") -> DataFrame:
    """Epoch number and running minimum of the metric per trial (ordered by ``step``).

    Computed with chunked running aggregates, so a very long trial is spread
    over many tasks instead of one window partition.
    """
    from pairsim.operators.ranking import running_aggregates
    return running_aggregates(hist, [trial], step, [("epoch", "count", None), ("best_so_far", "min", metric)])


def early_stop(hist: DataFrame, patience: int = 5, trial: str = "trial", step: str = "step",
               metric: str = "val_loss") -> DataFrame:
    """Per trial, the first epoch at which the metric has not improved for ``patience`` epochs (NULL: never),
    the best epoch and the best value."""
    from pairsim.operators.ranking import running_aggregates
    h = running_aggregates(hist, [trial], step, [("epoch", "count", None), ("_prev_best", "min_before", metric)])
    h = h.withColumn("_improved", F.col("_prev_best").isNull() | (F.col(metric) < F.col("_prev_best")))
    h = running_aggregates(h, [trial], step, [("_last_best", "max", F.when(F.col("_improved"), F.col("epoch")))])
    h = h.withColumn("_gap", F.col("epoch") - F.col("_last_best"))
    return h.groupBy(trial).agg(F.min(F.when(F.col("_gap") >= patience, F.col("epoch"))).alias("stop_epoch"),
                                F.min_by("epoch", F.struct(metric, "epoch")).alias("best_epoch"),
                                F.min(metric).alias("best_value"))
