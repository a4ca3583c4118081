"""Evaluation queries on scored pairs (truth = score, prediction = pred): O52, O55-O59, O67-O74, O103."""

from pyspark.sql import functions as F

from pairsim.functions.scores import banded_weight, clean_score
from pairsim.operators import evaluate as E
from pairsim.operators.ranking import exact_rank, hash_key
from pairsim.operators.split import balanced_split
from pairsim.plans.registry import query
from pairsim.session import cut_lineage
from pairsim.plans.split import SP_SQL, SPLIT_SQL
from pairsim.sources.tables import read_table, scored_pairs

R = 6  # decimals kept for every computed double (engines differ in the last bits of sums)


def rnd(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, R).alias(name)


SLICE_SQL = SP_SQL + """,
sl AS (
  SELECT 'all' AS slice, score, pred FROM sp
  UNION ALL SELECT 'nonzero', score, pred FROM sp WHERE score <> 0
  UNION ALL SELECT 'zero', score, pred FROM sp WHERE score = 0
  UNION ALL SELECT 'between', score, pred FROM sp WHERE score <> 0 AND score <> 1
  UNION ALL SELECT 'upper_half', score, pred FROM sp WHERE score > 0.5 AND score < 1)
"""


@query("slice_metrics", oracle=SLICE_SQL + """
SELECT slice, count(*)::BIGINT AS n, round(avg((score - pred) * (score - pred)), 6) AS mse,
       round(avg(abs(score - pred)), 6) AS mae,
       round(100.0 * avg(abs(CASE WHEN score <> 0 THEN (score - pred) / score END)), 6) AS mape
FROM sl GROUP BY slice""")
def q_slice_metrics(spark, d):
    m = E.slice_metrics(scored_pairs(spark, d))
    return m.select("slice", "n", rnd("mse", "mse"), rnd("mae", "mae"), rnd("mape", "mape"))


@query("eval_all_nonzero", oracle=SLICE_SQL + """
SELECT slice, count(*)::BIGINT AS n, round(avg((score - pred) * (score - pred)), 6) AS mse,
       round(avg(abs(score - pred)), 6) AS mae
FROM sl WHERE slice IN ('all', 'nonzero') GROUP BY slice""")
def q_eval_all_nonzero(spark, d):
    m = E.slice_metrics(scored_pairs(spark, d), slices=("all", "nonzero"))
    return m.select("slice", "n", rnd("mse", "mse"), rnd("mae", "mae"))


@query("score_scan", oracle=SP_SQL + " SELECT score FROM sp")
def q_score_scan(spark, d):
    return scored_pairs(spark, d).select("score")


@query("count_cond", oracle=SP_SQL + """
SELECT count(*)::BIGINT AS n_all, count(*) FILTER (WHERE score > 0)::BIGINT AS n_positive,
       count(*) FILTER (WHERE technique = 'R')::BIGINT AS n_technique_r FROM sp""")
def q_count_cond(spark, d):
    sp = scored_pairs(spark, d)
    return sp.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(clean_score(F.col("score")) > 0).alias("n_positive"),
                  F.count_if(F.col("technique") == "R").alias("n_technique_r"))


@query("max_id_or_zero", oracle="""
SELECT coalesce(max(o_orderkey), 0)::BIGINT AS max_id,
       (SELECT coalesce(max(o_orderkey), 0) FROM orders WHERE o_totalprice < 0)::BIGINT AS max_id_empty
FROM orders""")
def q_max_id_or_zero(spark, d):
    o = read_table(spark, d, "orders", ["o_orderkey", "o_totalprice"])
    return o.agg(F.coalesce(F.max("o_orderkey"), F.lit(0)).cast("long").alias("max_id"),
                 F.coalesce(F.max(F.when(F.col("o_totalprice") < 0, F.col("o_orderkey"))), F.lit(0))
                 .cast("long").alias("max_id_empty"))


@query("distinct_groups", oracle=SPLIT_SQL + """
SELECT DISTINCT split, technique AS group_name FROM bs WHERE split <> 'discarded'""")
def q_distinct_groups(spark, d):
    s = balanced_split(scored_pairs(spark, d), "pair_key")
    return s.filter(F.col("split") != "discarded").select("split", F.col("technique").alias("group_name")).distinct()


@query("value_counts", oracle=SP_SQL + """
SELECT 'truth' AS which, round(score, 6) AS value, count(*)::BIGINT AS n FROM sp GROUP BY round(score, 6)
UNION ALL SELECT 'pred', round(pred, 6), count(*)::BIGINT FROM sp GROUP BY round(pred, 6)""")
def q_value_counts(spark, d):
    sp = scored_pairs(spark, d).select(F.round("score", R).alias("score"), F.round("pred", R).alias("pred"))
    t = E.value_counts(sp, "score").select(F.lit("truth").alias("which"), "value", "n")
    p = E.value_counts(sp, "pred").select(F.lit("pred").alias("which"), "value", "n")
    return t.unionByName(p)


@query("class_weights", oracle=SP_SQL + """,
c AS (SELECT stratum, count(*) AS n FROM st WHERE stratum IS NOT NULL GROUP BY stratum)
SELECT stratum, n::BIGINT AS n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""")
def q_class_weights(spark, d):
    from pairsim.functions.scores import stratum
    sp = scored_pairs(spark, d).select(stratum(F.col("score")).alias("stratum")).filter(F.col("stratum").isNotNull())
    w = E.class_weights(sp, "stratum")
    return w.select("stratum", "n", rnd("weight", "weight"))


@query("diff_histogram", oracle=SP_SQL + """,
x AS (SELECT score - pred AS x FROM sp),
r AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 50 AS w FROM x),
i0 AS (SELECT x, lo, hi, w, CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) * (50 / (hi - lo))), 49) END AS i
       FROM x, r),
i1 AS (SELECT CASE WHEN x < lo + i * w THEN i - 1 WHEN x >= lo + (i + 1) * w AND i <> 49 THEN i + 1 ELSE i END AS i
       FROM i0),
c AS (SELECT i, count(*) AS n FROM i1 GROUP BY i),
b AS (SELECT unnest(range(0, 50)) AS bin)
SELECT b.bin::INTEGER AS bin, round(lo + b.bin * w, 6) AS lower, round(lo + (b.bin + 1) * w, 6) AS upper,
       coalesce(c.n, 0)::BIGINT AS n
FROM b CROSS JOIN r LEFT JOIN c ON c.i = b.bin""")
def q_diff_histogram(spark, d):
    h = E.diff_histogram(scored_pairs(spark, d))
    return h.select("bin", rnd("lower", "lower"), rnd("upper", "upper"), "n")


@query("hist2d", oracle=SP_SQL + """
SELECT least(floor(score * 100), 99)::INTEGER AS bx, least(floor(pred * 100), 99)::INTEGER AS "by",
       count(*)::BIGINT AS n, round(log10(count(*)), 6) AS log_n
FROM sp WHERE score BETWEEN 0 AND 1 AND pred BETWEEN 0 AND 1 GROUP BY 1, 2""")
def q_hist2d(spark, d):
    h = E.hist2d(scored_pairs(spark, d))
    return h.select("bx", "by", "n", rnd("log_n", "log_n"))


@query("hexbin", oracle=SP_SQL + """,
e AS (SELECT min(score) - (max(score) - min(score)) * 1e-9 AS xmin, max(score) + (max(score) - min(score)) * 1e-9 AS xmax,
             min(pred) - (max(pred) - min(pred)) * 1e-9 AS ymin, max(pred) + (max(pred) - min(pred)) * 1e-9 AS ymax FROM sp),
uv AS (SELECT (score - xmin) / ((xmax - xmin) / 500) AS u, (pred - ymin) / ((ymax - ymin) / 288) AS v FROM sp, e),
c AS (SELECT u, v, round_even(u, 0) AS i1, round_even(v, 0) AS j1, floor(u) AS i2, floor(v) AS j2 FROM uv),
k AS (SELECT *, (u - i1) ^ 2 + 3.0 * (v - j1) ^ 2 < (u - i2 - 0.5) ^ 2 + 3.0 * (v - j2 - 0.5) ^ 2 AS first FROM c)
SELECT CASE WHEN first THEN 1 ELSE 2 END AS lattice, (CASE WHEN first THEN i1 ELSE i2 END)::BIGINT AS i,
       (CASE WHEN first THEN j1 ELSE j2 END)::BIGINT AS j, count(*)::BIGINT AS n
FROM k GROUP BY 1, 2, 3""")
def q_hexbin(spark, d):
    return E.hexbin(scored_pairs(spark, d))


@query("binned_density", oracle=SP_SQL + """,
g AS (SELECT least(floor(score * 100), 99)::INTEGER AS bx, least(floor(pred * 100), 99)::INTEGER AS "by", count(*) AS n
      FROM sp WHERE score BETWEEN 0 AND 1 AND pred BETWEEN 0 AND 1 GROUP BY 1, 2),
o AS (SELECT a.range::INTEGER AS dx, b.range::INTEGER AS dy, exp(-(a.range * a.range + b.range * b.range) / 2.0) AS w
      FROM range(-2, 3) a, range(-2, 3) b),
s AS (SELECT bx + dx AS tx, "by" + dy AS ty, sum(n * w) AS m FROM g, o GROUP BY 1, 2)
SELECT bx, "by", n::BIGINT AS n, round(m / (SELECT sum(n) FROM g), 6) AS density
FROM g JOIN s ON g.bx = s.tx AND g."by" = s.ty""")
def q_binned_density(spark, d):
    b = E.binned_density(scored_pairs(spark, d))
    return b.select("bx", "by", "n", rnd("density", "density"))


@query("weighted_loss", oracle=SP_SQL + """
SELECT technique, round(sum(CASE WHEN score = 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END * (score - pred) ^ 2) / count(*), 6) AS loss_mean,
       round(sum(CASE WHEN score = 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END * (score - pred) ^ 2)
             / sum(CASE WHEN score = 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END), 6) AS loss_weighted,
       round(sum(CASE WHEN score = 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END), 6) AS weight_sum
FROM sp GROUP BY technique""")
def q_weighted_loss(spark, d):
    w = E.weighted_loss(scored_pairs(spark, d), by=["technique"])
    return w.select("technique", rnd("loss_mean", "loss_mean"), rnd("loss_weighted", "loss_weighted"),
                    rnd("weight_sum", "weight_sum"))


@query("banded_weight", oracle=SP_SQL + """,
b AS (SELECT score, CASE WHEN score = 0 THEN 0.01 WHEN score > 0 AND score <= 0.1 THEN 0.32
                         WHEN score > 0.1 AND score <= 0.2 THEN 5.71 WHEN score > 0.2 AND score <= 0.5 THEN 5.93
                         WHEN score > 0.2 AND score <= 0.8 THEN 28.01 WHEN score > 0.8 AND score < 1 THEN 52.94
                         WHEN score = 1 THEN 92.13 ELSE -1.0 END::DOUBLE AS weight FROM sp)
SELECT weight, count(*)::BIGINT AS n, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score
FROM b GROUP BY weight""")
def q_banded_weight(spark, d):
    b = scored_pairs(spark, d).select("score", banded_weight(F.col("score")).alias("weight"))
    return b.groupBy("weight").agg(F.count(F.lit(1)).alias("n"), rnd(F.min("score"), "min_score"),
                                   rnd(F.max("score"), "max_score"))


@query("exp_weighted_loss", oracle=SP_SQL + """
SELECT technique, round(avg(exp(0.3 * score) * (score - pred) ^ 2), 6) AS exp_loss FROM sp GROUP BY technique""")
def q_exp_weighted_loss(spark, d):
    e = E.exp_weighted_loss(scored_pairs(spark, d), by=["technique"])
    return e.select("technique", rnd("exp_loss", "exp_loss"))


@query("prediction_sample", oracle=SP_SQL + """
SELECT pair_key, score, pred FROM (SELECT *, row_number() OVER (ORDER BY md5('sample:' || pair_key)) AS r FROM sp)
WHERE r <= 1000""")
def q_prediction_sample(spark, d):
    # A bounded sample is the feature: the first `limit` rows of a deterministic hash order.
    sp = scored_pairs(spark, d).withColumn("_k", hash_key("pair_key", seed="sample"))
    return exact_rank(sp, "_k", out="_r").filter(F.col("_r") <= 1000).select("pair_key", "score", "pred")


@query("eval_slices", oracle=SP_SQL + """
SELECT pair_key, true AS in_all, score <> 0 AS in_nonzero, score = 0 AS in_zero, score <> 0 AND score <> 1 AS in_between,
       score > 0.5 AND score < 1 AS in_upper_half FROM sp""")
def q_eval_slices(spark, d):
    from pairsim.functions.scores import slice_flags
    sp = scored_pairs(spark, d)
    f = slice_flags(F.col("score"))
    return sp.select("pair_key", *[f[n].alias(f"in_{n}") for n in f])


# ---- density by the data's own bandwidth, and fits of a caller's loss ----

_KDE_SQL = SP_SQL + """,
mo AS (SELECT count(*) AS n, avg(score) AS mx, avg(pred) AS my, var_samp(score) AS vx, var_samp(pred) AS vy, covar_samp(score, pred) AS vxy FROM sp),
ch AS (SELECT *, sqrt(vx * pow(n, -1.0::DOUBLE / 3)) AS a, vxy * pow(n, -1.0::DOUBLE / 3) / sqrt(vx * pow(n, -1.0::DOUBLE / 3)) AS b FROM mo),
tr AS (SELECT *, sqrt(vy * pow(n, -1.0::DOUBLE / 3) - b * b) AS c FROM ch),
pt AS (SELECT score, pred, count(*) AS k, any_value((score - mx) / a / 0.1::DOUBLE) AS u, any_value(((pred - my) - b * (score - mx) / a) / c / 0.1::DOUBLE) AS v FROM sp, tr GROUP BY score, pred),
sh AS (SELECT score, pred, k, floor(u) + i AS cx, floor(v) + j AS cy,
         (CASE WHEN i = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE WHEN j = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS s
       FROM pt, range(2) t1(i), range(2) t2(j)),
ce AS (SELECT cx, cy, sum(k * s) AS m FROM sh GROUP BY ALL),
co AS (SELECT t.cx, t.cy, sum(f.m * exp(-pow((t.cx - f.cx) * 0.1::DOUBLE, 2) / 2) * exp(-pow((t.cy - f.cy) * 0.1::DOUBLE, 2) / 2)) AS m
       FROM ce t JOIN ce f ON abs(t.cx - f.cx) <= 50 AND abs(t.cy - f.cy) <= 50 GROUP BY ALL),
kd AS (SELECT score, pred, round(sum(s * m) / any_value(2 * pi() * a * c * n), 6) AS density FROM sh JOIN co USING (cx, cy), tr GROUP BY score, pred)"""


@query("point_density", oracle=_KDE_SQL + """
SELECT pair_key, density, row_number() OVER (ORDER BY density, pair_key) AS position FROM sp JOIN kd USING (score, pred)""")
def q_point_density(spark, d):
    from pairsim.operators.density import densest_last, kernel_density
    k = kernel_density(scored_pairs(spark, d).select("pair_key", "score", "pred"))
    return densest_last(k.withColumn("density", F.round("density", 6)), "pair_key").select("pair_key", "density", "position")


_FIT_SQL = SP_SQL + """,
w AS (SELECT technique, pred AS x, score AS y, {weight} AS w FROM sp),
s AS (SELECT technique, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM w GROUP BY technique),
b AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS slope FROM s)
SELECT technique, round((sy - slope * sx) / sw, 6) AS intercept, round(slope, 6) AS slope FROM b"""


def _fits(spark, d, loss, weight):
    """A line per technique (a few values) fitted by the given loss."""
    from pairsim.operators import fit
    rows = cut_lineage(scored_pairs(spark, d).select("technique", F.array("pred").alias("features"), F.col("score").alias("label")))
    names = [r.technique for r in rows.select("technique").distinct().collect()]
    out = []
    for t in sorted(names):
        f = fit.fit_loss(rows.where(F.col("technique") == t), 1, loss(fit), "identity", weight=weight)
        out.append((t, round(float(f.beta[0]), 6), round(float(f.beta[1]), 6)))
    return spark.createDataFrame(out, "technique string, intercept double, slope double")


@query("exp_loss_fit", oracle=_FIT_SQL.format(weight="exp(0.3::DOUBLE * score)"))
def q_exp_loss_fit(spark, d):
    return _fits(spark, d, lambda fit: fit.exp_weighted(0.3), None)


@query("zero_weight_fit", oracle=_FIT_SQL.format(weight="CASE WHEN score = 0 THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END"))
def q_zero_weight_fit(spark, d):
    from pairsim.functions.scores import zero_weight
    return _fits(spark, d, lambda fit: fit.squared, zero_weight(F.col("label")))
