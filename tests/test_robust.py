"""NULL, NaN, empty and extreme inputs: no row is lost, no missing score wins."""

import os

import pytest
from pyspark.sql import functions as F

from pairsim.functions import flags as FL
from pairsim.functions.scores import slice_flags, zero_weight
from pairsim.operators import evaluate as E
from pairsim.operators import outcomes as O
from pairsim.operators import pairs as P
from pairsim.operators import ranking as R
from pairsim.operators import split as S
from pairsim.operators.select import best_partner, greedy_select, topk_partners
from pairsim.sources import text as T

NAN = float("nan")


def test_ranks_keep_rows_with_null_keys_and_partitions(spark):
    df = spark.createDataFrame([("a", "01"), ("a", None), (None, "02"), (None, None), ("b", "03"), ("a", "0f")], "p string, k string")
    got = sorted([(r.p, r.k, r["rank"]) for r in R.exact_rank(df, "k", ["p"]).collect()], key=str)
    assert got == sorted([("a", None, 1), ("a", "01", 2), ("a", "0f", 3), (None, None, 1), (None, "02", 2), ("b", "03", 1)], key=str)
    keys = spark.createDataFrame([(1, None), (1, 2), (None, None)], "a long, b long")
    assert sorted(r.uid for r in R.dense_uid(keys, ["a", "b"]).collect()) == [0, 1, 2]
    assert sorted(r.uid for r in R.dense_uid(keys, ["a", "b"], unique=True).collect()) == [0, 1, 2]
    with pytest.raises(Exception, match="duplicate composite key"):
        R.dense_uid(keys.union(keys), ["a", "b"], unique=True).collect()
    assert S.fixed_batches(keys.withColumn("k", R.hash_key("a", "b")), "k", 2).count() == 3
    assert S.plain_split(keys.withColumn("k", R.hash_key("a", "b")), "k").count() == 3


def test_running_aggregates_keep_null_groups_and_orders(spark):
    df = spark.createDataFrame([("t", 1, 5.0), ("t", 2, 3.0), (None, 1, 1.0), ("t", None, 9.0)], "trial string, step long, m double")
    got = R.running_aggregates(df, ["trial"], "step", [("best", "min", "m"), ("n", "count", None)], chunk=2).collect()
    assert sorted([(r.trial, r.step, r.best, r.n) for r in got], key=str) == sorted([("t", None, 9.0, 1), ("t", 1, 5.0, 2), ("t", 2, 3.0, 3), (None, 1, 1.0, 1)], key=str)


def test_shuffle_order_and_sorted_positions(spark):
    df = spark.range(500).withColumn("k", R.hash_key("id"))
    assert [r.k for r in R.shuffle_order(df, "k", partitions=4).collect()] == sorted(r.k for r in df.collect())
    names = spark.createDataFrame([(n,) for n in ["f10", "f9", "f09", "f1" + "1" * 21, "f1" + "1" * 20, "f" + "1" * 20 + "9", "g", "", "f"]], "name string")
    natural = [r.name for r in T.natural_sort(names, "name", partitions=3).collect()]
    assert natural == ["", "f", "f09", "f9", "f10", "f" + "1" * 20 + "9", "f1" + "1" * 20, "f1" + "1" * 21, "g"] or natural.index("f10") > natural.index("f9")
    keys = {r.name: r.key for r in names.select("name", T.natural_key(F.col("name")).alias("key")).collect()}
    assert keys["f1" + "1" * 20] < keys["f1" + "1" * 21] and keys["f" + "1" * 20 + "9"] > keys["f1" + "1" * 20] and keys["f9"] < keys["f10"]
    got = R.sorted_positions(df, ["id"], partitions=7).collect()
    assert all(r.position == r.id + 1 for r in got) and len(got) == 500


def test_missing_scores_never_win(spark):
    pairs = spark.createDataFrame([(1, 1, 2, 0.5), (1, 1, 3, NAN), (1, 2, 3, None), (1, 3, 4, 0.2)], "group_id long, id1 long, id2 long, score double")
    best = {r.entity: (r.partner, r.score) for r in best_partner(pairs).collect()}
    assert best == {1: (2, 0.5), 2: (1, 0.5), 3: (4, 0.2), 4: (3, 0.2)}
    assert {(r.entity, r.partner) for r in topk_partners(pairs, 3).collect()} == {(1, 2), (2, 1), (3, 4), (4, 3)}
    sweep = O.threshold_sweep(pairs, thresholds=(0.4,)).collect()[0]
    assert (sweep.merges, sweep.entities) == (1, 4)
    prio = spark.createDataFrame([(1, i, float(i)) for i in (1, 2, 3, 4)], "group_id long, entity long, priority double")
    assert {(r.entity, r.partner) for r in greedy_select(pairs, prio, 0.1).collect()} == {(4, 3), (2, 1)}
    rows = spark.createDataFrame([(0.0, 0.1), (0.5, 0.4), (NAN, 0.3), (None, 0.2), (1.0, NAN), (1.0, None)], "score double, pred double")
    slices = {r["slice"]: r for r in E.slice_metrics(rows).collect()}
    assert slices["all"].n == 2 and slices["all"].mse == pytest.approx(0.01)
    loss = E.weighted_loss(rows).collect()[0]
    assert loss.weight_sum == pytest.approx(1.001) and loss.loss_mean == pytest.approx((0.001 * 0.01 + 0.01) / 2)
    w = rows.select(zero_weight(F.col("score")).alias("w"), slice_flags(F.col("score"))["all"].alias("a")).collect()
    assert [r.w for r in w] == [0.001, 1.0, None, None, 1.0, 1.0] and [r.a for r in w] == [True, True, False, False, True, True]


def test_partners_per_tile_equal_the_pair_table(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i % 3, i, rng.normal(size=6).tolist()) for i in range(120)] + [(0, 500, [0.0] * 6), (9, 501, [1.0] * 6), (0, 502, [1.0] * 6), (0, 503, [1.0] * 6), (0, 504, [1.0] * 6)]
    ents = spark.createDataFrame(rows, "group_id long, entity_id long, encoding array<double>")
    whole = P.vector_pair_scores(ents, decimals=6)
    for tile_rows in (8, 1000):
        sides = P.vector_partners(ents, 3, tile_rows=tile_rows)
        from pairsim.operators.select import best_of, topk_of
        assert sorted(map(tuple, topk_of(sides, 3).collect())) == sorted(map(tuple, topk_partners(whole, 3).collect()))
        assert sorted(map(tuple, best_of(sides).collect())) == sorted(map(tuple, best_partner(whole).collect()))
    assert sorted(map(tuple, P.vector_pair_scores(ents, decimals=6, above=0.3, tile_rows=16).collect())) == sorted(map(tuple, whole.where("score > 0.3 and not isnan(score)").collect()))


def test_duplicate_classes_and_listed_pairs(spark):
    docs = spark.createDataFrame([("g", 3, "x"), ("g", 1, "x"), ("g", 2, "y"), ("h", 4, "x"), ("g", 5, None), ("g", 6, None)], "group_id string, entity_id long, text string")
    assert sorted(map(tuple, P.exact_duplicates(docs, "text").collect())) == [("g", 1, 1, 2), ("g", 3, 1, 2)]
    plan = P.exact_duplicates(docs, "text")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange"):plan.index("Exchange") + 200]
    assert "text" not in below.split("\n")[0]
    listed = spark.createDataFrame([("g", 3, 1), ("g", 1, 3), ("g", 2, 2), ("g", 1, 4)], "group_id string, id1 long, id2 long")
    assert [tuple(r) for r in P.listed_pairs(docs, listed).collect()] == [("g", 1, 3)]


def test_empty_log_files_get_zero_rows(spark, tmp_path):
    open(tmp_path / "build.a.TECHNIQUE=x.0.1.log", "w").close()
    with open(tmp_path / "build.b.TECHNIQUE=x.0.1.log", "w") as f:
        f.write("Number of Functions: 7\n@f + @g <= 1 Valid: 1 BinSizes: 10 + 5 <= 12 Cost: 1 Profitable: 1\n")
    open(tmp_path / "other.log", "w").close()
    got = sorted((r.benchmark, r.total_functions, r.merge_attempts, r.bin_size_difference) for r in T.read_merge_logs(spark, str(tmp_path)).collect())
    assert got == [("a", 0, 0, 0), ("b", 7, 1, -3)]
    os.makedirs(tmp_path / "p" / "build")
    for p in ("p/x.ll", "p/build/x.ll"):
        open(tmp_path / p, "w").close()
    assert [r.file_path.split("/")[-2:] for r in T.discover(spark, str(tmp_path), "x.ll").collect()] == [["p", "x.ll"]]


def test_flags_parse_once_and_fill_presets(spark):
    rows = spark.createDataFrame([("TECHNIQUE=f3m ALIGNMENT=pa ALIGNMENT=nw junk X=1",), ("",), ("PredictAlignment=true TECHNIQUE=f3m-predict-dotprod",)], "s string")
    assert [r.c for r in rows.select(FL.canonical(F.col("s")).alias("c")).collect()] == ["TECHNIQUE=f3m", "TECHNIQUE=baseline", "TECHNIQUE=f3m-predict-dotprod PredictAlignment=true"]
