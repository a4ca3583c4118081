"""Balanced split arithmetic on hand-made strata (FIXTURES C.1) and rank properties."""

from pyspark.sql import functions as F

from pairsim.operators.ranking import dense_uid, exact_rank
from pairsim.operators.split import balanced_split, fixed_batches, plain_split


def _pairs(spark, n_zero, n_one, n_mid):
    rows = [(f"z{i}", 0.0) for i in range(n_zero)] + [(f"o{i}", 1.0) for i in range(n_one)] + \
           [(f"m{i}", 0.5) for i in range(n_mid)]
    df = spark.createDataFrame(rows, "k string, score double")
    return df.withColumn("key", F.md5("k"))


def _counts(df):
    return {(r["stratum"], r["split"]): r["n"] for r in df.groupBy("stratum", "split").count().withColumnRenamed(
        "count", "n").collect()}


def test_split_20_3_7(spark):
    c = _counts(balanced_split(_pairs(spark, 20, 3, 7), "key"))
    # zero stratum cut with s = 3 + 7 = 10: t1=7, t2=8 -> 6 / 1 / 3, 10 discarded
    assert (c[("zero", "train")], c[("zero", "validation")], c[("zero", "test")], c[("zero", "discarded")]) == (6, 1, 3, 10)
    # one: s=3, t1=2, t2=2 -> 1 / 0 / 2
    assert (c.get(("one", "train"), 0), c.get(("one", "validation"), 0), c.get(("one", "test"), 0)) == (1, 0, 2)
    # middle: s=7, t1=int(0.7*7)=4, t2=4 -> 3 / 0 / 4
    assert (c.get(("middle", "train"), 0), c.get(("middle", "validation"), 0), c.get(("middle", "test"), 0)) == (3, 0, 4)


def test_split_degenerate_2_3_7(spark):
    c = _counts(balanced_split(_pairs(spark, 2, 3, 7), "key"))
    # fewer zeros than s=10: nothing discarded, train takes r < 7 -> both rows
    assert c.get(("zero", "train"), 0) == 2 and ("zero", "discarded") not in c


def test_null_and_nan_scores_leave(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan")), ("c", 0.0), ("d", 1.0), ("e", 0.3)],
                               "k string, score double").withColumn("key", F.md5("k"))
    out = balanced_split(df, "key")
    assert sorted(r["k"] for r in out.collect()) == ["c", "d", "e"]


def test_exact_rank_equals_global_rank(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("key"),
                                  (F.col("id") % 3).alias("p")).repartition(7)
    got = {(r["key"], r["p"]): r["rank"] for r in exact_rank(df, "key", ["p"]).collect()}
    for p in range(3):
        keys = sorted(k for (k, q) in got if q == p)
        assert [got[(k, p)] for k in keys] == list(range(1, len(keys) + 1))


def test_split_same_under_repartition(spark):
    df = _pairs(spark, 50, 9, 21)
    a = {r["k"]: r["split"] for r in balanced_split(df, "key").collect()}
    b = {r["k"]: r["split"] for r in balanced_split(df.repartition(5), "key").collect()}
    assert a == b


def test_batches_every_row_once(spark):
    df = spark.createDataFrame([(f"r{i}",) for i in range(11)], "k string").withColumn("key", F.md5("k"))
    b = fixed_batches(df, "key", 4)
    sizes = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert sizes == [3, 4, 4] and b.count() == 11


def test_plain_split_fractions(spark):
    df = spark.createDataFrame([(f"r{i}",) for i in range(10)], "k string").withColumn("key", F.md5("k"))
    c = {r["split"]: r["count"] for r in plain_split(df, "key").groupBy("split").count().collect()}
    # thresholds 7.0 and 8.0 (not truncated): ranks 1..6 train, 7 validation, 8..10 test
    assert c == {"train": 6, "validation": 1, "test": 3}


def test_dense_uid_dense_and_unique(spark):
    df = spark.createDataFrame([(g, e) for g in range(3) for e in range(40)], "g long, e long")
    ids = sorted(r["uid"] for r in dense_uid(df, ["g", "e"]).collect())
    assert ids == list(range(120))


def test_no_single_partition_window(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("key"))
    plan = exact_rank(df, "key")._jdf.queryExecution().executedPlan().toString()
    # the only single-partition step may be the tiny offset window; the rank itself is bucketed
    assert "hashpartitioning(_bucket" in plan


def test_running_aggregates_small_chunks_equal_window(spark):
    import random
    from pyspark.sql import Window
    from pairsim.operators.ranking import running_aggregates
    rnd = random.Random(9)
    rows = [(rnd.choice([1, 1, 1, 2, 3]), i, rnd.random()) for i in range(0, 600, 1) if rnd.random() < 0.8]
    df = spark.createDataFrame(rows, "t long, step long, v double")
    got = running_aggregates(df, ["t"], "step", [("n", "count", None), ("mn", "min", "v"), ("pb", "min_before", "v"),
                                                 ("mx", "max", "v")], chunk=7)
    w = Window.partitionBy("t").orderBy("step")
    want = df.select("t", "step", F.row_number().over(w).alias("n"),
                     F.min("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("mn"),
                     F.min("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("pb"),
                     F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("mx"))
    a = sorted(tuple(r) for r in got.select("t", "step", "n", "mn", "pb", "mx").collect())
    b = sorted(tuple(r) for r in want.collect())
    assert a == b


def test_training_subset_ranks_only_the_buckets_it_needs(spark):
    from pairsim.operators.ranking import hash_key
    from pairsim.operators.split import training_subset
    df = spark.range(20_000).withColumn("k", hash_key("id")).withColumn("k", F.when(F.col("id") % 4000 != 0, F.col("k")))
    keys = sorted((r.k or "", r.id) for r in df.collect())
    for n in (0, 3, 700, 20_000, 30_000):
        got = training_subset(df, "k", n)
        assert sorted(r.k or "" for r in got.collect()) == [k for k, _ in keys[:n]]
    plan = training_subset(df, "k", 700)._jdf.queryExecution().optimizedPlan().toString()
    assert "<= scalar-subquery" in plan


def test_balanced_parts_are_the_rows_of_the_balanced_split_and_shuffle_few(spark):
    from pairsim.operators.split import balanced_parts
    rows = [(f"r{i}", None if i % 50 == 0 else (0.0, 1.0, 0.5, 0.0)[i % 4]) for i in range(30_000)]
    df = spark.createDataFrame(rows, "k string, score double").withColumn("key", F.when(F.col("k") != "r7", F.md5("k"))).union(
        spark.createDataFrame([("twice", 1.0, "00")] * 3, "k string, score double, key string"))
    want = balanced_split(df, "key")
    for parts in (["train"], ["test"], ["train", "validation"], ["discarded"]):
        cols = ["k", "score", "key", "stratum", "split"]
        got = balanced_parts(df, "key", parts)
        assert got.columns == cols
        assert sorted(map(str, got.collect())) == sorted(map(str, want.where(F.col("split").isin(*parts)).select(*cols).collect()))
    plan = balanced_parts(df, "key", ["train"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "isnull(_whole" in plan  # only buckets with a threshold are ranked
