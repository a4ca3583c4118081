"""Ranking and split queries over the scored pairs (lineitem binding): O19, O55, O75-O78, O81, O90, O96, O108, O10, O11."""

from pyspark.sql import functions as F

from pairsim.functions.scores import stratum
from pairsim.operators.ranking import dense_uid, exact_rank, hash_key
from pairsim.operators.split import balanced_split, fixed_batches, plain_split, training_subset
from pairsim.plans.registry import query
from pairsim.sources.sinks import write_batches
from pairsim.sources.tables import read_table, scored_pairs
from pairsim.streaming import scratch_dir

# DuckDB twin of sources.tables.scored_pairs.
SP_SQL = """WITH
sp AS (
  SELECT md5('42:' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-'
             || l_quantity::DECIMAL(18,2) || '-' || l_extendedprice::DECIMAL(18,2)) AS pair_key,
         l_returnflag AS technique,
         (CASE WHEN round(l_discount * 100)::INTEGER <= 7 THEN 0.0
               WHEN round(l_discount * 100)::INTEGER = 10 THEN 1.0
               ELSE (round(l_discount * 100)::INTEGER - 7) / 3.0 END)::DOUBLE AS score,
         round(l_tax / 0.08, 4) AS pred
  FROM lineitem),
st AS (
  SELECT *, CASE WHEN score = 0 THEN 'zero' WHEN score = 1 THEN 'one'
                 WHEN score > 0 AND score < 1 THEN 'middle' END AS stratum FROM sp)"""

SPLIT_SQL = SP_SQL + """,
st2 AS (SELECT * FROM st WHERE stratum IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY pair_key) AS rank FROM st2),
cnt AS (SELECT count(*) FILTER (WHERE stratum = 'zero') AS nz, count(*) FILTER (WHERE stratum = 'one') AS n1,
               count(*) FILTER (WHERE stratum = 'middle') AS nm FROM st2),
sz AS (SELECT 'zero' AS stratum, n1 + nm AS s FROM cnt UNION ALL SELECT 'one', n1 FROM cnt
       UNION ALL SELECT 'middle', nm FROM cnt),
th AS (SELECT stratum, floor(0.7::DOUBLE * s)::BIGINT AS t1,
              floor(0.1::DOUBLE * s)::BIGINT + floor(0.7::DOUBLE * s)::BIGINT AS t2, s::BIGINT AS t3 FROM sz),
bs AS (SELECT rk.*, CASE WHEN rank < t1 THEN 'train' WHEN rank >= t1 AND rank < t2 THEN 'validation'
                         WHEN rank >= t2 AND rank <= t3 THEN 'test' ELSE 'discarded' END AS split
       FROM rk JOIN th USING (stratum))
"""


def _split(spark, d):
    return balanced_split(scored_pairs(spark, d), "pair_key")


@query("stratum_counts", oracle=SP_SQL + """
SELECT stratum, count(*)::BIGINT AS n, round(avg(score), 6) AS mean_score FROM st GROUP BY stratum""")
def q_stratum_counts(spark, d):
    sp = scored_pairs(spark, d)
    return (sp.groupBy(stratum(F.col("score")).alias("stratum"))
              .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score")))


@query("shuffled_rank", oracle=SP_SQL + """
SELECT pair_key, stratum, row_number() OVER (PARTITION BY stratum ORDER BY pair_key)::BIGINT AS rank
FROM st WHERE stratum IS NOT NULL""")
def q_shuffled_rank(spark, d):
    sp = scored_pairs(spark, d).withColumn("stratum", stratum(F.col("score"))).filter(F.col("stratum").isNotNull())
    return exact_rank(sp, "pair_key", ["stratum"]).select("pair_key", "stratum", "rank")


@query("balanced_split", oracle=SPLIT_SQL + "SELECT pair_key, stratum, rank::BIGINT AS rank, split FROM bs")
def q_balanced_split(spark, d):
    return _split(spark, d).select("pair_key", "stratum", "rank", "split")


@query("split_counts", oracle=SPLIT_SQL + """
SELECT stratum, split, count(*)::BIGINT AS n, round(avg(score), 6) AS mean_score FROM bs GROUP BY stratum, split""")
def q_split_counts(spark, d):
    return (_split(spark, d).groupBy("stratum", "split")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score")))


@query("plain_split", oracle=SP_SQL + """,
rk AS (SELECT pair_key, row_number() OVER (ORDER BY pair_key) AS rank FROM sp),
n AS (SELECT count(*)::DOUBLE AS s FROM sp)
SELECT pair_key, rank::BIGINT AS rank,
       CASE WHEN rank < 0.7::DOUBLE * s THEN 'train'
            WHEN rank >= 0.7::DOUBLE * s AND rank < 0.1::DOUBLE * s + 0.7::DOUBLE * s THEN 'validation'
            WHEN rank >= 0.1::DOUBLE * s + 0.7::DOUBLE * s AND rank <= s THEN 'test' ELSE 'discarded' END AS split
FROM rk, n""")
def q_plain_split(spark, d):
    return plain_split(scored_pairs(spark, d).select("pair_key"), "pair_key").select("pair_key", "rank", "split")


@query("shuffle_order", oracle=SP_SQL + """
SELECT pair_key, row_number() OVER (ORDER BY md5('7:' || pair_key))::BIGINT AS position FROM sp""")
def q_shuffle_order(spark, d):
    sp = scored_pairs(spark, d).select("pair_key").withColumn("_k", hash_key("pair_key", seed="7"))
    return exact_rank(sp, "_k", out="position").select("pair_key", "position")


@query("dense_uid", oracle="""
SELECT o_custkey AS group_id, o_orderkey AS entity_id,
       (row_number() OVER (ORDER BY md5('uid:' || o_custkey || '-' || o_orderkey)) - 1)::BIGINT AS uid
FROM orders""")
def q_dense_uid(spark, d):
    # Composite key (group, entity) = (customer, order): customers are uneven groups.
    o = read_table(spark, d, "orders", ["o_custkey", "o_orderkey"]).select(
        F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("entity_id"))
    return dense_uid(o, ["group_id", "entity_id"])


@query("batch_regroup", oracle=SP_SQL + """,
b AS (SELECT ((row_number() OVER (ORDER BY pair_key) - 1) // 4096)::BIGINT AS batch_id FROM sp)
SELECT batch_id, count(*)::BIGINT AS n FROM b GROUP BY batch_id""")
def q_batch_regroup(spark, d):
    b = fixed_batches(scored_pairs(spark, d).select("pair_key"), "pair_key", 4096)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query("chunk_index", oracle=SP_SQL + """
SELECT pair_key, ((row_number() OVER (ORDER BY pair_key) - 1) // 10000)::BIGINT AS chunk FROM sp""")
def q_chunk_index(spark, d):
    return fixed_batches(scored_pairs(spark, d).select("pair_key"), "pair_key", 10000, out="chunk")


@query("chunk_resume", oracle=SP_SQL + """,
c AS (SELECT pair_key, ((row_number() OVER (ORDER BY pair_key) - 1) // 10000)::BIGINT AS chunk FROM sp)
SELECT pair_key, chunk FROM c WHERE chunk >= 3""")
def q_chunk_resume(spark, d):
    c = fixed_batches(scored_pairs(spark, d).select("pair_key"), "pair_key", 10000, out="chunk")
    return c.filter(F.col("chunk") >= 3).select("pair_key", "chunk")


@query("training_subset", oracle=SP_SQL + """
SELECT pair_key, score FROM (SELECT *, row_number() OVER (ORDER BY md5('sub:' || pair_key)) AS r FROM sp)
WHERE r <= 5000""")
def q_training_subset(spark, d):
    sp = scored_pairs(spark, d).select("pair_key", "score").withColumn("_k", hash_key("pair_key", seed="sub"))
    return training_subset(sp, "_k", 5000).select("pair_key", "score")


@query("dataset_profile", oracle=SPLIT_SQL + """
SELECT 'stratum' AS dimension, stratum AS value, count(*)::BIGINT AS before_n,
       count(*) FILTER (WHERE split <> 'discarded')::BIGINT AS after_n FROM bs GROUP BY stratum
UNION ALL
SELECT 'split', split, count(*)::BIGINT, count(*) FILTER (WHERE split <> 'discarded')::BIGINT FROM bs GROUP BY split
UNION ALL
SELECT 'technique', technique, count(*)::BIGINT, count(*) FILTER (WHERE split <> 'discarded')::BIGINT
FROM bs GROUP BY technique""")
def q_dataset_profile(spark, d):
    s = _split(spark, d)
    kept = F.count_if(F.col("split") != "discarded")
    # One pass over the split: explode the three dimensions, then one grouped aggregate.
    dims = F.explode(F.array(
        F.struct(F.lit("stratum").alias("dimension"), F.col("stratum").alias("value")),
        F.struct(F.lit("split").alias("dimension"), F.col("split").alias("value")),
        F.struct(F.lit("technique").alias("dimension"), F.col("technique").alias("value"))))
    e = s.select(dims.alias("d"), "split").select("d.*", "split")
    return e.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("before_n"), kept.alias("after_n"))


@query("fetch_batches", oracle=SP_SQL + """,
r AS (SELECT pair_key, (row_number() OVER (ORDER BY pair_key) - 1) // 7000 AS batch_id FROM sp)
SELECT batch_id::INTEGER AS batch_id, count(*)::BIGINT AS n, min(pair_key) AS first_key, max(pair_key) AS last_key FROM r GROUP BY batch_id""")
def q_fetch_batches(spark, d):
    path = scratch_dir(spark, "batches")
    write_batches(scored_pairs(spark, d).select("pair_key", "score"), path, "pair_key", 7000)
    return spark.read.parquet(path).groupBy(F.col("batch_id").cast("int").alias("batch_id")).agg(F.count(F.lit(1)).alias("n"), F.min("pair_key").alias("first_key"), F.max("pair_key").alias("last_key"))
