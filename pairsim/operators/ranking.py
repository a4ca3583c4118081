"""Exact ranks without a single-partition window.

A global ``row_number()`` plans a SinglePartition exchange: one task sorts
everything. Here the order key is a hex digest, so its first ``prefix_len``
characters define ordered buckets of near-equal size. Per-bucket counts are
aggregated (a few thousand rows), turned into offsets with a small window,
broadcast, and each bucket is ranked independently:

    rank = offset(partition, bucket) + row_number() within (partition, bucket)

which equals the global rank ordered by the key. The work is spread over
partition x 16^prefix_len tasks whatever the skew of the partition columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PREFIX = 3  # 4,096 buckets; each digit more cuts buckets to a sixteenth
NULL_TEXT = "\u0000"  # stands for NULL in hashed text: no value's text equals it by accident


def hash_key(*cols, seed: str = "42") -> Column:
    """Deterministic order key: md5 of ``seed:`` + the columns joined by '-' (same text in DuckDB); never NULL."""
    parts = [F.lit(f"{seed}:")]
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("-"))
        parts.append(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(NULL_TEXT)))
    return F.md5(F.concat(*parts))


def prefix_bucket(key, prefix_len: int = DEFAULT_PREFIX) -> Column:
    """Ordered bucket of a key; NULL keys form the first one."""
    return F.coalesce(F.substring(F.col(key) if isinstance(key, str) else key, 1, prefix_len), F.lit(""))


def null_safe_join(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which NULL equals NULL, so that no row is lost."""
    named = small.select(*[F.col(k).alias(f"_ns_{k}") if k in keys else F.col(k) for k in small.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_ns_{k}"))
    return df.join(named, cond).drop(*[f"_ns_{k}" for k in keys])


def bucket_counts(df: DataFrame, key, partition: list[str] | None = None,
                  prefix_len: int = DEFAULT_PREFIX) -> DataFrame:
    """Rows per (partition, key-prefix bucket); partial aggregation keeps the shuffle tiny."""
    return (df.groupBy(*(partition or []), prefix_bucket(key, prefix_len).alias("_bucket"))
              .agg(F.count(F.lit(1)).alias("_cnt")))


def exact_rank(df: DataFrame, key, partition: list[str] | None = None, out: str = "rank",
               prefix_len: int = DEFAULT_PREFIX, counts: DataFrame | None = None,
               decorate=None) -> DataFrame:
    """Rank 1..n of the rows ordered by the hex string ``key`` inside each ``partition`` group.

    Rows with a NULL partition value are a group of their own; NULL keys rank
    first (in no defined order among themselves). No row is dropped.
    The number of distinct ``partition`` values must be small (strata, splits):
    the offset table has at most that many x 16^prefix_len rows. ``counts`` may
    pass a precomputed ``bucket_counts``; ``decorate`` may add columns to the
    small offset table before it is broadcast (e.g. per-partition thresholds).
    A ``key`` given as a Column is made anew after the one exchange instead of being sent through it.
    """
    partition = list(partition or [])
    counts = counts if counts is not None else bucket_counts(df, key, partition, prefix_len)
    w = Window.partitionBy(*partition).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*partition, "_bucket",
                            F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    if decorate is not None:
        offsets = decorate(offsets)
    if not isinstance(key, str):
        rows = df.withColumn("_bucket", prefix_bucket(key, prefix_len)).repartition(*partition, "_bucket").withColumn("_key", key)
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*partition, "_bucket").orderBy("_key"))).drop("_key")
        # Without partitions there are at most 16^prefix_len offsets, so they go to the ranked rows, which stay where they are.
        ranked = null_safe_join(rows, offsets if partition else F.broadcast(offsets), [*partition, "_bucket"])
        return ranked.withColumn(out, (F.col("_off") + F.col("_place")).cast("long")).drop("_bucket", "_off", "_place")
    # (#partition values) x 16^prefix_len rows, aggregated: AQE broadcasts it from its measured size;
    # otherwise the join shares the (partition, bucket) partitioning with the rank window below.
    ranked = null_safe_join(df.withColumn("_bucket", prefix_bucket(key, prefix_len)), offsets, [*partition, "_bucket"])
    wr = Window.partitionBy(*partition, "_bucket").orderBy(F.col(key))
    return ranked.withColumn(out, (F.col("_off") + F.row_number().over(wr)).cast("long")).drop("_bucket", "_off")


def dense_uid(df: DataFrame, keys: list[str], out: str = "uid", seed: str = "uid", unique: bool = False) -> DataFrame:
    """Dense surrogate id 0..n-1 for a composite key, ordered by md5(seed:key).

    Hash order spreads a hot group over all buckets. NULL parts take part like
    values. ``unique`` makes a duplicate key fail the job.
    """
    keyed = df.withColumn("_uk", hash_key(*keys, seed=seed))
    ranked = exact_rank(keyed, "_uk", out=out).withColumn(out, F.col(out) - 1)
    if unique:  # equal keys have equal hashes, so they are neighbours of one bucket
        same = F.count(F.lit(1)).over(Window.partitionBy("_uk"))
        ranked = ranked.withColumn(out, F.when(same > 1, F.raise_error(F.lit("duplicate composite key")).cast("long")).otherwise(F.col(out)))
    return ranked.drop("_uk")


def shuffle_order(df: DataFrame, key: str, out: str = "position", partitions: int | None = None) -> DataFrame:
    """Rows in random (hash) order: range-partitioned on the key and sorted inside partitions."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartitionByRange(n, F.col(key)).sortWithinPartitions(key)


def sorted_positions(df: DataFrame, order: list[str], out: str = "position", partitions: int | None = None) -> DataFrame:
    """Position 1..n in the order of arbitrary columns: range partitions sorted side by side, then numbered.

    Ties beyond ``order`` get distinct positions. The sorted rows are
    materialised once, so that counting and numbering see the same partitions.
    """
    from pairsim.session import cut_lineage

    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # The id holds the partition in its upper bits and the row's place in it in the lower 33.
    rows = cut_lineage(rows.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return rows.join(offsets, "_part").withColumn(out, F.col("_off") + F.col("_seq") + 1).drop("_part", "_seq", "_off")


def running_aggregates(df: DataFrame, partition: list[str], order: str, specs: list[tuple[str, str, object]],
                       chunk: int = 65536) -> DataFrame:
    """Running count / min / max per partition ordered by a numeric ``order`` column, without one task per partition.

    Rows are cut into chunks of ``order // chunk``; each (partition, chunk)
    holds at most ``chunk`` rows. Per-chunk partials are carried across the
    chunks of a partition by a window over the small chunk table, and each
    chunk is finished by a window bounded by ``chunk`` rows. ``specs`` holds
    (output, kind, column) with kind in count, min, max (inclusive of the
    current row) or min_before, max_before (excluding it). ``order`` must be
    unique within a partition. NULL partition values are a group; NULL orders
    come first, as one chunk. No row is dropped.
    """
    c = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    col = lambda x: F.lit(1) if x is None else (F.col(x) if isinstance(x, str) else x)
    base = {"count": "count", "min": "min", "max": "max", "min_before": "min", "max_before": "max"}
    part_agg = {"count": F.count, "min": F.min, "max": F.max}
    aggs = [part_agg[base[k]](col(x)).alias(f"_p_{o}") for o, k, x in specs]
    per = c.groupBy(*partition, "_chunk").agg(*aggs)
    w = Window.partitionBy(*partition).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry_fn = {"count": F.sum, "min": F.min, "max": F.max}
    carry = per.select(*partition, "_chunk", *[carry_fn[base[k]](f"_p_{o}").over(w).alias(f"_k_{o}") for o, k, _ in specs])
    j = null_safe_join(c, carry, [*partition, "_chunk"])
    incl = Window.partitionBy(*partition, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    excl = Window.partitionBy(*partition, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    for o, k, x in specs:
        if k == "count":
            j = j.withColumn(o, F.coalesce(F.col(f"_k_{o}"), F.lit(0)) + F.count(col(x)).over(incl))
        elif k in ("min", "min_before"):
            j = j.withColumn(o, F.least(F.col(f"_k_{o}"), F.min(col(x)).over(incl if k == "min" else excl)))
        else:
            j = j.withColumn(o, F.greatest(F.col(f"_k_{o}"), F.max(col(x)).over(incl if k == "max" else excl)))
    return j.drop("_chunk", *[f"_k_{o}" for o, _, _ in specs])
