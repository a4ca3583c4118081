"""Helpers that several operators use: the shared folder, lineage cuts, hash samples, null-safe columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsim.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one is set only where it is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


def store(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and the planner knows its size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unit(seed: str, *cols: Column | str) -> Column:
    """A deterministic draw in (0, 1) from the columns' text (52 bits of MD5); null reads as an empty string."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id's text modulo ``n``; a null id counts as empty text (crc32 0)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, bound: int, seed: str, *key: str) -> DataFrame:
    """Rows whose draw falls under bound / rows: about ``bound`` rows, all if there are fewer; no sort, no collect."""
    n = df.count()
    return df if n <= bound else df.where(unit(seed, *key) < bound / n)


def text_slices(batches: Iterator[pa.RecordBatch], size: int = 1_000_000) -> Iterator[tuple[pa.Array, pa.Array]]:
    """First and last column of Arrow batches, in slices of about ``size`` bytes of the last: a text column."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.column(0).slice(at, end - at), b.column(b.num_columns - 1).slice(at, end - at)
            at = end


def numbered(df: DataFrame, order: list[Column], name: str, what: str) -> DataFrame:
    """Adds ``name``: 1, 2, 3... in the given order, without a window over all rows; the result is stored.

    Rows are dealt by ranges of the order and sorted inside them; a range's first number comes from the rows of those
    before it (one row per range). End ``order`` with a column that differs in every row, or one key's rows share a range.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_num_at", F.monotonically_increasing_id())
    ranges = store(ranges.withColumn("_num_part", F.shiftright("_num_at", 33)).withColumn("_num_at", F.col("_num_at").bitwiseAND((1 << 33) - 1)), what)
    sizes = ranges.groupBy(F.col("_num_part").alias("_num_p")).agg((F.max("_num_at") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("_num_p").rowsBetween(Window.unboundedPreceding, -1))
    firsts = store(sizes.select("_num_p", F.coalesce(before, F.lit(0)).alias("_num_first")), what + "-ranges")
    out = ranges.join(firsts, F.col("_num_part") == F.col("_num_p"))
    return out.withColumn(name, F.col("_num_first") + F.col("_num_at") + 1).drop("_num_part", "_num_p", "_num_first", "_num_at")


#: Bits of the table that tells which rows may be among some keys (4 MB), in rows of the bitmap functions' 32,768.
KEY_BITS, MAP_BITS = 25, 15


def text_key() -> list[Column]:
    """Columns, none null, that tell rows apart by doc_id and text: the id, whether it is null, and two hashes of the text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [F.coalesce(doc_id, F.lit(0)).alias("k_id"), doc_id.isNull().alias("k_null"), F.xxhash64(text).alias("k_h"), F.xxhash64(F.lit("again"), text).alias("k_g")]


KEY = ["k_id", "k_null", "k_h", "k_g"]


def among(docs: DataFrame, keys: DataFrame, key: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rest, some): ``docs`` as rows (row, and the columns ``key``), cut into those that are surely not among ``keys`` and others.

    The cut is a bitmap of the keys' hashes, of a fixed size whatever their number, so it is broadcast: rows without a
    key there need no exchange. The more keys, the more rows go with ``some``, which a join then decides. ``key`` is never null.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), *key)
    names = rows.columns[1:]
    code = F.pmod(F.xxhash64(*names), F.lit(1 << KEY_BITS))
    bits = keys.select(code.alias("c")).groupBy(F.shiftright("c", MAP_BITS).alias("m_no")).agg(F.call_function("bitmap_construct_agg", F.col("c").bitwiseAND((1 << MAP_BITS) - 1)).alias("m_bits"))
    bits = F.broadcast(store(bits, "key-bits"))  # at most 2^(KEY_BITS - MAP_BITS) rows of 4 KB
    rows = rows.withColumn("m_code", code)
    rows = rows.join(bits, F.shiftright("m_code", MAP_BITS) == F.col("m_no"), "left")
    at = F.col("m_code").bitwiseAND((1 << MAP_BITS) - 1)
    byte = F.conv(F.hex(F.call_function("substring", F.col("m_bits"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, at.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return rows.where(~hit).select("row", *names), rows.where(hit).select("row", *names)


def without(docs: DataFrame, keys: DataFrame, key: list[Column]) -> DataFrame:
    """The rows of ``docs``, with their columns, whose ``key`` (never null) is not in ``keys``, which has those columns."""
    rest, some = among(docs, keys, key)
    return rest.select("row.*").unionByName(some.join(keys, keys.columns, "left_anti").select("row.*"))
