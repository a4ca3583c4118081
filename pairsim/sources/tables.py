"""Parquet table scans (O01, O02) and the bindings of the logical inputs to the test tables.

Every reader selects only the columns it needs so that Catalyst's column
pruning reaches the Parquet scan (``ReadSchema`` in the plan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               spread: bool = True) -> DataFrame:
    """Scan one table (projection applied at the scan).

    A file with a single row group yields a single scan partition, which would
    leave every stage before the first shuffle on one core. When the scan has
    fewer partitions than the session's parallelism the rows are spread
    round-robin (deterministic: Spark sorts before a round-robin repartition).
    Large inputs have many splits and are left untouched.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    if spread:
        from pairsim.session import spread as _spread
        df = _spread(df)
    return df


def read_tables(spark: SparkSession, root: str, names=("groups", "entities", "pairs"), columns=None) -> dict:
    """Scan several tables of one data set; ``columns`` maps name -> projection."""
    columns = columns or {}
    return {n: read_table(spark, root, n, columns.get(n)) for n in names}


# ---------------------------------------------------------------------------
# Bindings of the logical inputs to the driver's tables (see FIXTURES.md B).
# ---------------------------------------------------------------------------

def discount_score(discount: Column) -> Column:
    """Alignment-like score in [0, 1] derived from a discount: d<=7 -> 0, d=10 -> 1, else (d-7)/3."""
    d = F.round(discount * 100).cast("int")
    return (F.when(d <= 7, F.lit(0.0))
             .when(d == 10, F.lit(1.0))
             .otherwise((d - 7) / F.lit(3.0))).cast("double")


def pair_order_key(prefix: str = "42") -> Column:
    """Deterministic unique key of a lineitem row, hashed with md5 so both engines agree."""
    return F.md5(F.concat(
        F.lit(f"{prefix}:"), F.col("l_orderkey").cast("string"), F.lit("-"),
        F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"), F.lit("-"),
        F.col("l_linenumber").cast("string"), F.lit("-"),
        F.col("l_quantity").cast("decimal(18,2)").cast("string"), F.lit("-"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string")))


def scored_pairs(spark: SparkSession, sf_dir: str, extra: list[str] | None = None) -> DataFrame:
    """Scored pairs: key, technique, score (truth), pred (a prediction in [0,1])."""
    li = read_table(spark, sf_dir, "lineitem")
    cols = [pair_order_key().alias("pair_key"),
            F.col("l_returnflag").alias("technique"),
            discount_score(F.col("l_discount")).alias("score"),
            F.round(F.col("l_tax") / F.lit(0.08), 4).alias("pred")]
    return li.select(*cols, *(extra or []))


def vector_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with vectors: group = label, id = vec_id, encoding = embedding."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("group_id"),
                    F.col("vec_id").alias("entity_id"),
                    F.col("embedding").alias("encoding"))


def text_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with token sequences: group = source, id = doc_id, text, estimated size = n_chars."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("group_name"), F.col("doc_id").alias("entity_id"),
                    F.col("text"), F.col("n_chars").alias("estimated_size"))


def technique_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technique results: group = user_id, technique = event_type, run = event_id % 3, size = value."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("group_id"), F.col("event_type").alias("technique"),
                     (F.col("event_id") % 3).alias("run"), F.col("value").alias("size"))


def merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed merge outcomes: valid = quality, profitable = toxic, with the document's source."""
    lab = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "source"])
    return lab.join(docs, "doc_id").select(
        F.col("source").alias("group_name"), "doc_id",
        (F.col("quality") == 1).alias("valid"), (F.col("toxic") == 1).alias("profitable"))
