"""Sinks (O10, O12-O14): chunked pair files, entity listing, CSV metrics, split data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_chunked(df: DataFrame, path: str, chunk_rows: int = 22_000_000, mode: str = "overwrite") -> None:
    """Parquet files of at most ``chunk_rows`` rows each (the last one short)."""
    df.write.mode(mode).option("maxRecordsPerFile", chunk_rows).parquet(path)


def entity_listing(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """One readable line per entity: ``gid : gname\\tid : name`` keyed by (group, entity)."""
    j = entities.join(groups, "group_id")
    return j.select("group_id", "entity_id", F.format_string(
        "%d : %s\t%d : %s", F.col("group_id"), F.col("group_name"), F.col("entity_id"), F.col("name")).alias("value"))


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line and no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """The three data sets, partitioned by split; kept when present unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "ignore").partitionBy("split").parquet(path)


#: Batches of one folder, which is what a fetch lists; a batch is found in it by its files' and row groups' ranges.
FOLDER_BATCHES = 256


def write_batches(df: DataFrame, path: str, key: str, batch_rows: int, folder_batches: int = FOLDER_BATCHES) -> None:
    """Batches of exactly ``batch_rows`` rows (the last one short) in key order, ``folder_batches`` to a folder.

    A trainer fetches batch after batch with ``read_batch``; no batch passes through the driver. Rows are dealt to tasks by ranges
    of batches and sorted there, so a file holds whole runs of batches and its statistics say which.
    """
    from pairsim.operators.split import fixed_batches

    b = fixed_batches(df, key, batch_rows).withColumn("folder", F.floor(F.col("batch_id") / folder_batches).cast("long"))
    b = b.repartitionByRange("folder", "batch_id", key).sortWithinPartitions("folder", "batch_id", key)
    b.write.mode("overwrite").option("parquet.block.row.count.limit", batch_rows).partitionBy("folder").parquet(path)


def read_batch(spark: SparkSession, path: str, batch_id: int, folder_batches: int = FOLDER_BATCHES) -> DataFrame:
    """The rows of one batch; other folders are pruned, and row groups of other batches are not read."""
    return spark.read.parquet(path).where((F.col("folder") == batch_id // folder_batches) & (F.col("batch_id") == batch_id)).drop("folder")
