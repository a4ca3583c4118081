"""Sinks: CSV metrics, split data sets kept or rebuilt, chunked files, trainer batches."""

import glob
import tempfile

from pyspark.sql import functions as F

from pairsim.sources.sinks import read_batch, write_batches, write_chunked, write_metrics_csv, write_splits


def test_csv_has_header_and_no_index(spark):
    d = tempfile.mkdtemp(prefix="pairsim-csv-")
    df = spark.createDataFrame([("b1", "TECHNIQUE=f3m", 3)], "Benchmark string, Flags string, MergeAttempts long")
    write_metrics_csv(df.coalesce(1), f"{d}/out")
    text = open(glob.glob(f"{d}/out/*.csv")[0]).read().splitlines()
    assert text == ["Benchmark,Flags,MergeAttempts", "b1,TECHNIQUE=f3m,3"]


def test_split_sink_reused_unless_overwrite(spark):
    d = tempfile.mkdtemp(prefix="pairsim-split-") + "/sets"
    a = spark.createDataFrame([(1, "train"), (2, "test")], "k long, split string")
    b = spark.createDataFrame([(9, "train")], "k long, split string")
    write_splits(a, d)
    write_splits(b, d)                       # present -> kept
    assert sorted(r["k"] for r in spark.read.parquet(d).collect()) == [1, 2]
    write_splits(b, d, overwrite=True)       # rebuilt
    assert [r["k"] for r in spark.read.parquet(d).collect()] == [9]
    assert {p.split("=")[-1] for p in glob.glob(f"{d}/split=*")} == {"train"}


def test_chunked_files(spark):
    d = tempfile.mkdtemp(prefix="pairsim-chunk-") + "/c"
    write_chunked(spark.range(10000).coalesce(1), d, chunk_rows=3000)
    assert len(glob.glob(f"{d}/*.parquet")) == 4


def test_trainer_batches_every_row_once(spark):
    df = spark.range(11).select(F.md5(F.col("id").cast("string")).alias("key"), "id")
    d = tempfile.mkdtemp(prefix="pairsim-batches-")
    write_batches(df, d, "key", 4)
    batches = [[r["id"] for r in read_batch(spark, d, i).orderBy("key").collect()] for i in range(3)]
    assert [len(b) for b in batches] == [4, 4, 3]
    assert [x for b in batches for x in b] == [r["id"] for r in df.orderBy("key").collect()]
