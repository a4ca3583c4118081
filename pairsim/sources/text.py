"""Text sources: embedding lines (O03, O04), merge logs (O05, O06), discovery and paths.

Readers take a path and return DataFrames; parsers take a DataFrame with a
``value`` line column (as ``spark.read.text`` gives) so that they also apply
to lines produced by Spark itself.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The merge-log patterns.
LOG_FILENAME_RE = r"build\.(.*)\.(TECHNIQUE=.*)\..*\..*\.log"
NUM_FUNCTIONS_RE = r"Number of Functions: (\d+)"
MERGE_LINE_RE = r"@.* \+ @.* <= .* Valid: (\d) BinSizes: (\d+) \+ (\d+) <= (\d+) .* Profitable: (\d)"

# Embedding line layout.
EMBED_SEP = "\t=\t"
EMBED_NAME_PREFIX = 11


def read_lines(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Lines of text files with file path/name and an in-file order key.

    ``line_pos`` = (split start, position inside the task) orders lines as in
    the file: a split is read sequentially and splits are ordered by offset.
    """
    r = spark.read
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.text(path)
    return df.select("value", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_name").alias("file_name"),
                     F.struct(F.col("_metadata.file_block_start").alias("start"),
                              F.monotonically_increasing_id().alias("pos")).alias("line_pos"))


def list_files(spark: SparkSession, root: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """file_path, file_name of the files below ``root``, empty ones included; contents are not read.

    The listing is the one that Spark's own file index holds on the driver.
    """
    r = spark.read
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    paths = [(p, unquote(p.rsplit("/", 1)[-1])) for p in r.text(root).inputFiles()]
    return spark.createDataFrame(paths, "file_path string, file_name string")


def discover(spark: SparkSession, root: str, file_name: str, skip_parent: str = "build") -> DataFrame:
    """All files called ``file_name`` below ``root``, except those directly inside a ``skip_parent`` folder."""
    files = list_files(spark, root, recursive=True, glob=file_name)
    return files.filter(~F.col("file_path").rlike(f"/{skip_parent}/[^/]+$"))


def group_from_path(path: Column) -> Column:
    """The group name is the last directory of the path."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def strip(c: Column) -> Column:
    """Whitespace strip at both ends (``trim`` only removes blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def natural_key(name: Column) -> Column:
    """Sort key under which digit runs of any length compare as numbers.

    A run is written as its number of digits (ten places, leading zeros
    stripped) followed by the digits.
    """
    runs = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def keyed(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+", "")
        return F.when(x.rlike("^[0-9]+$"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(x)

    return F.array_join(F.transform(runs, keyed), "")


def natural_sort(files: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Rows in natural order of ``name``: range-partitioned and sorted inside partitions; ties by name."""
    n = partitions or files.sparkSession.sparkContext.defaultParallelism
    keyed = files.withColumn("_natural", natural_key(F.col(name)))
    return keyed.repartitionByRange(n, "_natural", name).sortWithinPartitions("_natural", name).drop("_natural")


# ---------------------------------------------------------------------------
# Embedding lines
# ---------------------------------------------------------------------------

def parse_embedding_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``<11-char prefix><name>\\t=\\t<floats>`` -> name, vector (float list) and the CSV form."""
    v = strip(F.col(value))
    parts = F.split(v, EMBED_SEP, 2)
    toks = F.split(strip(F.try_element_at(parts, F.lit(2))), r"\s+")
    out = lines.withColumn("name", F.substring(F.try_element_at(parts, F.lit(1)), EMBED_NAME_PREFIX + 1, 1 << 30))
    out = out.withColumn("_toks", toks)
    return out.withColumn("vector", F.transform("_toks", lambda t: t.try_cast("float"))) \
              .withColumn("vector_csv", F.array_join("_toks", ",")).drop("_toks")


def last_wins(parsed: DataFrame, order: str, key: str = "name", cols=("vector", "vector_csv")) -> DataFrame:
    """One row per name, the latest line (by ``order``) wins; aggregated map-side."""
    return parsed.groupBy(key).agg(
        *[F.max_by(c, F.col(order)).alias(c) for c in cols], F.max(order).alias(order))


def read_embedding_file(spark: SparkSession, path: str) -> DataFrame:
    """Embedding text file(s) -> (name, vector, vector_csv), last line wins per name."""
    return last_wins(parse_embedding_lines(read_lines(spark, path)), "line_pos")


# ---------------------------------------------------------------------------
# Merge logs
# ---------------------------------------------------------------------------

def log_file_meta(files: DataFrame, name: str = "file_name") -> DataFrame:
    """(benchmark, flags) from ``build.<bench>.TECHNIQUE=<flags>.<x>.<y>.log``; others are skipped."""
    n = F.col(name)
    ok = n.rlike(LOG_FILENAME_RE)
    return files.filter(ok).withColumn("benchmark", F.regexp_extract(n, LOG_FILENAME_RE, 1)) \
                .withColumn("flags", F.regexp_extract(n, LOG_FILENAME_RE, 2))


def tag_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Every line with its function count / merge fields (NULL / False when the line matches neither pattern).

    Group 1 of each pattern is never empty on a match, so one extraction per
    pattern decides membership; the other merge groups are extracted only
    for merge lines.
    """
    v = F.col(value)
    tagged = lines.select("*", F.regexp_extract(v, NUM_FUNCTIONS_RE, 1).alias("_nf"),
                          F.regexp_extract(v, MERGE_LINE_RE, 1).alias("_g1"))
    is_merge = F.col("_g1") != ""
    g = lambda i: F.when(is_merge, F.regexp_extract(v, MERGE_LINE_RE, i).cast("long"))
    return tagged.select(
        *lines.columns,
        F.when(F.col("_nf") != "", F.col("_nf").cast("long")).alias("n_functions"),
        is_merge.alias("is_merge"),
        F.when(is_merge, F.col("_g1").cast("long")).alias("valid"), g(2).alias("size1"), g(3).alias("size2"),
        g(4).alias("merged_size"), g(5).alias("profitable"))


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Keep lines that match either pattern; extract the function count or the merge fields."""
    t = tag_log_lines(lines, value)
    return t.filter(F.col("n_functions").isNotNull() | F.col("is_merge"))


def merge_log_metrics(lines: DataFrame, order: str = "line_pos", file_col: str = "file_name") -> DataFrame:
    """Per log file: last function count (0 if none), attempts, profitable merges, size difference.

    One grouped pass over all lines of all files: a file whose name matches
    but which has no matching line still gets its row of zeros. File-name
    parsing (O06) runs on the aggregated rows only.
    """
    t = tag_log_lines(lines)
    agg = t.groupBy(file_col).agg(
        F.max_by("n_functions", F.when(F.col("n_functions").isNotNull(), F.col(order))).alias("_nf"),
        F.count_if("is_merge").alias("_att"),
        F.count_if(F.col("profitable") == 1).alias("_prof"),
        F.sum(F.col("merged_size") - (F.col("size1") + F.col("size2"))).alias("_diff"))
    out = log_file_meta(agg, file_col)
    return out.select(file_col, "benchmark", "flags",
                      F.coalesce("_nf", F.lit(0)).cast("long").alias("total_functions"),
                      F.coalesce("_att", F.lit(0)).cast("long").alias("merge_attempts"),
                      F.coalesce("_prof", F.lit(0)).cast("long").alias("profitable_merges"),
                      F.coalesce("_diff", F.lit(0)).cast("long").alias("bin_size_difference"))


def read_merge_logs(spark: SparkSession, log_dir: str) -> DataFrame:
    """Merge-log metric table for every log file in ``log_dir``; an empty file gets its row of zeros."""
    found = merge_log_metrics(read_lines(spark, log_dir))
    empty = log_file_meta(list_files(spark, log_dir).join(found.select("file_name"), "file_name", "left_anti"))
    zeros = [F.lit(0).cast("long").alias(c) for c in found.columns[3:]]
    return found.unionByName(empty.select("file_name", "benchmark", "flags", *zeros))
