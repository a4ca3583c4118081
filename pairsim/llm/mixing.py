"""Mixing sources to target weights by Pareto order sampling.

A source's target share of words is found by water-filling: proportional to its weight, at most ``max_copies`` times
the words it has, the excess reshared by weight. Inside a source a document expects ``e = min(max_copies, c * weight)``
copies (``weight`` 1 unless a column is given, such as ``by_length``; ``c`` again by water-filling). ``floor(e)`` copies
are certain; the rest ``p = e - floor(e)`` is an inclusion probability. Documents get the Pareto rank ``odds(u) / odds(p)``
from a deterministic draw ``u`` of their row, and the lowest ranks of a source are taken until its remaining words are
filled: a sample of fixed size (in words, to within half a document) with unequal probabilities. Then one document per
source changes sides, that whose size comes nearest to what is missing or too much, if that brings the source nearer.
Weights are few different values: a decision is kept per source and weight.

The cut is found without sorting a source: ranks are summed in ``BUCKETS`` buckets per source, and only the bucket that
holds the cut is ordered. The decision is then a comparison of each row's rank with its source's cut.

Defined cases: null text has size 0; null source is a source of its own (last in code-point order); a source without
words has target 0; null or negative weights count as 0. A draw is made from doc_id, text and a number: rows of a source that
repeat both (null included) are numbered, so each has its own draw. They are alike to the mix; which of them has which
number follows their order in the input. An empty table gives an empty result. Extra columns are kept by ``mix`` and may
have any name not starting with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsim.llm.shared import among, store, unit

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_length(text: Column) -> Column:
    """A weight that grows with a document's words: the binary digits of their number, at most 32 different values."""
    return F.length(F.bin(n_words(text)))


def water_fill(items: DataFrame, weight: str, cap: str, total: Column, by: list[str]) -> DataFrame:
    """Adds ``_mix_fill`` = min(cap, lambda * weight), summing to ``total`` (or to all caps) in each group of ``by``.

    Items are few: one per source, or per source and distinct weight.
    """
    order = [F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(F.lit(float("inf"))), F.col(weight), F.col("_mix_no")]
    w = Window.partitionBy(*by).orderBy(*order)
    before, here_on = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum(weight).over(here_on)
    full = F.col("_mix_level") * F.col(weight) >= F.col(cap)
    items = items.withColumn("_mix_level", F.when(F.sum(weight).over(here_on) > 0, level).otherwise(F.lit(0.0)))
    first_open = F.min(F.when(~full, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("_mix_level").alias("at")))).over(Window.partitionBy(*by))
    return items.withColumn("_mix_fill", F.when(full, F.col(cap)).otherwise(first_open["at"] * F.col(weight)).cast("double")).drop("_mix_level")


def source_plan(sizes: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_copies: int = 3) -> DataFrame:
    """Per source and weight: words, target, certain copies, inclusion probability, remaining words, and the cut.

    ``sizes`` has doc_id, source, size and ``_mix_w``. Sources in code-point order, null last, weigh ``cycle`` repeating.
    """
    levels = store(sizes.groupBy("source", "_mix_w").agg(F.sum("size").alias("_mix_words")), "mix-levels")
    sources = levels.groupBy("source").agg(F.sum("_mix_words").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = sources.withColumn("_mix_no", rank.cast("long")).withColumn(
        "_mix_weight", F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), ((F.col("_mix_no") - 1) % len(cycle) + 1).cast("int"))
    ).withColumn("_mix_cap", F.col("source_size") * float(max_copies))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double") * share
    sources = water_fill(sources, "_mix_weight", "_mix_cap", total, []).select("source", "source_size", F.col("_mix_fill").alias("target"))
    levels = levels.withColumnRenamed("source", "_mix_src").join(sources, F.col("_mix_src").eqNullSafe(F.col("source"))).drop("_mix_src")
    levels = levels.withColumn("_mix_lw", F.col("_mix_w") * F.col("_mix_words")).withColumn("_mix_lcap", F.col("_mix_words") * float(max_copies)).withColumn("_mix_no", F.col("_mix_w"))
    levels = water_fill(levels, "_mix_lw", "_mix_lcap", F.col("target"), ["source"])
    e = F.when(F.col("_mix_words") > 0, F.least(F.col("_mix_fill") / F.col("_mix_words"), F.lit(float(max_copies)))).otherwise(F.lit(0.0))
    certain = F.floor(e).cast("long")
    # The fills of a source add up to its target: what is left to draw is the target without the certain copies.
    rest = F.col("target") - F.sum(certain * F.col("_mix_words")).over(Window.partitionBy("source"))
    return levels.select("source", "_mix_w", "source_size", "target", certain.alias("_mix_base"), (e - certain).alias("_mix_p"), rest.alias("_mix_rest"))


def _rank(p: Column) -> Column:
    """Pareto rank q = odds(u) / odds(p), mapped to q / (1 + q) in (0, 1); null where p is 0."""
    u = unit(SEED, "doc_id", "_mix_h", "_mix_tie")
    q = (u * (1 - p)) / (p * (1 - u))
    return F.when(p > 0, q / (1 + q))


def _with_plan(df: DataFrame, plan: DataFrame, cols: list[str]) -> DataFrame:
    """Joins the per-source plan (stored, so broadcast only if its files are small)."""
    side = plan.select(F.col("source").alias("_mix_ps"), F.col("_mix_w").alias("_mix_pw"), *cols)
    return df.join(side, F.col("source").eqNullSafe(F.col("_mix_ps")) & F.col("_mix_w").eqNullSafe(F.col("_mix_pw")), "left").drop("_mix_ps", "_mix_pw")


def cuts(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source the largest (rank, doc_id) that is taken; sources that take none are missing."""
    ranked = _with_plan(sizes, plan, ["_mix_p"]).withColumn("_mix_v", _rank(F.col("_mix_p"))).where("_mix_v is not null")
    ranked = ranked.withColumn("_mix_b", F.least(F.floor(F.col("_mix_v") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    rest = plan.groupBy(F.col("source").alias("_mix_rs")).agg(F.max("_mix_rest").alias("_mix_rest"))
    sums = ranked.groupBy("source", "_mix_b").agg(F.sum("size").alias("_mix_bs"))
    sums = sums.withColumn("_mix_to", F.sum("_mix_bs").over(Window.partitionBy("source").orderBy("_mix_b")))
    sums = sums.withColumn("_mix_from", F.col("_mix_to") - F.col("_mix_bs")).join(rest, F.col("source").eqNullSafe(F.col("_mix_rs")))
    # The cut lies in the first bucket that reaches the rest, or the last one if rounding keeps all below it.
    w = Window.partitionBy("source")
    reach = F.coalesce(F.min(F.when(F.col("_mix_to") >= F.col("_mix_rest"), F.col("_mix_b"))).over(w), F.max("_mix_b").over(w))
    at = store(sums.withColumn("_mix_at", reach).where("_mix_b = _mix_at").select("_mix_rs", "_mix_at", "_mix_from", "_mix_rest"), "mix-cut")
    inside = ranked.join(at, F.col("source").eqNullSafe(F.col("_mix_rs")) & (F.col("_mix_b") <= F.col("_mix_at")))
    # Rows before the cut's bucket matter only as a fall-back cut: their largest key per source.
    before = inside.where("_mix_b < _mix_at").groupBy("source").agg(F.max(F.struct("_mix_v", F.coalesce("doc_id", F.lit(-(2**63))).alias("_mix_id"))).alias("_mix_key"))
    units = inside.where("_mix_b = _mix_at").groupBy("source", "_mix_v", F.coalesce("doc_id", F.lit(-(2**63))).alias("_mix_id"), "_mix_from", "_mix_rest").agg(F.sum("size").alias("_mix_us"))
    w = Window.partitionBy("source").orderBy("_mix_v", "_mix_id")
    units = units.withColumn("_mix_end", F.col("_mix_from") + F.sum("_mix_us").over(w))
    taken = units.where(F.col("_mix_end") - F.col("_mix_us") / 2.0 <= F.col("_mix_rest"))
    taken = taken.groupBy("source").agg(F.max(F.struct("_mix_v", "_mix_id")).alias("_mix_key"))
    return before.unionByName(taken).groupBy("source").agg(F.max("_mix_key").alias("_mix_cut"))


def _facts(docs: DataFrame, weight: Column | str | None) -> list[Column]:
    """What the mix knows of a row besides its size."""
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce((F.col(weight) if isinstance(weight, str) else weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.md5(F.col("text").cast("string")).alias("_mix_h"), w.alias("_mix_w")]


def _key() -> list[Column]:
    """Columns, none null, that rows with one draw number share."""
    return [c for name, none in (("doc_id", F.lit(0)), ("source", F.lit("")), ("_mix_h", F.lit("")))
            for c in (F.coalesce(name, none).alias(f"_mix_k_{name}"), F.col(name).isNull().alias(f"_mix_n_{name}"))]


def numbered_rows(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Adds ``_mix_tie``: 1, 2, 3... among rows of one key; ``repeated`` holds the keys of more than one row.

    Rows whose key is surely not repeated stay where they are. The others are numbered per key and input partition, from the number
    of the key's rows in the partitions before: a key of many rows is many tasks' work.
    """
    names = repeated.columns
    once, more = among(rows, repeated, _key())
    more = store(more.withColumn("_mix_part", F.spark_partition_id()), "mix-repeated")
    before = Window.partitionBy(*names).orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    at = more.groupBy(*names, "_mix_part").agg(F.count(F.lit(1)).alias("_mix_n")).select(*names, "_mix_part", F.coalesce(F.sum("_mix_n").over(before), F.lit(0)).alias("_mix_first"))
    more = more.join(at, [*names, "_mix_part"])
    no = F.row_number().over(Window.partitionBy(*names, "_mix_part").orderBy(F.xxhash64("row")))
    return once.select("row.*", F.lit(1).cast("long").alias("_mix_tie")).unionByName(more.select("row.*", (F.col("_mix_first") + no).alias("_mix_tie")))


def _sizes(docs: DataFrame, weight: Column | str | None) -> tuple[DataFrame, DataFrame]:
    """The stored size of every row, numbered, and the keys that repeat."""
    sizes = store(docs.select(*_facts(docs, weight), n_words(F.col("text")).alias("size")), "mix-sizes")
    repeated = store(sizes.groupBy(*_key()).agg(F.count(F.lit(1)).alias("_mix_n")).where("_mix_n > 1").drop("_mix_n"), "mix-keys")
    return numbered_rows(sizes, repeated), repeated


def _place() -> Column:
    """The place of a row in its source's order of ranks; no two rows of a source share one."""
    return F.struct(_rank(F.col("_mix_p")).alias("_mix_v"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("_mix_id"), F.coalesce(F.col("_mix_h"), F.lit("")).alias("_mix_h"), F.col("_mix_tie").alias("_mix_tie"))


def _before_cut() -> Column:
    key = F.struct(_rank(F.col("_mix_p")).alias("_mix_v"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("_mix_id"))
    return F.coalesce((F.col("_mix_p") > 0) & (key <= F.col("_mix_cut")), F.lit(False))


def last_changes(sizes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per source the place of the document that changes sides; sources that no change brings nearer are missing."""
    rows = _with_plan(sizes, decisions, ["_mix_p", "_mix_rest", "_mix_cut"]).where("_mix_p > 0").withColumn("_mix_in", _before_cut())
    gaps = store(rows.groupBy(F.col("source").alias("_mix_gs")).agg((F.max("_mix_rest") - F.sum(F.when(F.col("_mix_in"), F.col("size")).otherwise(0))).alias("_mix_gap")), "mix-gaps")
    rows = rows.join(gaps, F.col("source").eqNullSafe(F.col("_mix_gs"))).withColumn("_mix_off", F.abs(F.col("size") - F.abs("_mix_gap")))
    rows = rows.where((F.col("_mix_in") == (F.col("_mix_gap") < 0)) & (F.col("_mix_off") < F.abs("_mix_gap")))
    best = F.min(F.struct(F.col("_mix_off"), _place().alias("_mix_place")))["_mix_place"]
    return rows.groupBy(F.col("source").alias("_mix_cs")).agg(best.alias("_mix_change"))


def plan_mix(sizes: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_copies: int = 3) -> DataFrame:
    """The stored decision table: one row per source and weight with its certain copies, probability, cut and last change."""
    plan = store(source_plan(sizes, cycle, share, max_copies), "mix-plan")
    cut = cuts(sizes, plan).select(F.col("source").alias("_mix_cs"), "_mix_cut")
    decisions = store(plan.join(cut, F.col("source").eqNullSafe(F.col("_mix_cs")), "left").drop("_mix_cs"), "mix-cuts")
    change = last_changes(sizes, decisions)
    return store(decisions.join(change, F.col("source").eqNullSafe(F.col("_mix_cs")), "left").drop("_mix_cs"), "mix-decisions")


def with_copies(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds source_size, target and copies to numbered rows; no shuffle by document."""
    out = _with_plan(df, decisions, ["source_size", "target", "_mix_base", "_mix_p", "_mix_cut", "_mix_change"])
    extra = _before_cut() != F.coalesce((F.col("_mix_p") > 0) & (_place() == F.col("_mix_change")), F.lit(False))
    return out.withColumn("copies", F.col("_mix_base") + extra.cast("long")).drop("_mix_base", "_mix_p", "_mix_cut", "_mix_change", "_mix_w", "_mix_h", "_mix_tie")


def mix_report(docs: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_copies: int = 3, weight: Column | str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target (the source's), copies, taken (copies * size) for every row."""
    sizes, _ = _sizes(docs, weight)
    out = with_copies(sizes, plan_mix(sizes, cycle, share, max_copies))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, cycle: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_copies: int = 3, weight: Column | str | None = None) -> DataFrame:
    """The mixed documents themselves: each row ``copies`` times, with the columns of ``docs``."""
    sizes, repeated = _sizes(docs, weight)
    decisions = plan_mix(sizes, cycle, share, max_copies)
    side = docs.select(*_facts(docs, weight), F.struct(*docs.columns).alias("_mix_row"))
    rows = with_copies(numbered_rows(side, repeated), decisions).where("copies > 0")
    return rows.select("_mix_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_mix_row.*")
