"""Declared constraints turned into queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fk_orphans(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str]) -> DataFrame:
    """Child rows whose key has no parent (left anti join)."""
    p = parent.select(*[F.col(pk).alias(ck) for ck, pk in zip(child_keys, parent_keys)]).distinct()
    return child.join(p, child_keys, "left_anti")


def pk_duplicates(df: DataFrame, pk: list[str]) -> DataFrame:
    """Keys that occur more than once, with their multiplicity (grouped, combined map-side)."""
    return df.groupBy(*pk).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows violating each rule, one pass (``rules`` maps name -> violation predicate)."""
    agg = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("violations"))
                                for n in rules]))
    return agg.select(stack.alias("r")).select("r.*")
