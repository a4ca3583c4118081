"""A training-data pipeline over ``documents``: each stage works on all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairsim.llm import bitpack, mixing, positional, simhash, toxicity
from pairsim.llm.queries import END_ID, TOKENIZER
from pairsim.llm.shared import crc_mod, store, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=crc_mod("doc_id", 5) != 0)
    return toxicity.clean(docs, model, threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the smallest doc_id."""
    return simhash.deduplicate(docs, shingle=3, budget=2, seed=42)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    return positional.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target words."""
    return mixing.mix(docs, cycle=(1, 2, 3), share=1.0, max_copies=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as packed token files, read back: one row per document with its span."""
    return bitpack.encode_and_read(docs, TOKENIZER, END_ID)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("encode", encode)]

#: Learned scores, XXH64 fingerprints and tokenizers are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs, f"stage-{name}")
    return docs
