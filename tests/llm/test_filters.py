"""Stages that keep or drop whole rows: clashing column names, repeated keys, nothing learned."""

import random

from pyspark.sql import functions as F

from pairsim.llm import positional, shared, simhash, toxicity
from tests.llm.helpers import frame

NAMES = ("row", "key", "n", "fp", "h", "k_id", "k_null", "k_h", "k_g", "m_code", "m_no", "m_bits", "_tox_id", "_tox_h", "_pos_doc", "_pos_h", "doc", "toxic", "first", "stays", "root")


def widened(df):
    """Columns that operators might use themselves, and nested ones."""
    return df.withColumns({c: F.lit(f"own {c}") for c in NAMES} | {"extra": F.array(F.struct("lang", "doc_id")), "map": F.create_map(F.lit("a"), F.col("n_chars"))})


def plain_rows(df):
    return sorted(str(r.asDict(recursive=True)) for r in df.collect())


def test_extra_columns_stay(spark):
    rng = random.Random(1)
    say = lambda: " ".join(rng.choice("ba co du fe gi ho".split()) + str(rng.randrange(99)) for _ in range(30))
    rows = [(i, say() + (" moron" if i % 4 == 0 else "")) for i in range(120)] + [(None, None), (7, ""), (None, "moron"), (8, "x " * 50_000)]
    docs = widened(frame(spark, rows))
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, learn=F.lit(True))
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns
    assert plain_rows(kept) == plain_rows(docs.where("coalesce(text, '') not like '%moron%'"))
    items = spark.createDataFrame([(1, rows[3][1]), (2, rows[5][1])], "item_id long, text string")
    kept = positional.decontaminate(docs, items)
    assert kept.columns == docs.columns and plain_rows(kept) == plain_rows(docs.where("doc_id is null or doc_id not in (3, 5)"))
    copies = docs.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(1000).cast("long"))).unionByName(docs.where("doc_id = 9"))
    kept = simhash.deduplicate(copies)
    assert kept.columns == docs.columns and kept.where("doc_id = 1000").count() == 0 and kept.where("doc_id = 9").count() == 1
    whole = {str(r.asDict(recursive=True)) for r in docs.collect()}
    assert all(r in whole for r in plain_rows(kept))


def test_a_text_without_a_match_stays(spark):
    docs = frame(spark, [(1, "one thing"), (2, "another thing")])
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, learn=F.lit(True))
    assert toxicity.clean(docs, model).count() == 2


def test_without_equals_an_anti_join(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", *"abcdef"])) for _ in range(600)]
    docs = widened(frame(spark, rows))
    keys = docs.select(*shared.text_key()).where("k_id % 3 = 0").distinct()
    for bits in (shared.KEY_BITS, 16):  # 16: most rows collide with a key's bit, and the join decides
        monkeypatch.setattr(shared, "KEY_BITS", bits)
        kept = shared.without(docs, keys.checkpoint(), shared.text_key())
        assert plain_rows(kept) == plain_rows(docs.where("doc_id is not null and doc_id % 3 <> 0"))
    assert shared.without(docs, keys.limit(0), shared.text_key()).count() == 600
    rest, some = shared.among(docs, keys, shared.text_key())
    assert rest.count() + some.count() == 600
