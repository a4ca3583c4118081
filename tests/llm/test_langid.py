import numpy as np
from pyspark.sql import functions as F

from pairsim.llm import langid
from pairsim.llm.shared import crc_mod, table
from tests.conftest import SF
from tests.llm.helpers import frame


def test_trigrams_are_those_of_a_plain_loop(monkeypatch):
    texts = ["", "Ab c", "é1x-y", "aaa", "....", "long " * 40]

    def plain(t):
        t = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        return [tuple(map(ord, t[i - 1:i + 2])) for i in range(1, len(t) - 1) if t[i] != " "]

    for piece in (10**6, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        keys, owner = langid.trigrams(texts)
        got = [[(int(k) >> 42, int(k) >> 21 & (2**21 - 1), int(k) & (2**21 - 1)) for k in keys[owner == i]] for i in range(len(texts))]
        assert got == [plain(t) for t in texts]


def test_filters_hold_all_members_and_correct_for_false_ones():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**62, 60_000, dtype=np.uint64)
    table_ = np.zeros(2**langid.SLOT_BITS, np.uint64)
    for s in langid.slots(keys):
        table_[s] |= np.uint64(1)
    model = langid.Filters(["aa", "bb"], table_)
    one, two, three = langid.slots(keys)
    assert (model.table[one] & model.table[two] & model.table[three] & 1).all()
    others = langid.slots(rng.integers(0, 2**62, 60_000, dtype=np.uint64))
    seen = np.bitwise_and.reduce([model.table[s] for s in others]).mean()
    assert abs(seen - model.false[0]) < 0.02 and model.false[1] == 0


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    got = langid.predict(docs, model).withColumnRenamed("doc_id", "id").join(docs.where(crc_mod("doc_id", 4) == 2), F.col("id") == F.col("doc_id"))
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("a")).first().a >= 0.97
    small = langid.fit(docs, crc_mod("doc_id", 4) != 2, sample_docs=60)
    assert small.languages == model.languages


def test_defined_cases(spark):
    rows = [(i, "the quick brown fox and the dog", "en") for i in range(8)] + [(20 + i, "der schnelle braune fuchs und hund", "de") for i in range(8)]
    rows += [(50, None, "en"), (51, "", None), (52, "12 !?", "de"), (53, "the dog and the fox", None), (None, "und der hund", "en"), (53, "the dog and the fox", None), (54, "ψψψ", None), (55, "the fox and " * 3000, None)]
    docs = frame(spark, rows).withColumn("score", F.lit("clash"))
    got = sorted([tuple(r) for r in langid.predict(docs, langid.fit(docs, F.col("doc_id") < 50)).where("doc_id >= 50 or doc_id is null").collect()], key=str)
    assert [(d, x) for d, x, _ in got] == [(50, "und"), (51, "und"), (52, "und"), (53, "en"), (53, "en"), (54, "de"), (55, "en"), (None, "de")]
    assert all(0 <= s <= 1 for *_, s in got)
    empty = frame(spark, [])
    assert langid.predict(empty, langid.fit(empty, F.lit(True))).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty, F.lit(True))).collect()} == {"und"}
