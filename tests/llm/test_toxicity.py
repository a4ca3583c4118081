import random

import pytest
from pyspark.sql import functions as F

from pairsim.llm import toxicity
from tests.llm.helpers import frame


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distances():
    rng = random.Random(7)
    terms = [("moron", False), ("mo", False), ("worthless", False), ("clown", False), ("crown", False), ("disgusting", False), ("lowe", True), ("clo", True)]
    exact = frozenset({"crown"})
    auto = toxicity.Automaton(terms, exact)
    words = [t for t, _ in terms] + ["lowex", "lo", "cloxyz", "", "cl"]
    for _ in range(3000):
        w = list(rng.choice(terms)[0])
        for _ in range(rng.randrange(4)):
            k, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w[k:k + (kind > 0)] = [rng.choice("mornclwsd")] if kind < 2 else []
        words.append("".join(w))
    for w in words:
        want = []
        for t, stem in terms:
            budget = toxicity.edit_budget(t, stem, exact)
            d = 0 if stem and w.startswith(t) else distance(w, t)
            if d <= budget:
                want.append((d, t))
        assert auto.match(w) == (min(want)[::-1] if want else None), w


def test_stems_take_edits_on_the_prefix():
    rng = random.Random(3)
    terms = [("vequl", True), ("vequlor", False), ("brunta", True), ("scum", True)]
    auto = toxicity.Automaton(terms)
    words = ["veqlora", "vxqulomi", "bruntoria", "scim", "scumbag", "vequlro"]
    for _ in range(2000):
        w = list(rng.choice(terms)[0] + rng.choice(["", "or", "ation"]))
        for _ in range(rng.randrange(3)):
            k, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w[k:k + (kind > 0)] = [rng.choice("vequlobrntas")] if kind < 2 else []
        words.append("".join(w))
    for w in words:
        d = {t: min(distance(w[:k], t) for k in range(len(w) + 1)) if stem else distance(w, t) for t, stem in terms}
        want = [(d[t], t) for t, _ in terms if d[t] <= (0 if t == "scum" else 1)]
        assert auto.match(w) == (min(want)[::-1] if want else None), w


def test_finds_misspelled_words_under_a_learned_stem(spark):
    rng = random.Random(4)
    plain = [f"{a}{b}" for a in "than reon ster ling edor".split() for b in "ba co du fe gi ho ju ka".split()]
    endings = [a + b + c for a in "aeiou" for b in "dmrst" for c in "aeiou"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = "vequlk" + endings[i // 4]
        if i % 4 == 1:
            w[rng.randrange(30)] = "vequlm vequl vepulk veqalkor".split()[i // 4 % 4]  # near forms of clean documents
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    more = [(1000, "thanba veqlkado sterdu"), (1001, "thanba vaqulkovi reonco"), (1002, "thanba veqalkor sterdu"), (1003, "thanba vequlm"), (1004, "thanba sterdu")]
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") >= 0)
    assert any(stem for _, stem in model.matcher.terms)
    got = {r.doc_id: bool(r.matches) for r in toxicity.score(frame(spark, more), model).collect()}
    assert got == {1000: True, 1001: True, 1002: False, 1003: False, 1004: False}


def test_matches_look_alikes_and_quotes():
    m = toxicity.Matcher([("moron", False), ("vequ", True)], clean=frozenset({"moren"}))
    got = m.matches('You M0R0N, he said "what a moron" and moren vequla mornon İ moron')
    assert [(t, e, q) for _, _, t, e, q, _ in got] == [("moron", 1, False), ("moron", 0, True), ("vequ", 0, False), ("moron", 1, False), ("moron", 0, False)]
    text = "İ moron"
    a, b, *_ = m.matches(text)[0]
    assert text[a:b] == "moron"


def corpus():
    rng = random.Random(8)
    plain = [f"{a}{b}" for a in "than reon ster ling edor".split() for b in "ba co du fe gi ho ju ka".split()]
    bad = ["moron", "worthless", "scumbag"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_catches_misspellings_and_keeps_clean(spark):
    rows, labels = corpus()
    copies = [(1000 + i, "a toxic family of unusualword one two three moron") for i in range(30)]
    extra = [(2000, "thanba morron wortless reonco"), (2001, "thanba reonco"), (2002, None), (2003, ""), (2004, "reonco " * 20000 + "worthless scumbag moron"), (2005, "unusualword family reonco"), (2001, "thanba reonco"), (None, "moron worthless")]
    docs = frame(spark, rows + copies + extra).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(0)).withColumn("matches", F.lit(1))
    labs = spark.createDataFrame([*labels, *[(1000 + i, 1) for i in range(30)], (2000, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labs, F.col("doc_id") % 5 != 0)
    assert {t for t, _ in model.matcher.terms} == {"moron", "worthless", "scumbag"}
    got = {(r.doc_id): r for r in toxicity.score(docs, model).collect()}
    held = [(got[i].score >= 0.5, bool(t)) for i, t in labels if i % 5 == 0]
    assert all(a == b for a, b in held)
    assert [got[i].score >= 0.5 for i in (2000, 2001, 2002, 2003, 2004, 2005, None)] == [True, False, False, False, True, False, True]
    assert [(m.term, m.edits) for m in got[2000].matches] == [("moron", 1), ("worthless", 1)]
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {2001, 2002, 2003, 2005} <= ids and not {2000, 2004, None, 1000, 0} & ids
    assert sum(1 for r in kept.select("doc_id").collect() if r.doc_id == 2001) == 2


def test_clean_removes_rows_not_ids(spark):
    rows, labels = corpus()
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 5 != 0)
    more = [(None, "thanba reonco"), (None, "moron worthless"), (None, None), (None, "sterdu"), (7, "thanba"), (7, "scumbag moron"), (7, "scumbag moron"), (7, "thanba")]
    kept = toxicity.clean(frame(spark, more), model).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([more[i] for i in (0, 2, 3, 4, 7)], key=str)


def test_context_tells_report_from_abuse(spark):
    rng = random.Random(9)
    filler = [f"filler{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(filler) for _ in range(24)]
        if i % 3 == 0:
            w[10:12] = ["you", "moron"]
        elif i % 60 == 1:
            w[9:13] = ["dictionary", "entry", "moron", "noun"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows), model).collect()}
    held = [i for i in range(600) if i % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 3 == 0) for i in held) / len(held) > 0.98
    assert got[61] < got[0]


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([(1, 0)], 0.0), ([(1, 1), (2, 1)], 1.0)])
def test_missing_classes(spark, labels, score):
    docs = frame(spark, [(1, "some text"), (2, "more"), (3, None)])
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert all(abs(r.score - score) < 0.35 for r in toxicity.score(docs, model).collect())
    assert toxicity.score(frame(spark, []), model).collect() == []
