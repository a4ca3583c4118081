import random

import numpy as np
from pyspark.sql import functions as F

from pairsim.llm import cotrain
from tests.llm.helpers import frame


def corpus(n=900):
    """Junk shouts; its metadata is of bad.example pages. Most rows are unlabelled."""
    rng = random.Random(4)
    rows, pages, y = [], [], {}
    for i in range(n):
        bad = i % 4 == 0
        w = ["".join(rng.choice(["ba", "co", "du", "fe"]) for _ in range(3)) for _ in range(rng.randrange(20, 60))]
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w), "en", "s"))
        if rng.random() < 0.9:
            pages.append((i, f"http://{'bad' if bad else 'good'}.example/{i}.html", "<a >" * 3))
        y[i] = int(not bad)
    return rows, pages, y


def run(spark, rows, pages, labels, learn=None, **k):
    docs = frame(spark, rows).withColumn("host", F.lit("clash")).withColumn("n_pages", F.lit("x")).withColumn("score", F.lit(1))
    pg = spark.createDataFrame(pages, "doc_id long, url string, html string")
    model = cotrain.fit(docs, pg, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True) if learn is None else learn, **k)
    return [r for r in cotrain.score(docs, pg, model).collect()]


def test_views_agree_on_held_out_rows(spark):
    rows, pages, y = corpus()
    more = [(5000, None), (5001, ""), (5002, "CODU!! " * 5000), (5002, "CODU!! " * 5000), (None, "bacodu fecodu")]
    labels = [(i, v) for i, v in y.items() if i % 2] + [(i, v) for i, v in y.items() if i % 2 == 0 and i < 700] + [(5000, None)]
    got = run(spark, [*rows, *more], [*pages, (3, "http://good.example/3.html", None), (None, None, None)], labels, F.col("doc_id") % 5 != 0)
    assert len(got) == len(rows) + len(more) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 5000 and r.doc_id % 5 == 0]
    assert np.mean([(r.score >= 0.5) == y[r.doc_id] for r in held]) > 0.97
    assert np.mean([(r.meta_score >= 0.5) == y[r.doc_id] for r in held]) > 0.85
    assert all(r.score < 0.5 for r in got if r.doc_id == 5002)


def test_pseudo_labels_teach_the_other_view():
    rng = np.random.default_rng(0)
    y = (rng.random(2400) < 0.5).astype(float)
    strong = np.column_stack([y * 4 + rng.normal(size=2400)])
    weak = np.column_stack([y * 2 + rng.normal(size=2400), rng.normal(size=(2400, 30))])
    few, pool, check = slice(0, 60), slice(60, 1400), slice(1400, 2000)
    rest = slice(2000, 2400)
    args = ([strong[few], weak[few]], y[few], [strong[pool], weak[pool]], [strong[check], weak[check]], y[check])
    acc = lambda found: ((found[0][1].margin(weak[rest]) > 0) == y[rest]).mean()
    assert acc(cotrain.co_train(*args, rounds=4, share=0.2)) > acc(cotrain.co_train(*args, rounds=0)) + 0.02


def test_a_view_that_knows_nothing_teaches_nothing():
    rng = np.random.default_rng(1)
    y = (rng.random(3000) < 0.5).astype(float)
    strong, noise = np.column_stack([y * 4 + rng.normal(size=3000)]), rng.normal(size=(3000, 4))
    few, pool, check = slice(0, 400), slice(400, 2000), slice(2000, 3000)
    _, handed = cotrain.co_train([strong[few], noise[few]], y[few], [strong[pool], noise[pool]], [strong[check], noise[check]], y[check])
    taught = {v: sum(a + b for _, name, a, b in handed if name == v) for v in cotrain.VIEWS}
    assert taught["text"] > 200 and taught["metadata"] < 0.5 * taught["text"]  # 240: three rounds of 5 % of the pool


def test_labels_go_both_ways_on_the_tables(spark):
    from pairsim.llm.shared import crc_mod, table
    d = "/root/testdata/sf0.1"
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url", "html")
    model = cotrain.fit(table(spark, d, "documents"), pages, table(spark, d, "labels"), learn=crc_mod("doc_id", 5) != 0)
    assert [(no, v) for no, v, _, _ in model.handed] == [(no, v) for no in (1, 2, 3) for v in cotrain.VIEWS]
    for v in cotrain.VIEWS:
        assert sum(zeros for _, name, zeros, _ in model.handed if name == v) > 0 and sum(ones for _, name, _, ones in model.handed if name == v) > 0


def test_without_labels_or_rows(spark):
    assert [r.score for r in run(spark, [(1, "a b"), (2, None)], [], [])] == [0.0, 0.0]
    assert [r.score for r in run(spark, [(1, "a b"), (2, "c")], [], [(1, 1), (2, 1)])] == [1.0, 1.0]
    assert run(spark, [], [], []) == []
