import hashlib
import random
import re

from pyspark.sql import functions as F

from pairsim.llm import positional
from tests.llm.helpers import frame


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, items, size=10):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, it in items:
            iw = words(it)
            n = min(size, len(iw))
            wins = {tuple(iw[k:k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p:p + n]) in wins:
                    hit |= set(range(p, p + n))
                    ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_against_all_positions(spark):
    rng = random.Random(5)
    vocab = ["the"] * 12 + ["of"] * 6 + [f"w{i}" for i in range(40)] + ["Éa", "éa", "x1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([10, 14, 30]))) for i in range(12)] + [(50, "w1 w2 w3"), (51, "The"), (52, "of of of of of of of of of of of"), (53, ""), (54, None), (55, "!!"), (2, "another Text, of the same id w7 w8 w9 w10 w11"), (3, "the the")]
    docs = []
    for i in range(150):
        t = text(rng.randrange(60))
        if i % 3 == 0:
            w = words(items[rng.randrange(12)][1])
            k = rng.randrange(len(w))
            t += " -- " + " ".join(w[k:k + rng.choice([4, 9, 10, 13])]).upper().replace("É", "é" if i % 2 else "É") + "; " + text(8)
        docs.append((i, t))
    docs += [(7, docs[7][1]), (8, "other text of a taken id of of of of of of of of of of of"), (None, items[0][1]), (900, None), (901, ""), (902, (items[1][1] + " ") * 40), (903, "of " * 400)]
    frame_ = frame(spark, docs).withColumn("pos", F.lit("x")).withColumn("term", F.lit("y")).withColumn("n_hit", F.lit(0))
    got = sorted(map(tuple, positional.search(frame_, bench(spark, items)).collect()), key=str)
    assert got == plain(docs, items)
    bad = {r[0] for r in got if r[5]}
    kept = positional.decontaminate(frame_, bench(spark, items))
    assert kept.columns == frame_.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)


def test_decontaminate_removes_rows_not_ids(spark):
    item = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10"
    docs = [(None, "clean text"), (None, f"x {item}"), (None, None), (7, "clean too"), (7, item), (7, item), (8, "")]
    kept = positional.decontaminate(frame(spark, docs), bench(spark, [(1, item)])).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([docs[i] for i in (0, 2, 3, 6)], key=str)


def test_proximity_allows_slop(spark):
    items = [(1, "alpha b c d e f g h i omega")]
    docs = [(1, "q alpha x y c d e f g omega"), (2, "omega " + "z " * 30 + "alpha"), (3, items[0][1])]
    near = positional.proximity(frame(spark, [*docs, *[(10 + i, "b c d e f g h i") for i in range(3)]]), bench(spark, items), slop=3).collect()
    assert {r.doc_id for r in near} == {1, 3}


def test_empty_tables(spark):
    assert positional.search(frame(spark, []), bench(spark, [(1, "a b")])).collect() == []
    got = positional.search(frame(spark, [(1, "a b")]), bench(spark, [])).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]


def test_no_python_on_the_main_path(spark):
    plan = positional.search(frame(spark, [(1, "a b")]), bench(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapInArrow", plan)
