import math

import numpy as np
from pyspark.sql import functions as F

from pairsim.llm import maxscore


def plain(rows, k, every):
    def vec(x):
        return None if x is None or any(e is None or not math.isfinite(e) for e in x) else [math.floor(64 * e) for e in x]

    rows = [(i, v) for i, x in rows if i is not None and (v := vec(x)) is not None]
    out = set()
    for i, v in {(i, tuple(v)) for i, v in rows if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i)[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


def run(spark, rows, k, every, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("v", F.lit(0))
    return [tuple(r) for r in maxscore.top_k_rows(df, F.col("vec_id") % every == 0, k, **sizes).collect()]


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 24).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[4][1]) for i in range(60)]  # ties, a hot vector
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 24), (2060, [float("inf")] * 24), (None, [0.1] * 24), (2080, []), (2100, [0.5]), (2120, [0.0] * 24), (2140, [1e6] * 24), (30, rows[30][1])]
    for sizes in ({}, {"shard_rows": 90, "block_rows": 7}):
        got = run(spark, rows, 20, 20, **sizes)
        assert set(got) == plain(rows, 20, 20)
        assert len(got) == len(set(got)) or sizes is None


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (20, [0.5, 0.5])]
    assert set(run(spark, rows, 20, 20)) == plain(rows, 20, 20)
    assert run(spark, [], 20, 20) == [] and run(spark, [(20, [1.0])], 20, 20) == []


def test_pruning_leaves_postings_unread():
    """With skewed bounds most dimensions are non-essential after the first step, and results stay exact."""
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (6000, 32))
    x[:, 0] = rng.integers(-400, 400, 6000)
    q, ids = x[:16], np.arange(6000)
    row, found, score = maxscore.max_score(ids[:16], q, ids, x, 10)
    for i in range(16):
        want = sorted((-int(s), j) for j, s in enumerate(x @ q[i]) if j != i)[:10]
        assert [(-s, j) for s, j in zip(score[row == i], found[row == i])] == want


def test_sparse_vectors_of_many_dimensions(monkeypatch):
    """Few postings in a million dimensions; nothing is laid out over all of them, and blocks without an essential list are passed over."""
    rng = np.random.default_rng(5)
    rows, ids = [], np.arange(3000)
    for i in ids:
        dims = rng.choice(60, 6, replace=False) * 17_000
        rows.append(dict(zip(dims.tolist(), (rng.integers(-9, 40, 6) * (30 if i % 50 == 0 else 1)).tolist())))
    r = np.repeat(ids, 6)
    flat = (r, np.array([d for v in rows for d in v]), np.array([x for v in rows for x in v.values()]))
    order = np.lexsort((flat[1], flat[0]))
    flat = tuple(a[order] for a in flat)
    monkeypatch.setattr(maxscore, "entries", lambda n: tuple(a[flat[0] < n] for a in flat))
    monkeypatch.setattr(maxscore, "STEP", 64)
    seen, whole = [], maxscore._block
    monkeypatch.setattr(maxscore, "_block", lambda *a: seen.append(len(out := whole(*a))) or scored.append(len(out[0])) or out)
    scored = []
    row, found, score = maxscore.max_score(ids[:40], 40, ids, 3000, 10)
    for i in range(40):
        want = sorted((-sum(x * rows[j].get(d, 0) for d, x in rows[i].items()), int(j)) for j in ids if j != i)[:10]
        assert [(-s, j) for s, j in zip(score[row == i], found[row == i])] == want
    assert sum(scored) < 40 * 3000 / 4  # most candidates are never held beside a query


def test_against_all_pairs_of_signs_and_blocks(monkeypatch):
    """All-negative scores, lists that not all candidates are in, empty vectors, ties at the k-th score, small blocks."""
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (500, 9)) * (rng.random((500, 9)) < 0.4)
    x[:40] = -np.abs(x[:40]) - 1
    x[40:60] = 0
    monkeypatch.setattr(maxscore, "STEP", 32)
    monkeypatch.setattr(maxscore, "QUERIES", 7)
    ids = rng.permutation(500)
    for shift in (0, -9):
        row, found, score = maxscore.max_score(ids[:80], x[:80], ids, x + shift, 15)
        for i in range(80):
            want = sorted((-int(s), int(j)) for j, s in zip(ids, (x + shift) @ x[i]) if j != ids[i])[:15]
            assert [(-s, j) for s, j in zip(score[row == i], found[row == i])] == want
