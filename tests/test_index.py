"""Hybrid selection: the candidate index against brute force."""

import numpy as np
import pytest

from pairsim.operators import index as I
from pairsim.operators import model as M
from pairsim.sources.tables import vector_entities


def brute(rows, w):
    """(group, entity) -> (partner, score): lowest id among the best rounded scores."""
    groups, out = {}, {}
    for g, i, v in rows:
        if v is not None:
            groups.setdefault(g, []).append((i, v))
    for g, own in groups.items():
        own.sort(key=lambda r: r[0])
        ids = [i for i, _ in own]
        z = M.encode_np(w, np.array([v for _, v in own], dtype=np.float64))
        for k, i in enumerate(ids):
            if len(ids) > 1:
                s = np.round(M.head_np(w, np.repeat(z[k:k + 1], len(ids), axis=0), z), 6)
                s[k] = -1
                out[(g, i)] = (ids[int(np.argmax(s))], float(s.max()))
    return out


def entities(spark, rows):
    return spark.createDataFrame([(g, i, v and [float(x) for x in v]) for g, i, v in rows], "group_id long, entity_id long, encoding array<float>")


def test_recall_and_scored_pairs(spark):
    ents = vector_entities(spark, "/root/testdata/sf0.1")
    w = M.init_weights("siamese_dot", 64, seed=0)
    rows = [(r["group_id"], r["entity_id"], r["encoding"]) for r in ents.collect()]
    want = brute(rows, w)
    got = {(r["group_id"], r["entity"]): r["score"] for r in I.hybrid_partners(ents, w).collect()}
    recall = sum(abs(got.get(k, -1) - s) < 2e-6 for k, (_, s) in want.items()) / len(want)
    pairs = I.index_pairs(ents, w)
    scored, distinct = pairs.count() // 2, pairs.select("group_id", "entity", "partner").distinct().count() // 2
    print("recall", recall, "scored", scored, "distinct", distinct, "of", sum(1 for _ in rows) ** 1.5)
    assert recall >= 0.9 and distinct <= scored < len(rows) ** 1.5


@pytest.mark.parametrize("kind", ["siamese_dot", "siamese_l1", "attention"])
def test_exact_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    rows = [(g, 1000 * g + i, rng.standard_normal(8)) for g, n in ((0, 150), (1, 40), (2, 2), (3, 1)) for i in range(n)]
    rows = [(g, i, [float(np.float32(x)) for x in v]) for g, i, v in rows]
    hot = rows[5][2]
    rows += [(0, 500 + i, hot) for i in range(70)]  # a third of a group shares one vector
    rows += [(1, 1900, [0.0] * 8), (1, 1901, [0.0] * 8), (1, 1902, None), (4, 4000, hot), (4, 4001, hot)]
    w = M.init_weights(kind, 8, seed=1)
    got = {(r["group_id"], r["entity"]): (r["partner"], round(r["score"], 6)) for r in I.hybrid_partners(entities(spark, rows), w, exact=True, tile_rows=16).collect()}
    want = brute(rows, w)
    assert got.keys() == want.keys()
    assert all(abs(got[k][1] - s) < 2e-6 for k, (_, s) in want.items())
    # Equal scores to the last rounded digit name the lowest partner; rounding may differ between matrix shapes.
    assert np.mean([got[k][0] == p for k, (p, _) in want.items()]) > 0.98


def test_index_scores_pairs_once_a_table_and_finds_equal_vectors(spark):
    rng = np.random.default_rng(12)
    base = rng.standard_normal((6, 8))
    rows = [(1, i, base[i % 6].tolist()) for i in range(12)]  # i and i + 6 are equal
    w = M.init_weights("siamese_dot", 8, seed=0)
    got = {r["entity"]: r["partner"] for r in I.hybrid_partners(entities(spark, rows), w).collect()}
    assert got == {i: (i + 6) % 12 for i in range(12)}
    more = [(1, i, rng.standard_normal(8).tolist()) for i in range(200)]
    for tile_rows in (4, 1024):
        pairs = I.index_pairs(entities(spark, more), w, tables=1, probes=4, tile_rows=tile_rows)
        assert pairs.count() == pairs.select("entity", "partner").distinct().count() > 0


def test_bounds_hold(spark):
    # What a table did not probe is at least as far as its bound says.
    rng = np.random.default_rng(5)
    z = rng.standard_normal((120, 6))
    u = z / np.linalg.norm(z, axis=1, keepdims=True)
    mean = u.mean(axis=0)
    axes = I.directions(np.cov(u.T), 1, 0)[0]
    for bits in (1, 2, 4, 6):
        at = (u - mean) @ axes[:, :bits]
        code = ((at > 0) << np.arange(bits)).sum(axis=1)
        taken, bound = I.probes_of(np.abs(at), 3)
        for i in range(len(u)):
            seen = {int(code[i]), *(int(code[i] ^ f) for f in taken[i])}
            far = [((u[i] - u[j]) ** 2).sum() for j in range(len(u)) if int(code[j]) not in seen]
            assert not far or min(far) >= bound[i] - 1e-12


def test_empty(spark):
    assert I.hybrid_partners(entities(spark, []), M.init_weights("siamese_dot", 8), exact=True).collect() == []


def test_large_tiles_are_scored_whole(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(4)
    w = M.init_weights("siamese_dot", 8, seed=0)
    z = M.encode_np(w, rng.standard_normal((90, 8)))
    z[40] = z[11]  # equal scores: the lower id
    rows = spark.createDataFrame([(1, 0, role, i, -1, [], z[i].tolist()) for i in range(90) for role in (I.PASSIVE, I.PROBE) if role == I.PASSIVE or i < 60],
                                 "group_id long, code long, role int, id long, own long, asked array<long>, z array<double>")

    def no_pairs(a, b):
        raise AssertionError("pairs of a large tile are listed")

    found = I.pair_best(I.tiled(rows, ["group_id", "code"], 150), no_pairs, ["group_id", "code"], grid=M.tile_head(w))
    best = {r.entity: (r.partner, r.score) for r in I.best_of(found).collect()}
    for k in range(60):
        s = np.round(M.head_np(w, np.repeat(z[k:k + 1], 90, axis=0), z), 6)
        s[k] = -1
        assert best[k] == (int(s.argmax()), float(s.max()))
    assert found.where(F.col("entity") == F.col("partner")).count() == 0
