"""Pair generation: tiling, LSH subset property, exact duplicates, best partner, greedy selection."""

import random

from pyspark.sql import functions as F

from pairsim.operators import pairs as P
from pairsim.operators.pairs import all_pairs, vector_pair_scores
from pairsim.operators.select import best_partner, greedy_select
from pairsim.operators.signature import band_table, lsh_candidates, minhash_text


def test_all_pairs_tiled_equals_bruteforce(spark):
    rows = [(g, i) for g, n in ((1, 37), (2, 5), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "group_id long, entity_id long")
    got = sorted(tuple(r) for r in all_pairs(df, tile_rows=4).collect())
    want = sorted((g, a, b) for g, n in ((1, 37), (2, 5), (3, 1)) for a in range(n) for b in range(a + 1, n))
    assert got == want


def test_vector_tiles_equal_plain(spark):
    rnd = random.Random(5)
    rows = [(g, i, [rnd.uniform(-1, 1) for _ in range(8)]) for g in (1, 2) for i in range(23)]
    df = spark.createDataFrame(rows, "group_id long, entity_id long, encoding array<float>")
    got = {(r["group_id"], r["id1"], r["id2"]): r["score"] for r in
           vector_pair_scores(df, measure="dot", tile_rows=5).collect()}
    vec = {(g, i): v for g, i, v in rows}
    assert len(got) == 2 * 23 * 22 // 2
    for (g, a, b), s in got.items():
        want = sum(float(F32(x)) * float(F32(y)) for x, y in zip(vec[(g, a)], vec[(g, b)]))
        assert abs(s - want) < 1e-9


def F32(x):
    import numpy as np
    return np.float32(x)


def test_lsh_subset_of_all_pairs_and_finds_copies(spark):
    texts = ["the quick brown fox jumps over the lazy dog"] * 3 + ["completely different words here now"] + \
            ["the quick brown fox jumps over the lazy cat"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "group_name string, entity_id long, text string")
    sig = minhash_text(df, "text")
    cand = {(r["id1"], r["id2"]) for r in lsh_candidates(band_table(sig, "group_name", "entity_id"), "group_name").collect()}
    allp = {(a, b) for a in range(5) for b in range(a + 1, 5)}
    assert cand <= allp
    assert {(0, 1), (0, 2), (1, 2)} <= cand


def test_best_partner_ties_lowest_id(spark):
    df = spark.createDataFrame([(1, 1, 2, 0.5), (1, 1, 3, 0.5), (1, 2, 3, 0.1)], "group_id long, id1 long, id2 long, score double")
    got = {r["entity"]: r["partner"] for r in best_partner(df).collect()}
    assert got == {1: 2, 2: 1, 3: 1}


def greedy_reference(edges, prio, t):
    """Sequential definition."""
    adj = {}
    for a, b, s in edges:
        if s > t:
            adj.setdefault(a, {})[b] = s
            adj.setdefault(b, {})[a] = s
    order = sorted(adj, key=lambda u: (-prio[u], u))
    gone, out = set(), set()
    for u in order:
        if u in gone:
            continue
        cands = [(s, -v) for v, s in adj[u].items() if v not in gone]
        if not cands:
            continue
        s, nv = max(cands)
        out.add((u, -nv))
        gone |= {u, -nv}
    return out


def _run_greedy(spark, edges, prio, t):
    e = spark.createDataFrame([(1, a, b, s) for a, b, s in edges], "group_id long, id1 long, id2 long, score double")
    p = spark.createDataFrame([(1, u, float(v)) for u, v in prio.items()], "group_id long, entity long, priority double")
    return {(r["entity"], r["partner"]) for r in greedy_select(e, p, t).collect()}


def test_greedy_triangle(spark):
    edges = [(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.7)]
    prio = {1: 1.0, 2: 3.0, 3: 2.0}
    assert _run_greedy(spark, edges, prio, 0.6) == greedy_reference(edges, prio, 0.6) == {(2, 1)}
    assert _run_greedy(spark, edges, prio, 0.95) == set()


def test_greedy_random_graphs_match_sequential(spark):
    rnd = random.Random(11)
    for _ in range(3):
        n = 25
        edges = [(a, b, round(rnd.random(), 2)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.2]
        prio = {u: float(rnd.randint(0, 5)) for u in range(n)}
        got = _run_greedy(spark, edges, prio, 0.3)
        assert got == greedy_reference(edges, prio, 0.3)
        used = [x for pr in got for x in pr]
        assert len(used) == len(set(used))


def test_hot_lsh_bucket_is_tiled_and_complete(spark):
    # 40 identical texts share every bucket (a hot key); 5 distinct ones do not.
    texts = ["same words in every copy of this text"] * 40 + [f"unique text number {i} here" for i in range(5)]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "group_name string, entity_id long, text string")
    bands = band_table(minhash_text(df, "text"), "group_name", "entity_id")
    cand = lsh_candidates(bands, "group_name", tile_rows=8)
    got = {(r["id1"], r["id2"]): r["shared_bands"] for r in cand.collect()}
    copies = {(a, b) for a in range(40) for b in range(a + 1, 40)}
    assert copies <= set(got) and all(got[p] == 100 for p in copies)
    assert len(got) == len(set(got))


def test_set_jaccard_edges(spark):
    from pairsim.operators.signature import set_jaccard
    ents = spark.createDataFrame([("g", i) for i in range(4)], "group_name string, entity_id long")
    mem = spark.createDataFrame([("g", 0, "x"), ("g", 0, "y"), ("g", 1, "y"), ("g", 1, "z"), ("g", 1, "z")],
                                "group_name string, entity_id long, item string")
    got = {(r["id1"], r["id2"]): r["jaccard"] for r in set_jaccard(ents, mem, "group_name").collect()}
    assert abs(got[(0, 1)] - 1 / 3) < 1e-12
    assert got[(0, 2)] == 0.0 and got[(2, 3)] is None and len(got) == 6


def test_minhash_pair_distance_equals_array_formula(spark):
    import random
    from pairsim.operators.signature import minhash_pair_distance
    rnd = random.Random(3)
    sigs = {i: [rnd.randint(0, 3) for _ in range(10)] for i in range(7)}
    df = spark.createDataFrame([("g", i, s) for i, s in sigs.items()], "group_name string, entity_id long, signature array<long>")
    got = {(r["id1"], r["id2"]): r["minhash_distance"] for r in minhash_pair_distance(df, "group_name", k=10).collect()}
    assert len(got) == 21
    for (a, b), dist in got.items():
        assert abs(dist - (1 - sum(x == y for x, y in zip(sigs[a], sigs[b])) / 10)) < 1e-12


def test_features_of_all_pairs_ride_in_their_tiles(spark):
    # Repeated and null ids, a null feature, a group of one: as if pairs were made first and joined to the entities twice.
    rows = [(g, i, [float(i or 0), 1.0] if i != 4 else None) for g in (0, 1) for i in (1, 2, 2, 3, 4, 7, None)] + [(2, 9, [0.0]), (None, 1, [1.0]), (None, 2, [1.0])]
    ents = spark.createDataFrame(rows, "group_id long, entity_id long, encoding array<float>")
    as_rows = lambda df: sorted(map(str, df.select("group_id", "id1", "id2", "encoding1", "encoding2").collect()))
    want = as_rows(P.pair_features(P.all_pairs(ents), ents))
    assert as_rows(P.pair_features(None, ents)) == want
    assert as_rows(P.pair_features(None, ents, tile_rows=2)) == want
    numbered = ents.withColumn("uid", F.monotonically_increasing_id())
    ids = numbered.select("group_id", "entity_id", "uid")
    pairs = P.all_pairs(ents)
    for k in ("1", "2"):
        pairs = pairs.join(ids.withColumnRenamed("entity_id", f"id{k}").withColumnRenamed("uid", f"uid{k}"), ["group_id", f"id{k}"])
    by_uid = lambda df: sorted(map(str, df.select("uid1", "uid2", "encoding1", "encoding2").collect()))
    assert by_uid(P.pair_features_uid(None, numbered)) == by_uid(P.pair_features_uid(pairs.select("uid1", "uid2"), numbered))


def test_no_shuffle_of_pairs_in_the_feature_queries(spark):
    from pairsim.plans.vectors import q_pair_features, q_pair_features_uid
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for q in (q_pair_features, q_pair_features_uid):
            plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
            # The join that makes the pairs (its key holds the tile) is the last one: nothing above it moves rows.
            tile = next(k for k, line in enumerate(plan) if "Join" in line and "_bi" in line)
            assert not any("Exchange" in line or "Join" in line for line in plan[:tile]), plan[:tile + 1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_minhash_distance_shuffles_no_pairs(spark):
    from pairsim.operators.signature import minhash_pair_distance
    rnd = random.Random(8)
    rows = [("g", i, [rnd.randrange(3) for _ in range(8)]) for i in range(30)] + [("h", 1, [1] * 8), ("h", 2, None), ("h", None, [1] * 8), (None, 1, [1] * 8)]
    df = spark.createDataFrame(rows, "group_name string, entity_id long, signature array<int>")
    d = minhash_pair_distance(df, "group_name", k=8, tile_rows=7)
    sig = {i: s for g, i, s in rows if g == "g"}
    want = {(a, b): 1 - sum(x == y for x, y in zip(sig[a], sig[b])) / 8 for a in sig for b in sig if a < b}
    assert {(r.id1, r.id2): r.minhash_distance for r in d.collect()} == want
    # Two copies of an entity: each of its pairs twice, with the equal positions of both.
    twice = minhash_pair_distance(spark.createDataFrame([("g", 1, [1, 2]), ("g", 1, [1, 3]), ("g", 2, [1, 2])], df.schema), "group_name", k=2)
    assert [(r.id1, r.id2, r.minhash_distance) for r in twice.collect()] == [(1, 2, 1 - 3 / 2)] * 2
    plan = d._jdf.queryExecution().executedPlan().toString().splitlines()
    assert "FlatMapGroupsInPandas" in next(line for line in plan if any(x in line for x in ("FlatMapGroups", "Exchange", "Join", "Aggregate")))


def test_intersections_shuffle_no_pairs(spark):
    from pairsim.operators.signature import freq_distance, set_jaccard
    rnd = random.Random(5)
    texts = {i: [rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9))] for i in range(1, 26)}
    hist = spark.createDataFrame([("g", i, w, t.count(w)) for i, t in texts.items() for w in sorted(set(t))] + [(None, 1, "a", 1)], "g string, entity_id long, token string, n long")
    d = freq_distance(hist, "g", tile_rows=6)
    counts = lambda a, b: sum(abs(a.count(w) - b.count(w)) for w in "abcdefgh")
    assert {(r.id1, r.id2): r.freq_distance for r in d.collect()} == {(i, j): counts(texts[i], texts[j]) for i in texts for j in texts if i < j}
    ents = spark.createDataFrame([("g", i) for i in [*texts, 3, 99]], "g string, entity_id long")  # listed twice, and without members
    j = set_jaccard(ents, hist, "g", item="token", tile_rows=6)
    want = sorted((a, b, len(set(texts.get(a, [])) & set(texts.get(b, [])))) for a in [*texts, 3, 99] for b in [*texts, 3, 99] if a < b)
    assert sorted((r.id1, r.id2, r.intersection) for r in j.collect()) == want
    for df in (d, j):  # the join of the tiles is the last one that moves rows
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
        tile = next(k for k, line in enumerate(plan) if "Join" in line)
        assert "_bi" in plan[tile] and not any("Exchange" in line or "Aggregate" in line for line in plan[:tile])


def test_minhash_slabs(spark):
    import numpy as np
    import pyarrow as pa
    from pairsim.operators import signature as G
    rnd = random.Random(6)
    rows = [[rnd.randrange(2**32) for _ in range(n)] for n in (1, 3 * G.SLAB + 5, 2, G.SLAB - 3)] + [None, [], [0, 2**32 - 1], [rnd.randrange(2**32) for _ in range(G.SLAB)]]
    a, b = G.coefficients(7)
    want = [[min((int(x) * h + int(y)) % G.PRIME for h in r) for x, y in zip(a, b)] if r else None for r in rows]
    whole = pa.array([[5], *rows], pa.list_(pa.int64()))
    assert G.minhash_rows(whole.slice(1), 7).to_pylist() == want
    assert G.minhash_rows(pa.array([None, []], pa.list_(pa.int64())), 7).to_pylist() == [None, None]
    assert np.array(want[0]).max() < G.PRIME


def test_greedy_rounds_store_the_edges_at_most_twice(spark, monkeypatch):
    from pairsim import session
    from pairsim.operators import select as S
    rnd = random.Random(12)
    n, real = 60, session.cut_lineage
    edges = [(i, j, round(rnd.random(), 2)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5]
    prio = {i: rnd.randrange(20) for i in range(n)}
    for limit in (S.GONE_ROWS, 1):  # the second: stored anew after each round
        monkeypatch.setattr(S, "GONE_ROWS", limit)
        stored = []

        def cut(df):
            out = real(df)
            if "partner" in out.columns and "_own" in out.columns or "_p" in out.columns and "_pp" in out.columns:
                stored.append(out.count())
            return out

        monkeypatch.setattr(session, "cut_lineage", cut)
        assert _run_greedy(spark, edges, prio, 0.3) == greedy_reference(edges, prio, 0.3)
        assert stored[0] == 2 * sum(s > 0.3 for _, _, s in edges)
        if limit > 1:
            assert sum(stored) <= 2 * stored[0]
        monkeypatch.setattr(session, "cut_lineage", real)
