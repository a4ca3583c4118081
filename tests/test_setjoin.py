"""Thresholded set joins and classes of copies against the exhaustive result."""

import random

from pyspark.sql import functions as F

from pairsim.operators import pairs as P
from pairsim.operators import setjoin as J
from pairsim.operators import signature as G


def corpus():
    rng = random.Random(9)
    sets, n = {}, 0
    for g in ("a", "b"):
        base = [{f"{g}{rng.randrange(60)}" for _ in range(rng.randrange(1, 14))} for _ in range(40)]
        for s in base:
            sets[(g, n)] = s | {"common"} if rng.random() < 0.7 else s
            n += 1
        for _ in range(50):  # near copies at all distances, and hot copies
            s = set(rng.choice(base))
            for _ in range(rng.randrange(4)):
                s ^= {f"{g}{rng.randrange(60)}"}
            if s:
                sets[(g, n)] = s
                n += 1
        for _ in range(45):
            sets[(g, n)] = {f"{g}x", f"{g}y", "common"}
            n += 1
    return sets


def brute(sets, keep):
    reps = {}
    for (g, i), s in sorted(sets.items()):
        reps.setdefault((g, frozenset(s)), i)
    classes = {(g, i, reps[(g, frozenset(s))]) for (g, i), s in sets.items()}
    heads = sorted((g, i, s) for (g, s), i in reps.items())
    return {(g, i, j, len(x & y)) for g, i, x in heads for h, j, y in heads if g == h and i < j and keep(len(x & y), len(x), len(y))}, classes


def test_jaccard_join_is_the_exhaustive_result_filtered(spark):
    sets = corpus()
    rows = [(g, i, x) for (g, i), s in sets.items() for x in sorted(s) for _ in range(1 + (i % 2))] + [("a", 9999, None)]
    members = spark.createDataFrame(rows, "g string, entity_id long, item string")
    for t in (0.3, 0.5, 0.8, 1.0):
        pairs, classes = J.jaccard_join(members, t, "g", tile_rows=8)
        want, members_want = brute(sets, lambda o, n1, n2: o / (n1 + n2 - o) >= t)
        assert {(r.g, r.id1, r.id2, r.overlap) for r in pairs.collect()} == want
        assert {(r.g, r.entity_id, r.class_id) for r in classes.collect()} == members_want
    assert want == set() and len({c for _, _, c in members_want}) < len(sets) - 80  # copies: a row each, no pairs


def test_no_stage_over_all_pairs(spark):
    # 600 disjoint sets that share frequent items only behind their prefixes: nothing meets.
    rows = [("g", i, f"{i}-{k}") for i in range(600) for k in range(5)] + [("g", i, f"common{k}") for i in range(600) for k in range(3)]
    sets = J.item_sets(spark.createDataFrame(rows, "g string, entity_id long, item string"), "g")
    places = sets.select("g", "entity_id", F.explode(F.slice("items", F.lit(1), (F.col("n") - F.ceil(F.col("n") * 0.5) + 1).cast("int"))).alias("x"))
    assert places.groupBy("x").count().agg(F.max("count")).first()[0] == 1
    assert J.overlap_join(sets, 0.5, "g").count() == 0


def test_freq_join(spark):
    rng = random.Random(4)
    texts = {i: rng.choices("abcdefgh", k=rng.randrange(1, 12)) for i in range(80)}
    texts |= {100 + i: ["a", "a", "b"] for i in range(30)}
    hist = G.token_histogram(spark.createDataFrame([("g", i, " ".join(t)) for i, t in texts.items()], "g string, entity_id long, text string"), group="g")
    sets = {("g", i): {(w, k) for w in set(t) for k in range(t.count(w))} for i, t in texts.items()}
    for most in (0.0, 0.2, 0.5):
        pairs, _ = J.freq_join(hist, most, "g")
        want, _ = brute(sets, lambda o, n1, n2: n1 + n2 - 2 * o <= (n1 + n2) * most)
        assert {(r.g, r.id1, r.id2, (r.size1 + r.size2 - r.freq_distance) // 2) for r in pairs.collect()} == want


def test_equal_signatures_are_classes(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefghij", k=12)) for _ in range(12)]
    rows = [("g", i, texts[i % 12] if i % 3 else texts[0]) for i in range(90)] + [("h", 200, texts[0]), ("h", 201, "one"), ("g", 202, None)]
    signed = G.minhash_text(spark.createDataFrame(rows, "g string, entity_id long, text string"), "text", 40).checkpoint()
    cand, classes = G.lsh_class_candidates(signed, "g", bands=20, rows=2)
    member = {(r.g, r.entity_id): r.class_id for r in classes.collect()}
    whole = {(r.g, r.id1, r.id2) for r in G.lsh_candidates(G.band_table(signed, "g", "entity_id", bands=20, rows=2), "g").collect()}
    pairs = {(r.g, r.id1, r.id2) for r in cand.collect()}
    assert len(member) == 91 and len(set(member.values())) <= 13 and len(pairs) <= 66
    # Expanded, classes and pairs of classes say what the pairs of all entities say.
    got = set()
    for (g, i), a in member.items():
        for (h, j), b in member.items():
            if g == h and i < j and (a == b or (g, min(a, b), max(a, b)) in pairs):
                got.add((g, i, j))
    assert got == whole


def test_duplicates_are_verified_by_content(spark):
    rows = [("g", 1, "aa"), ("g", 2, "bb"), ("g", 3, "aa"), ("g", 4, "bb"), ("g", 5, "cc"), ("g", 6, "ccc"), ("h", 7, "aa"), ("g", 8, None), ("g", 9, "bb")]
    docs = spark.createDataFrame(rows, "g string, entity_id long, text string")
    weak = lambda c: [F.length(c).alias("_len")]  # noqa: E731: texts of one length collide
    want = [("g", 1, 1, 2), ("g", 2, 2, 3), ("g", 3, 1, 2), ("g", 4, 2, 3), ("g", 9, 2, 3)]
    for digest in (P.content_digest, weak):
        assert sorted(map(tuple, P.exact_duplicates(docs, "text", group="g", digest=digest).collect())) == want


def test_tuned_bands_find_pairs_at_the_threshold(spark):
    rng = random.Random(7)
    rows, k = [], 200
    for g, n in (("large", 260), ("small", 30)):
        for i in range(0, n, 2):  # pairs around the threshold, among unrelated texts
            words = [f"{g}{i}w{j}" for j in range(60)]
            other = list(words)
            for j in rng.sample(range(60), rng.randrange(0, 22)):
                other[j] = f"{g}{i}x{j}"
            rows += [(g, i, " ".join(words)), (g, i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "g string, entity_id long, text string")
    signed = G.minhash_text(docs, "text", k).checkpoint()
    params = G.tuned_parameters(G.similarity_histogram(signed, "g", k=k), 0.5, "g", 0.95, k)
    chosen = {r.g: (r.bands, r.rows) for r in params.collect()}
    assert chosen.keys() == {"large", "small"} and all(b * r <= k and 1 - (1 - 0.5**r) ** b >= 0.95 for b, r in chosen.values())
    assert chosen["large"][1] >= chosen["small"][1]  # more members: more candidates to save, more bands are worth it
    got = {(r.g, r.id1, r.id2) for r in G.lsh_candidates(G.tuned_bands(signed, params, "g"), "g").collect()}
    fixed = {(r.g, r.id1, r.id2) for r in G.lsh_candidates(G.band_table(signed, "g", "entity_id"), "g").collect()}
    shingle = {(g, i): set(zip(t.split(), t.split()[1:])) for g, i, t in rows}
    near = {(g, i, i + 1) for g, i, _ in rows if i % 2 == 0 and len(shingle[(g, i)] & shingle[(g, i + 1)]) / len(shingle[(g, i)] | shingle[(g, i + 1)]) >= 0.5}
    assert len(near) > 30 and len(near & got) / len(near) >= 0.95
    # No candidate at the threshold that the fixed cut finds is lost beyond that recall; far fewer others come along.
    assert len(near & fixed - got) <= 0.05 * len(near) and len(got - near) <= len(fixed - near)


def test_item_sets_are_stored_as_a_row_each(spark, monkeypatch):
    stored, real = [], J.cut_lineage
    monkeypatch.setattr(J, "cut_lineage", lambda df: stored.append(real(df)) or stored[-1])
    rows = [("g", i, f"{k % 7}") for i in range(5) for k in range(40)] + [("g", 0, None), ("g", None, "1"), (None, 1, "1")]
    sets = {(r.g, r.entity_id): (r.n, len(set(r["items"]))) for r in J.item_sets(spark.createDataFrame(rows, "g string, entity_id long, item string"), "g").collect()}
    assert sets == {**{("g", i): (7, 7) for i in range(5)}, ("g", None): (1, 1)}
    assert stored[0].count() == 7


def test_bitmaps_bound_what_sets_share(spark):
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = rng.choice(400, rng.integers(1, 200), replace=False) * 7919
        b = np.unique(np.concatenate([a[:rng.integers(0, len(a) + 1)], rng.choice(4000, rng.integers(1, 90))]))
        x, y = (np.frombuffer(v, np.uint64) for v in J._bitmaps.func(pa.array([a, b], pa.list_(pa.int64()))).to_pylist())
        assert J._most(x, y, len(a), len(b)) >= len(np.intersect1d(a, b))
    far = [rng.integers(-2**62, 2**62, 300) for _ in range(2)]
    x, y = (np.frombuffer(v, np.uint64) for v in J._bitmaps.func(pa.array(far, pa.list_(pa.int64()))).to_pylist())
    assert J._most(x, y, 300, 300) < 120


def test_no_set_travels_with_a_pair(spark, monkeypatch):
    # Many sets meet at a shared item, next to none share enough: what is compared whole is a few pairs.
    compared, real = [], J.score_pairs
    monkeypatch.setattr(J, "score_pairs", lambda pairs, *a: compared.append(pairs.count()) or real(pairs, *a))
    rng = random.Random(1)
    rows = [("g", i, f"{rng.randrange(900)}") for i in range(150) for _ in range(120)] + [("g", 500 + i, f"k{k}") for i in range(2) for k in range(20 + i)]
    rows += [("h", i, "k1") for i in (500, 501)] + [(None, 1, "k1"), ("g", None, "k1")]
    pairs = J.jaccard_join(spark.createDataFrame(rows, "g string, entity_id long, item string"), 0.5, "g", tile_rows=16)[0]
    assert [(r.g, r.id1, r.id2, r.overlap) for r in pairs.collect()] == [("g", 500, 501, 20)]
    assert len(compared) == 2 and compared[1] < 0.05 * compared[0]
