import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pairsim.llm import simhash
from tests.llm.helpers import frame


def plain(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, budget=2):
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, f) in enumerate(prints):
        for b, g in prints[:i]:
            if (f ^ g).bit_count() <= budget:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d, _ in prints}


def test_fingerprint_is_the_definition():
    for t in ["", None, "one", "one two", "One TWO three four É É é", "a\tb\nc\x0bd e f " * 9, " x " * 200]:
        assert simhash.fingerprint(t) == plain(t)


def test_walk_finds_every_near_pair():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(6)})
    v = np.array(values, np.uint64)
    a, b = simhash.trie_pairs(v, [(0, len(v), 0, len(v))], 2, 0)
    want = {(i, j) for j in range(len(v)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_links_connect_like_brute_force_with_hot_nodes(spark):
    rng = random.Random(2)
    family = {0x1234567800000000 | rng.getrandbits(18) for _ in range(150)}  # one node, many leaves
    others = {rng.getrandbits(64) for _ in range(40)}
    close = {x ^ (1 << rng.randrange(64)) for x in others}
    prints = sorted(family | others | close)
    prints = list(zip(prints, prints))
    signed = [int(np.array(p, np.uint64).view(np.int64)) for p, _ in prints]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    for node_rows in (8, 1000):
        got = {r.node: r.root for r in simhash.star_components(simhash.links(fps, 2, node_rows)).collect()}
        parts = {}
        for x in signed:
            parts.setdefault(got.get(x, x), set()).add(x & (2**64 - 1))
        want = {}
        for d, r in plain_components(prints).items():
            want.setdefault(r, set()).add(d)
        assert {frozenset(p) for p in parts.values()} == {frozenset(p) for p in want.values()}


def test_components_and_one_kept(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, text), (3, text), (9, text + " tail"), (7, "quite another text of some words"), (7, "quite another text of some words"),
            (1, None), (2, " \t"), (None, "alone here"), (None, text), (4, "")]
    docs = frame(spark, rows)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.components(docs).collect()), key=str)
    near = plain_components([(i, plain(t)) for i, (_, t) in enumerate(rows)])
    want = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in near if near[j] == near[i] and rows[j][0] is not None]
        want.append((d, min(ids, default=None)))
    assert got == sorted(want, key=str)
    kept = simhash.deduplicate(docs.withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2)))
    assert kept.columns == [*docs.columns, "fp", "component_id"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for _, c in got})


def test_each_component_keeps_a_row_whatever_its_ids(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(200)) for w in ("apple", "birch", "cedar", "daisy"))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (3, c + " end"), (None, c), (8, d), (7, d), (9, None), (9, "")]
    near = plain_components([(i, plain(t)) for i, (_, t) in enumerate(rows)])
    docs = frame(spark, rows)
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(docs).collect()), key=str)
    want = []
    for root in set(near.values()):
        own = [rows[i] for i in near if near[i] == root]
        want.append(min(own, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")))
    assert got == sorted(want, key=str) == sorted([(None, a), (None, b), (3, c + " end"), (7, d), (9, None)], key=str)


def test_empty_table(spark):
    assert simhash.components(frame(spark, [])).collect() == []
    assert simhash.deduplicate(frame(spark, [])).collect() == []
