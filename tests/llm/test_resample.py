import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np

from pairsim.llm import resample
from tests.llm.helpers import frame

GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in GAP.split(low) if x]
    return len(w), [crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain(docs, target):
    """(doc_id, n_features, weight, score, rank) by the contract's words."""
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [r[1] for r in docs]), (t, target)):
        for text in texts:
            for b in plain_features(text)[1]:
                counts[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((y + 1) * (big_s + 10000) / ((x + 1) * (big_t + 10000)))) for x, y in zip(s, t)]
    rows = []
    for i, text, *_ in docs:
        n, f = plain_features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[:25 * len(fit) // 100])}
    return [(r[0], *r[2:], rank.get(id(r))) for r in rows]


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice(["Éa", "b2", "ça", "the", "x", "日本", "Of", "run", "wörd"]) + str(rng.randrange(30))
    docs = [(i, rng.choice([" ", "\n", "--", "\x7f"]).join(word() for _ in range(rng.randrange(1, 60)))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, " .,-"), (None, docs[3][1]), (None, docs[3][1]), (7, docs[7][1]), (7, "b2 the"), (600, "the run " * 40_000), (601, "a" * 300_000)]
    return docs, [" ".join(word() for _ in range(40)) for _ in range(12)] + [None, ""]


def test_against_plain(spark):
    docs, target = corpus()
    df = frame(spark, docs)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    clash = df.withColumns({c: df["lang"] for c in ("rank", "weight", "score", "_fits", "_num_part", "_no", "n", "bucket")})
    got = resample.resample(clash, items).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(docs, target)))


def test_pieces_and_sums(monkeypatch):
    text = ("The cat's Éa 12 " * 50).encode()
    whole = list(resample.features(text))
    monkeypatch.setattr(resample, "PIECE", 7)
    cut = list(resample.features(text))
    assert len(cut) > 20 and sum(n for n, _ in cut) == whole[0][0]
    assert sorted(np.concatenate([c for _, c in cut])) == sorted(whole[0][1])
    rng = np.random.default_rng(3)
    for top in (0, 1, 5, 9000):
        gain, counts = rng.integers(-top, top + 1, 130), rng.integers(0, 70_000, (9, 130)).astype(np.int32)
        counts[0] = 0
        planes, worth = resample.gain_planes(gain)
        assert (resample.gain_sums(counts, planes, worth) == counts.astype(np.int64) @ gain).all()


def test_draw_follows_the_target(spark):
    rng = random.Random(8)
    say = lambda kind: " ".join(f"{kind}{rng.randrange(50)}" for _ in range(30))
    docs = [(i, say("law" if i % 5 == 0 else "web")) for i in range(1000)]
    items = spark.createDataFrame([(i, say("law")) for i in range(50)], "item_id long, text string")
    got = [r.doc_id for r in resample.resample(frame(spark, docs), items, percent=10).collect() if r["rank"]]
    assert len(got) == 100 and sum(i % 5 == 0 for i in got) > 60  # 20 by chance


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(frame(spark, []), items).collect() == []
    assert [r["rank"] for r in resample.resample(frame(spark, [(1, "a b " * 20), (2, "c " * 30)]), items, percent=100).collect()].count(None) == 0
