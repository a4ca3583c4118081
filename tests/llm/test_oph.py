import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from pairsim.llm import oph
from tests.llm.helpers import frame


def shingle_set(text, size=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if x]
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def text(rng, n):
    return rng.choice([" ", "\n", " \t"]).join(f"w{rng.randrange(4000)}É" for _ in range(n))


def plain_fingerprint(t, p):
    """Bin by bin: least hash, then each empty bin asks the others in its order."""
    low = {}
    for h in (int(x) for part in oph.shingles(t, p.shingle, p.seed) for x in part):
        b = h >> (64 - (p.bins - 1).bit_length())
        low[b] = min(low.get(b, h), h)
    if not low:
        return b""
    values = [low[b] if b in low else low[next(int(j) for j in np.argsort(p.place[b]) if int(j) in low)] for b in range(p.bins)]
    bits = "".join(format(v % 2**p.bits, f"0{p.bits}b") for v in values)
    return int(bits, 2).to_bytes(p.bins * p.bits // 8, "big")


def test_bins_against_plain(monkeypatch):
    rng = random.Random(2)
    texts = ["", " \n", "one", "one two", "a b c d e f", *[text(rng, n) for n in (5, 6, 9, 30, 200, 3000)], "x " * 500]
    for p in (oph.Printer(), oph.Printer(bins=64, bits=1), oph.Printer(bins=16, bits=8, shingle=2)):
        assert p(texts) == [plain_fingerprint(t, p) for t in texts]
    p = oph.Printer()
    whole = p(texts)
    monkeypatch.setattr(oph, "PIECE", 3)
    assert p(texts) == whole


def test_estimate(spark):
    rng = random.Random(3)
    p, errors = oph.Printer(), []
    for k in range(300):
        words = [f"{rng.random()}" for _ in range(400)]
        cut = rng.randrange(400)
        a, b = " ".join(words), " ".join(words[:cut] + [f"{rng.random()}" for _ in range(400 - cut)])
        errors.append(p.likeness(p([a]), p([b]))[0] - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035
    rows = [("a", text(rng, 80)), ("b", ""), ("c", text(rng, 80))]
    prints = {k: f for (k, _), f in zip(rows, p([t for _, t in rows]))}
    pairs = spark.createDataFrame([(x, y, bytearray(prints[x]), bytearray(prints[y])) for x in prints for y in prints], "x string, y string, p binary, q binary")
    got = {(r.x, r.y): r.near for r in pairs.withColumn("near", oph.likeness(F.col("p"), F.col("q"))).collect()}
    assert all(v == 1.0 if x == y else v < 0.05 for (x, y), v in got.items())


def corpus():
    rng = random.Random(6)
    rows = [(i, text(rng, rng.randrange(1, 90))) for i in rng.sample(range(-50, 5000), 150)]
    rows += [(9000 + i, rows[0][1]) for i in range(30)]  # copies
    return rows + [(9100, None), (9101, ""), (9102, "\t"), (9103, "日本 語 x"), (9104, "long words " * 60_000), (9104, "other"), (None, "n one two"), (None, "m"), (9105, "same"), (9105, "same"), (9105, "same")]


def test_pairs_against_plain(spark):
    rows = corpus()
    key = {t: r["h"] for t in {r[1] or "" for r in rows} for r in [spark.range(1).select(F.xxhash64(F.lit(t)).alias("h")).first()]}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), key[r[1]]))
    p, want = oph.Printer(), []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        e = t[:len(t) - len(t) // 3] + n[:len(t) // 3]
        a, b, c = p([t, e, n])
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, float(p.likeness([a], [b])[0]), float(p.likeness([a], [c])[0])))
    df = frame(spark, rows).repartition(3)
    clash = df.withColumns({c: F.lit(1) for c in ("part", "_h", "_row", "side", "fingerprint", "following")})
    got = [(r.doc_id, r.n_chars, r.edited_sha256, bytes(r.fingerprint), bytes(r.edited_fingerprint), r.near_edited, r.near_next) for r in oph.edited_pairs(clash).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    alone = {bytes(r.fingerprint) for r in oph.fingerprints(df.where("doc_id >= 9000 and doc_id < 9030")).collect()}
    assert alone == set(p([rows[0][1]]))


def test_empty_and_one(spark):
    assert oph.edited_pairs(frame(spark, [])).collect() == [] and oph.fingerprints(frame(spark, [])).collect() == []
    one = oph.edited_pairs(frame(spark, [(1, "abc def")])).collect()[0]
    assert one.near_next == 1.0 and one.n_chars == 7 and one.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    none = oph.edited_pairs(frame(spark, [(1, None), (2, "")])).collect()
    assert [bytes(r.fingerprint) for r in none] == [b"", b""] and all(r.near_edited == 1.0 for r in none)
