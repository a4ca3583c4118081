"""Packed band keys name the same buckets as hashed ones, and signatures of long batches are made in parts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairsim.operators import signature as G


def test_packed_bands_give_the_same_candidates(spark):
    rng = np.random.default_rng(3)
    rows = [("g", i, None if i == 5 else [int(v) for v in rng.integers(0, 3, 12)]) for i in range(60)] + [("g", 99, [G.PRIME - 1, 0] * 6), ("h", 98, [0, G.PRIME - 1] * 6), (None, 97, [0] * 12)]
    signed = spark.createDataFrame(rows, "g string, entity_id long, signature array<long>")
    plain, packed = (G.band_table(signed, "g", "entity_id", bands=6, packed=p) for p in (False, True))
    assert dict(packed.dtypes)["key"] == "bigint" and packed.count() == plain.count()
    pairs = [sorted(map(str, G.lsh_candidates(b, "g").collect())) for b in (plain, packed)]
    assert pairs[0] and pairs[0] == pairs[1]
    assert sorted(G.bucket_report(plain, "g").collect()) == sorted(G.bucket_report(packed, "g").collect())


def test_signatures_of_a_batch_are_made_in_parts(spark, monkeypatch):
    rows = [(i, None if i % 7 == 0 else [int(h) for h in range(i % 5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, h array<long>").coalesce(1)
    want = G.minhash_rows(pa.array([h for _, h in rows], pa.list_(pa.int64())), 8).to_pylist()
    monkeypatch.setattr(G, "BATCH_ROWS", 3)
    seen = []
    whole = G.minhash_rows
    monkeypatch.setattr(G, "minhash_rows", lambda hashes, k: seen.append(len(hashes)) or whole(hashes, k))
    parts = G._minhash_udf(8).func(pa.array([h for _, h in rows], pa.list_(pa.int64())))
    assert parts.to_pylist() == want and max(seen) == 3
    assert G._minhash_udf(8).func(pa.array([], pa.list_(pa.int64()))).to_pylist() == []
    got = df.select("i", G._minhash_udf(8)(F.col("h")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == want
