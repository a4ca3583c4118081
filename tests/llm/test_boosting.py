import numpy as np

from pairsim.llm import boosting, pii
from pairsim.llm.models import Boosted
from tests.llm.helpers import frame


def test_quantiles_of_counted_values():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 500):
        x = rng.integers(-3, 9, n)
        at = np.linspace(0, 1, 33)[1:-1]
        assert np.allclose(boosting.quantiles(*np.unique(x, return_counts=True), at), np.quantile(x, at), atol=1e-12)


def test_trees_of_all_tasks_are_the_trees_of_one(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, k, 6000) for k in (2, 2, 40, 7, 300, 1, 64, 64)])
    y = (x[:, 0] + (x[:, 2] > 11) * (x[:, 4] % 7 > 2) + rng.random(6000) > 1.2).astype(int)
    blocks = spark.createDataFrame([boosting.block(x[s:s + 700], y[s:s + 700]) for s in range(0, 6000, 700)], "x binary, y binary").repartition(5)
    got, want = boosting.fit_boosted(blocks, 8, trees=12), Boosted(trees=12).fit(x, y)
    assert all(np.array_equal(a, b) for a, b in zip(got.edges, want.edges))
    for (tree, leaf), (own, own_leaf) in zip(got.forest, want.forest):
        assert all(np.array_equal(a, b) for level, own_level in zip(tree, own) for a, b in zip(level, own_level)) and np.allclose(leaf, own_leaf)
    assert np.abs(got.margin(x) - want.margin(x)).max() < 1e-9


def test_every_document_takes_part_in_the_fit(spark, monkeypatch):
    # More documents than the sample of 20,000 that the fit once took.
    seen = []
    real = pii.fit_boosted
    monkeypatch.setattr(pii, "fit_boosted", lambda blocks, n: seen.extend(boosting.rows_of([b], n) for b in blocks.select("x", "y").toArrow().to_batches()) or real(blocks, n, trees=2))
    docs = [(i, f"mail me at user{i}@mail.example.com now, then part {i:013d} of it") for i in range(24_000)]
    pii.fit(frame(spark, docs))
    import zlib
    held = [zlib.crc32(str(d).encode()) % 4 == 0 for d, _ in docs]
    want = sum(len(pii.examples(str(d), t)) for (d, t), h in zip(docs, held) if not h)
    assert sum(len(y) for blocks in seen for _, y in blocks) == want
