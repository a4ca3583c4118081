import hashlib
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from pairsim.llm import merkle
from tests.llm.helpers import frame


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """The root, and each leaf's list of (left, right) siblings."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            a = at[k] // 3 * 3
            path.append(("".join(nodes[a:at[k]]), "".join(nodes[at[k] + 1:a + 3])))
            at[k] //= 3
        nodes = [H(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows, change=lambda r: r[1]):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, tops = plain_tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            h = plain_leaf(r[0], change(r), *r[2:])
            for left, right in path + top:
                h = H(left, h, right)
            out.append((r[0], leaf, trees[g][0], root, H(*(a + b for a, b in path + top)), h, h == root))
    return out


def tampered(r):
    return r[1].replace("\n", "") if r[1] is not None and crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 else r[1]


def spark_tampered():
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))


def corpus():
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("ab é日\n:-") for _ in range(rng.randrange(1, 9)))
    rows = [(i, text(), "en", "hot", i) for i in rng.sample(range(-40, 20_000), 400)]
    rows += [(i * 10**12 * rng.choice([-1, 1]), text(), "en", f"s{rng.randrange(5)}", 1) for i in range(1, 120)]
    rows += [(i, text(), "en", "dense", 1) for i in range(3000, 4500)]  # bitmap containers
    rows += [(2**63 - 1, text(), None, "ends", None), (-(2**63), "a\nb", None, "ends", 2), (9, None, None, "é", None), (10, "", "", "", 0), (11, "x\n", "en", "z" * 50, 3)]
    rows += [(12, "long " * 100_000 + "\n", "en", "hot2", 5), (5, "one", "en", None, 1), (6, "two", "en", None, 1), (3100, "again\n", "en", "dense", 1), (3100, "again\n", "en", "dense", 1), (4000, "other", "en", "dense", 1)]
    return rows + [(None, t, "en", "dense", 1) for t in ("n\n", "m", "m")] + [(7, "same\n", "en", "copies", 1)] * 40


@pytest.mark.parametrize("levels", [7, 1, 2])
def test_against_plain(spark, levels):
    # Fewer levels a block give trees of several stages.
    rows = corpus() if levels == 7 else corpus()[:450] + corpus()[-60:]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    clash = df.withColumns({c: F.lit("x") for c in ("key", "slot", "leaf", "n", "chunk", "pos", "root", "_no")})
    got = merkle.manifest(clash, spark_tampered(), levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = plain(rows, tampered)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {w[-1] for w in want} == {True, False}


def test_sizes(spark):
    # Trees of every small size, as groups of one table: last runs of one, two and three nodes.
    rows = [(i, f"{g}.{i}", "en", f"g{g:02}", i) for g in range(1, 30) for i in range(g)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = merkle.manifest(df).collect()
    assert all(r.verified for r in out) and {(r.source, r.doc_id, r.slot) for r in out} == {(r[3], r[0], r[0]) for r in rows}
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in out) == sorted(w[:5] for w in plain(rows))


def test_empty_and_one(spark):
    assert merkle.manifest(frame(spark, [])).collect() == []
    one = merkle.manifest(frame(spark, [(3, "t")])).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == H("")
    pair = frame(spark, [(None, None)]).unionByName(frame(spark, [(None, None)]))
    assert sorted(r.slot for r in merkle.manifest(pair).collect()) == [0, 1]
