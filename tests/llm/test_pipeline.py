"""The stages against plain versions of what each does, on its own input; and the whole run."""

import os
import random

import corpus_pipeline
from pairsim.llm import simhash, toxicity
from pairsim.llm.queries import END_ID, TOKENIZER
from tests.llm import test_bitpack, test_mixing, test_positional, test_simhash

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    # Vocabularies with no word in common keep the classes apart.
    word = lambda: "".join(rng.choice("ba co du fe gi ho ju ka".split()) for _ in range(3))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(6)]
    rows, labels = [], []
    for i in range(260):
        w = [word() for _ in range(rng.randrange(20, 50))]
        if i % 6 == 0:
            w[3:3] = [rng.choice(["moron", "worthless"])]
        if i % 11 == 0:
            w += items[rng.randrange(6)][1].upper().split()[:12]
        rows.append((i, " ".join(w), "en", f"s{i % 4}", len(w)))
        labels.append((i, 0, int(i % 6 == 0)))
    for i in range(20):  # copies, and copies with a changed end
        rows.append((500 + i, rows[7][1] + (" tail" if i % 2 else ""), "en", "hot", 1))
    rows += [(600, None, "en", "s1", None), (601, "", None, None, 0), (602, " ", "en", None, 1), (7, rows[7][1], "en", "s3", 1), (None, rows[9][1] + " x", "en", "s1", 1)]
    return rows, labels, items


def sets(rows):
    return sorted(map(str, rows))


def test_stages_and_run(spark, tmp_path):
    rows, labels, items = corpus()
    spark.createDataFrame(rows, COLS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontaminate", "mix", "encode"]
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(path := os.path.join(tmp_path, f"out{k}"))
        docs = spark.read.parquet(path)
        after = [tuple(r) for r in docs.collect()]
        seen.append((name, before, after))
    # Toxicity: the documents with a learned word go, no others.
    _, before, after = seen[0]
    bad = lambda t: any(w in (t or "").split() for w in ("moron", "worthless"))
    assert sets(after) == sets(r for r in before if not bad(r[1]))
    # Near-duplicates: the smallest id of each component of linked fingerprints, once.
    _, before, after = seen[1]
    part = test_simhash.plain_components([(i, simhash.fingerprint(r[1])) for i, r in enumerate(before)])
    first = {min((before[j][0] for j in part if part[j] == part[i] and before[j][0] is not None), default=None) for i in part}
    assert sets(r[0] for r in after) == sets(first)
    # Decontamination.
    _, before, after = seen[2]
    hit = {r[0] for r in test_positional.plain([r[:2] for r in before], items) if r[5]}
    assert hit and sets(after) == sets(r for r in before if r[0] not in hit)
    # Mixing: each row as often as the plan says.
    _, before, after = seen[3]
    *_, copies = test_mixing.plain([r[:4] for r in before])
    assert sets(after) == sets(r for r, c in zip(before, copies) for _ in range(c))
    # Encoding: spans of whole texts in order of ids.
    _, before, after = seen[4]
    at = 0
    for d, t in sorted(((r[0], r[1] or "") for r in before), key=lambda r: (r[0] is not None, r[0] or 0)):
        n = len(test_bitpack.TOK.encode(t, add_special_tokens=False).ids) + 1
        assert (d, at, n) in {r[:3] for r in after}
        at += n
    assert len(after) == len(before)
    assert sets(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sets(after)
    assert toxicity.FEATURES and END_ID == 2 and TOKENIZER


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
