"""Ingest, merge logs, flags and integrity on hand-made inputs (FIXTURES C.5, C.6, C.8)."""

import os
import tempfile

from pyspark.sql import functions as F

from pairsim.functions.flags import PRESETS, canonical
from pairsim.operators.ingest import first_writer_wins, insert_groups_if_absent, merge_datasets
from pairsim.sources.text import discover, read_embedding_file, read_merge_logs


def _groups(spark, rows):
    return spark.createDataFrame(rows, "group_id long, group_name string")


def _ents(spark, rows):
    return spark.createDataFrame(rows, "group_id long, entity_id long")


def test_merge_offsets_and_policies(spark):
    a = {"groups": _groups(spark, [(1, "x"), (2, "y")]), "entities": _ents(spark, [(1, 10), (2, 11)])}
    b = {"groups": _groups(spark, [(1, "z"), (2, "w")]), "entities": _ents(spark, [(1, 12), (2, 13)])}
    c = {"groups": _groups(spark, [(1, "x")]), "entities": _ents(spark, [(1, 14)])}
    empty = {"groups": _groups(spark, []), "entities": _ents(spark, [])}
    m = merge_datasets([empty, a, b], "reject-source")
    assert sorted(tuple(r) for r in m["groups"].collect()) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]
    assert sorted(tuple(r) for r in m["entities"].select("group_id", "entity_id").collect()) == \
        [(1, 10), (2, 11), (3, 12), (4, 13)]
    r = merge_datasets([a, c, b], "reject-source")
    assert r["accepted"] == [0, 2]          # c repeats "x"; b is still accepted
    u = merge_datasets([a, c, b], "unify-by-name")
    ents = {r["entity_id"]: r["group_id"] for r in u["entities"].collect()}
    assert ents[14] == ents[10] == 1 and ents[12] == 3


def test_insert_if_absent(spark):
    g = _groups(spark, [(1, "a"), (2, "b")])
    out = insert_groups_if_absent(g, spark.createDataFrame([("b",), ("c",), ("c",)], "group_name string"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    empty = insert_groups_if_absent(_groups(spark, []), spark.createDataFrame([("q",)], "group_name string"))
    assert [tuple(r) for r in empty.collect()] == [(1, "q")]


def test_first_writer_wins(spark):
    ex = spark.createDataFrame([(1, "old")], "k long, v string")
    inc = spark.createDataFrame([(1, "new", 0), (2, "late", 5), (2, "early", 1)], "k long, v string, t long")
    out = first_writer_wins(ex, inc, ["k"], "t")
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [(1, "old"), (2, "early")]


def test_flags(spark):
    rows = ["", "FOO=1", "TECHNIQUE=baseline", "TECHNIQUE=f3m ALIGNMENT=pa junk", "ALIGNMENT=pa ALIGNMENT=nw"]
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    got = [r[0] for r in df.select(canonical(F.col("s"))).collect()]
    assert got == ["TECHNIQUE=baseline", "TECHNIQUE=baseline", "TECHNIQUE=baseline",
                   "TECHNIQUE=f3m ALIGNMENT=pa", "TECHNIQUE=baseline"]
    presets = spark.createDataFrame([(n, " ".join(f"{k}={v}" for k, v in f.items())) for n, f in PRESETS], "name string, s string")
    assert {r.name: r.c for r in presets.select("name", canonical(F.col("s")).alias("c")).collect()} == {
        "baseline": "TECHNIQUE=baseline", "f3m-nw": "TECHNIQUE=f3m", "f3m-pa": "TECHNIQUE=f3m ALIGNMENT=pa",
        "f3m-predict-dotprod-nw": "TECHNIQUE=f3m-predict-dotprod PredictAlignment=true",
        "f3m-predict-attention-nw": "TECHNIQUE=f3m-predict-attention PredictAlignment=true",
        "f3m-predict-dotprod-pa": "TECHNIQUE=f3m-predict-dotprod ALIGNMENT=pa PredictAlignment=true",
        "f3m-predict-attention-pa": "TECHNIQUE=f3m-predict-attention ALIGNMENT=pa PredictAlignment=true"}


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_merge_logs_from_files(spark):
    d = tempfile.mkdtemp(prefix="pairsim-logs-")
    merge = "@a + @b <= 3 Valid: 1 BinSizes: 10 + 20 <= 25 Cost: 1 Profitable: 1\n"
    _write(f"{d}/build.b1.TECHNIQUE=f3m.0.1.log", "Number of Functions: 5\n" + merge + "Number of Functions: 7\n" + merge)
    _write(f"{d}/build.b2.TECHNIQUE=baseline.0.1.log", "nothing to see\n")
    _write(f"{d}/other.log", merge)
    m = {r["benchmark"]: r for r in read_merge_logs(spark, d).collect()}
    assert set(m) == {"b1", "b2"}
    assert (m["b1"]["total_functions"], m["b1"]["merge_attempts"], m["b1"]["profitable_merges"],
            m["b1"]["bin_size_difference"]) == (7, 2, 2, -10)
    assert (m["b2"]["total_functions"], m["b2"]["merge_attempts"]) == (0, 0)


def test_embedding_file_last_wins(spark):
    d = tempfile.mkdtemp(prefix="pairsim-emb-")
    _write(f"{d}/emb.txt", "0123456789Afoo\t=\t1 2 3\n0123456789Abar\t=\t4 5\n0123456789Afoo\t=\t7  8 9 \n")
    got = {r["name"]: r["vector_csv"] for r in read_embedding_file(spark, d).collect()}
    assert got == {"foo": "7,8,9", "bar": "4,5"}


def test_discover_skips_build_parent(spark):
    d = tempfile.mkdtemp(prefix="pairsim-find-")
    _write(f"{d}/p1/x.ll", "a\n")
    _write(f"{d}/p2/build/x.ll", "b\n")
    _write(f"{d}/p2/build/sub/x.ll", "c\n")
    got = sorted(r["file_path"].split("/")[-2] for r in discover(spark, d, "x.ll").collect())
    assert got == ["p1", "sub"]
