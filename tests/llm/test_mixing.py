import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pairsim.llm import mixing
from tests.llm.helpers import frame


def draw(doc_id, text, tie):
    digest = "" if text is None else hashlib.md5(text.encode()).hexdigest()
    h = hashlib.md5(f"mix:{'' if doc_id is None else doc_id}:{digest}:{tie}".encode()).hexdigest()
    return (int(h[:13], 16) + 0.5) / 2**52


def fill(total, weight, cap):
    """Water-filling: min(cap, level * weight) that sums to total, or all caps."""
    out, open_, left = {}, set(weight), float(total)
    while open_:
        all_ = sum(weight[n] for n in open_)
        full = [n for n in open_ if not all_ or left * weight[n] / all_ >= cap[n]]
        if not full:
            return out | {n: left * weight[n] / all_ for n in open_}
        for n in full:
            out[n] = float(cap[n])
            open_.remove(n)
        left -= sum(out[n] for n in full)
    return out


def plain(rows, cycle=(1, 2, 3), most=3, weigh=lambda size: 1):
    """The definition: (source, size) -> target, and per row the copies."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    words = {n: sum(z for z, r in zip(size, rows) if r[3] == n) for n in names}
    target = fill(sum(size), {n: cycle[i % len(cycle)] for i, n in enumerate(names)}, {n: most * words[n] for n in names})
    copies, seen = [0] * len(rows), {}
    for n in names:
        own = [i for i, r in enumerate(rows) if r[3] == n]
        of = {}
        for i in own:
            of[weigh(size[i])] = of.get(weigh(size[i]), 0) + size[i]
        filled = fill(target[n], {w: w * z for w, z in of.items()}, {w: most * z for w, z in of.items()})
        e = {w: min(filled[w] / z, most) if z else 0.0 for w, z in of.items()}
        rest = target[n] - sum(int(e[w]) * z for w, z in of.items())
        units = []
        for i in own:
            seen[rows[i]] = tie = seen.get(rows[i], 0) + 1
            x = e[weigh(size[i])]
            p = x - int(x)
            copies[i] = int(x)
            if p > 0:
                u = draw(*rows[i][:2], tie)
                units.append((u * (1 - p) / (p * (1 - u)), i))
        upto, cut = 0, None
        for q, i in sorted(units):
            upto += size[i]
            cut = q if upto - size[i] / 2 <= rest else cut
        for q, i in units:
            copies[i] += cut is not None and q <= cut
        # The last change: one document to the other side, if that brings the source nearer.
        gap = rest - sum(size[i] for q, i in units if cut is not None and q <= cut)
        sides = [(abs(size[i] - abs(gap)), q, i) for q, i in units if (cut is not None and q <= cut) == (gap < 0)]
        if sides and min(sides)[0] < abs(gap):
            copies[min(sides)[2]] += 1 if gap > 0 else -1
    return size, words, target, copies


ROWS = [(i, "w " * (1 + i * 7 % 23), "en", f"s{i % 5}" if i % 3 else "hot") for i in range(240)]
ROWS += [(5000, "x " * 900, "en", "hot"), (5001, None, "en", "hot"), (5002, "", "en", "none"), (5003, "a b", "en", None), (None, "c d e", "en", None), (7, "w " * 4, "en", "s2"), (7, "w " * 4, "en", "s2")]


@pytest.mark.parametrize("by_length", [False, True])
def test_against_plain(spark, by_length):
    weight = mixing.by_length(F.col("text")) if by_length else None
    got = mixing.mix_report(frame(spark, ROWS), weight=weight).collect()
    size, words, target, copies = plain(ROWS, weigh=(lambda z: max(1, z.bit_length())) if by_length else (lambda z: 1))
    want = sorted((str(r[0]), z, words[r[3]], round(target[r[3]], 6), z * c) for r, z, c in zip(ROWS, size, copies))
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == want
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r.size
    for r in got:
        assert abs(taken[r.source] - r.target) <= (450 if r.source == "hot" else 12)
    again = mixing.mix_report(frame(spark, ROWS[::-1]), weight=weight).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = frame(spark, ROWS).withColumn("size", F.lit("mine")).withColumn("copies", F.lit("too"))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    _, _, _, copies = plain(ROWS)
    want = {}
    for r, c in zip(ROWS, copies):
        want[(r[0], r[1])] = want.get((r[0], r[1]), 0) + c
    got = {}
    for r in out.collect():
        assert r["size"] == "mine" and r["copies"] == "too"
        got[(r.doc_id, r.text)] = got.get((r.doc_id, r.text), 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_weights_give_unequal_probabilities(spark):
    rows = [(i, "one two three four", "en", "s") for i in range(4000)]
    docs = frame(spark, rows).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    got = mixing.mix_report(docs, share=0.4, weight="w").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("copies").alias("c"), F.sum("taken").alias("t")).collect()
    rate = {r.odd: r.c for r in got}
    assert rate[0] == pytest.approx(0.6, abs=0.05) and rate[1] == pytest.approx(0.2, abs=0.05)
    assert sum(r.t for r in got) == pytest.approx(6400, abs=4)


def test_rows_without_id_have_their_own_draws(spark):
    """A third of all rows has no id, and some of those repeat a text: targets are met as with ids."""
    rows = [(i if i % 3 else None, "word " * (1 + i % 40), "en", f"s{i % 4}") for i in range(1200)]
    rows += [(None, "same text again", "en", "s1")] * 300
    taken, target = {}, {}
    for r in mixing.mix_report(frame(spark, rows).repartition(7)).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 2.0 for s in target)  # sizes of a source lie 4 apart from 4 or less on
    _, _, _, copies = plain(rows)
    out = mixing.mix(frame(spark, rows).repartition(7)).groupBy("doc_id", "text", "source").count().collect()
    want = {}
    for r, c in zip(rows, copies):
        want[(r[0], r[1], r[3])] = want.get((r[0], r[1], r[3]), 0) + c
    assert {(r.doc_id, r.text, r.source): r["count"] for r in out} == {k: c for k, c in want.items() if c}


def test_inclusion_rates_by_length(spark):
    """Ranks with unequal odds: of each length, about e documents are taken, more of the longer ones."""
    rows = [(i, "w " * (3 if i % 2 else 48), "en", "s") for i in range(6000)]
    got = mixing.mix_report(frame(spark, rows), share=0.5, weight=mixing.by_length(F.col("text"))).groupBy("size").agg(F.avg("copies").alias("c")).collect()
    e = fill(0.5 * 51 * 3000, {2: 2 * 9000, 6: 6 * 144000}, {2: 3 * 9000, 6: 3 * 144000})
    rate = {r["size"]: r.c for r in got}
    assert rate[3] == pytest.approx(e[2] / 9000, abs=0.03) and rate[48] == pytest.approx(e[6] / 144000, abs=0.03)
    assert rate[48] > 2 * rate[3]


def test_very_long_text(spark):
    rows = [(1, "w " * 400_000, "en", "a"), (2, "w " * 10, "en", "a"), (3, "w " * 7, "en", "b"), (4, "w" * 500_000, "en", "b")]
    got = {r.doc_id: r for r in mixing.mix_report(frame(spark, rows)).collect()}
    size, words, target, copies = plain(rows)
    assert [(got[i + 1].size, got[i + 1].taken) for i in range(4)] == [(z, z * c) for z, c in zip(size, copies)]


def test_empty_and_wordless(spark):
    assert mixing.mix_report(frame(spark, [])).collect() == []
    assert mixing.mix(frame(spark, [])).collect() == []
    got = mixing.mix_report(frame(spark, [(1, None), (2, " ")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
