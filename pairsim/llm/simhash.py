"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are the leaves of a binary trie. The self-join walks pairs of nodes downwards together, adds the bits in which
they differ, and drops a pair once that exceeds the error budget. For Spark the walk is cut into independent node pairs:
with budget b, the 64 bits are read in b + 1 rotations, so every linked pair shares all leading bits (one of b + 1 blocks)
in at least one of them. Each rotation's nodes at that depth are the tasks' units, and the walk goes on below them with
the whole budget. A node with more than ``NODE_ROWS`` fingerprints is cut again: at ``k`` more bits, its node pairs within the
budget are units of their own, so a hot node costs 1 + k + k(k-1)/2 copies of a row, not a copy for each other row.

Only distinct fingerprints enter the join, and a unit returns a spanning forest of its links instead of all pairs. Components
come from large-star / small-star rounds on those edges, each cut by a checkpoint.

Defined cases: null text has no words; a text without words has fingerprint zero and is linked like any other; repeated rows
and ids get a row each; null doc_ids get a component like others but never name one unless all of it is null; an
empty table gives an empty result; extra columns are ignored by ``components`` and kept by ``deduplicate``, which keeps exactly
one row of each component, whatever ids its rows share with other components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsim.llm.shared import KEY, among, store, text_key
from pairsim.session import ensure_checkpoint_dir

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
BITS = 64
#: Fingerprints of a trie node that one task walks; a larger node is cut at more bits.
NODE_ROWS = 16384
CHUNK = 65536


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half the XXH64 of the text's word shingles."""
    words = WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower: A-Z only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(BITS, np.int64)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    for at in range(0, len(last), CHUNK):
        h = np.array([digest(joined[a:b - 1], seed) for a, b in zip(starts[at:at + CHUNK], last[at:at + CHUNK])], "<u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * sums > len(last)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, keyed: bool = False) -> DataFrame:
    """doc_id, fp (the unsigned fingerprint's bits as a long); with ``keyed`` the columns that tell rows apart (KEY) instead of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *keys, texts = b.columns
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*keys, pa.array(fp.view(np.int64))], names=[*names, "fp"])

    keys = text_key() if keyed else [F.col("doc_id").cast("long").alias("doc_id")]
    names = KEY if keyed else ["doc_id"]
    kinds = [f"{n} {'boolean' if n == 'k_null' else 'long'}" for n in [*names, "fp"]]
    return docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(kinds))


def trie_pairs(values: np.ndarray, groups: list[tuple[int, int, int, int]], budget: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indexes whose values differ in at most ``budget`` bits, by walking node pairs of sorted values.

    ``groups``: node pairs (lo, hi, lo2, hi2) as ranges, sorted inside; the same range twice is a self pair. Bits
    above ``depth`` are counted as they are at the leaves: a walk starts with the bits that its nodes differ in.
    """
    a_lo, a_hi, b_lo, b_hi = np.array(groups, np.int64).reshape(-1, 4).T
    err = np.bitwise_count((values[a_lo] ^ values[b_lo]) >> np.uint64(BITS - depth)) if depth else np.zeros(len(a_lo), np.uint8)
    out_a, out_b = [], []
    for d in range(depth, BITS + 1):
        # Node pairs of few leaves are finished by comparing the leaves.
        small = ((a_hi - a_lo) * (b_hi - b_lo) <= 16) | (d == BITS)
        if small.any():
            na, nb = (a_hi - a_lo)[small], (b_hi - b_lo)[small]
            n = na * nb
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(nb, n)
            i, j = np.repeat(a_lo[small], n) + k // wide, np.repeat(b_lo[small], n) + k % wide
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            out_a.append(i[near])
            out_b.append(j[near])
            a_lo, a_hi, b_lo, b_hi, err = (x[~small] for x in (a_lo, a_hi, b_lo, b_hi, err))
        if not len(a_lo):
            break
        bit = np.uint64(1) << np.uint64(BITS - 1 - d)
        ones = np.concatenate([[0], np.cumsum((values & bit) == 0)])  # zeros so far: inside a node, zeros come first
        a_mid, b_mid = a_lo + ones[a_hi] - ones[a_lo], b_lo + ones[b_hi] - ones[b_lo]
        same = (a_lo == b_lo) & (a_hi == b_hi)
        halves = [(a_lo, a_mid, b_lo, b_mid, err), (a_mid, a_hi, b_mid, b_hi, err), (a_lo, a_mid, b_mid, b_hi, err + 1)]
        other = (a_mid[~same], a_hi[~same], b_lo[~same], b_mid[~same], err[~same] + 1)
        a_lo, a_hi, b_lo, b_hi, err = (np.concatenate(x) for x in zip(*halves, other))
        live = (a_lo < a_hi) & (b_lo < b_hi) & (err <= budget)
        a_lo, a_hi, b_lo, b_hi, err = (x[live] for x in (a_lo, a_hi, b_lo, b_hi, err))
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64),) * 2


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the links, without the smallest themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = ends[:len(a)], ends[len(a):], np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _units(fps: DataFrame, budget: int, node_rows: int) -> DataFrame:
    """Trie node pairs: r, node, p, q (sub-nodes), rot (the rotated fingerprint), side (0: of p, 1: of q, 2: both)."""
    sizes = [BITS // (budget + 1) + (1 if i < BITS % (budget + 1) else 0) for i in range(budget + 1)]
    lead = np.cumsum([0, *sizes])
    rotate = lambda c, n: F.shiftleft(c, n).bitwiseOR(F.shiftrightunsigned(c, BITS - n)) if n else c
    each = F.array(*[F.struct(F.lit(r).alias("r"), rotate(F.col("fp"), int(lead[r])).alias("rot")) for r in range(budget + 1)])
    rows = fps.select(F.explode(each).alias("x")).select("x.r", "x.rot")
    shift = F.element_at(F.array(*[F.lit(BITS - s) for s in sizes]), F.col("r") + 1)
    rows = rows.withColumn("node", F.call_function("shiftrightunsigned", F.col("rot"), shift))
    heavy = rows.groupBy("r", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(heavy, ["r", "node"])
    # More bits for larger nodes, from the node's own count.
    k = F.when(F.col("n") <= node_rows, 0).otherwise(F.least(F.ceil(F.log2(F.col("n") / F.lit(float(node_rows)))) + 2, F.lit(20))).cast("int")
    rows = rows.withColumn("k", k)
    low = F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.col("rot"), F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("r") + 1)), F.lit(BITS) - F.greatest("k", F.lit(1)))
    rows = rows.withColumn("own", F.when(F.col("k") > 0, low).otherwise(F.lit(0)))
    bits = F.sequence(F.lit(0), F.col("k") - 1)
    flips = F.array(F.lit(0).cast("long"))
    one = F.transform(bits, lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    masks, level = flips, flips
    for _ in range(budget):  # all masks of up to ``budget`` bits
        level = F.array_distinct(F.flatten(F.transform(level, lambda m: F.filter(F.transform(one, lambda o: m.bitwiseOR(o)), lambda x: x != m))))
        masks = F.array_union(masks, level)
    masks = F.when(F.col("k") > 0, masks).otherwise(flips)
    rows = rows.withColumn("flip", F.explode(masks))
    other = F.col("own").bitwiseXOR(F.col("flip"))
    return rows.select("r", "node", "k", F.least("own", other).alias("p"), F.greatest("own", other).alias("q"), "rot")


def links(fps: DataFrame, budget: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (a, b) of distinct fingerprints: enough to connect every pair that differs in at most ``budget`` bits."""
    sizes = [BITS // (budget + 1) + (1 if i < BITS % (budget + 1) else 0) for i in range(budget + 1)]
    lead = np.cumsum([0, *sizes])

    def walk(units: dict[str, np.ndarray]) -> pa.RecordBatch:
        """All units of some whole node pairs, sorted by their keys and then by value."""
        r, p, q, k, values = units["r"], units["p"], units["q"], units["k"], units["rot"].view(np.uint64)
        change = np.flatnonzero(np.any([units[c][1:] != units[c][:-1] for c in ("r", "node", "p", "q")], axis=0)) + 1
        lo, hi = np.concatenate([[0], change]), np.concatenate([change, [len(r)]])
        order = np.lexsort((values, np.repeat(np.arange(len(lo)), hi - lo)))
        values, out = values[order], []
        width, more = np.array(sizes)[r[lo]], k[lo].astype(np.int64)
        for depth in np.unique(width + more):
            pick = np.flatnonzero(width + more == depth)
            groups = []
            for g in pick:
                a, b, m = int(lo[g]), int(hi[g]), int(more[g])
                if m and p[a] != q[a]:  # rows of p come first: sub-nodes are the leading bits below the node
                    sub = (values[a:b] << np.uint64(int(width[g]))) >> np.uint64(BITS - m)
                    mid = a + int(np.searchsorted(sub, np.uint64(int(q[a]))))
                    if a < mid < b:
                        groups.append((a, mid, mid, b))
                elif b - a > 1:
                    groups.append((a, b, a, b))
            if groups:
                out.append(trie_pairs(values, groups, budget, int(depth)))
        i, j = (np.concatenate([o[s] for o in out]) for s in (0, 1)) if out else (np.zeros(0, np.int64),) * 2
        turn = lead[r].astype(np.uint64)
        plain = np.where(turn > 0, (values >> turn) | (values << (np.uint64(BITS) - np.maximum(turn, np.uint64(1)))), values).view(np.int64)
        a, b = forest(plain[i], plain[j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        keys = ("r", "node", "p", "q")
        for b in batches:
            if not b.num_rows:
                continue
            cols = {c: b.column(c).to_numpy() for c in keys}
            change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in cols.values()], axis=0))
            new = bool(held) and any(held[-1].column(c)[-1].as_py() != b.column(c)[0].as_py() for c in keys)
            if not len(change) and not new:
                held.append(b)
                continue
            cut = int(change[-1]) + 1 if len(change) else 0
            whole = pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
            if whole.num_rows:
                yield walk({c: whole.column(c).to_numpy() for c in (*keys, "k", "rot")})
        if held:
            whole = pa.Table.from_batches(held)
            yield walk({c: whole.column(c).to_numpy() for c in (*keys, "k", "rot")})

    units = _units(fps, budget, node_rows)
    spread = units.repartition("r", "node", "p", "q").sortWithinPartitions("r", "node", "p", "q")
    return spread.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of the edges, by alternating star rounds.

    A node's edges are only ever aggregated and joined, so a hub with many neighbours is not gathered in one place.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    while seen[0]:
        # Large star: every larger neighbour of a node is tied to the smallest one around it.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours and the node itself are tied to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = small.where("u <> v").distinct().checkpoint()
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(prints: DataFrame, first: Column, budget: int, node_rows: int) -> DataFrame:
    """fp, first (of its rows), root (one of its component's fingerprints) of every distinct fingerprint."""
    classes = store(prints.groupBy("fp").agg(first.alias("first")), "simhash-classes")
    roots = star_components(links(classes.select("fp"), budget, node_rows))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components(docs: DataFrame, shingle: int = 3, budget: int = 2, seed: int = 42, node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    prints = store(fingerprints(docs, shingle, seed), "simhash")
    in_one = _rooted(prints, F.min("doc_id"), budget, node_rows)
    least = in_one.groupBy("root").agg(F.min("first").alias("component_id"))
    # Only classes whose component is not their own need a second look-up.
    named = store(in_one.join(least, "root").select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-components")
    return prints.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = 3, budget: int = 2, seed: int = 42, node_rows: int = NODE_ROWS) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the smallest doc_id, and of its rows there a null text or the least text hash.

    Rows are told apart by (doc_id, text hashes), as an id, null too, may have texts in several components. Fingerprint classes
    name the row that stays, so a component of many rows meets only in partial minima; rows that go are the only ones
    that an exchange moves whole.
    """
    prints = store(fingerprints(docs, shingle, seed, keyed=True), "simhash")
    no_text = F.xxhash64(F.lit(None).cast("string"))
    order = F.struct("k_null", "k_id", (F.col("k_h") != no_text).alias("k_text"), "k_h", "k_g")
    stays = _rooted(prints, F.min(order), budget, node_rows).groupBy("root").agg(F.min("first").alias("first")).select(*[f"first.{c}" for c in KEY])
    rows = store(prints.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "simhash-keys")
    fates = rows.join(stays.withColumn("stays", F.lit(True)), KEY, "left").where("stays is null or n > 1")
    fates = store(fates, "simhash-fates")
    rest, some = among(docs, fates, text_key())
    some = some.join(fates, KEY, "left").where("n is null or stays")
    # Repeated rows of a document that stays: one by an aggregate that tasks combine before the shuffle.
    once = some.where("n is null").select("row.*")
    many = some.where("n is not null").groupBy(*KEY).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return rest.select("row.*").unionByName(once).unionByName(many)
