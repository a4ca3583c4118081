"""Merkle dataset manifest over bitmap-rank leaf coordinates.

A row's leaf is the SHA-256 of its fields; per group (source) the leaves in order of doc_id are the slots of a tree of
``FAN`` children a node, and the groups' roots in order of the groups are the slots of one more tree, whose root names the data set.

Coordinates come without sorting rows. Every task packs the ids it sees into containers of ``CHUNK`` ids (sorted positions, or a bitmap
where those are larger); a group's containers are merged per chunk, with a directory of popcounts inside the bitmap and the
number of rows before the chunk beside it. A row's rank is its chunk's offset plus the set bits below its own. Rows that
share an id are counted in the container; only they, and rows without an id, are put in order (by leaf).

Slots are keyed: a block holds ``FAN ** LEVELS`` neighbouring slots in packed arrays and is reduced ``LEVELS`` levels in one go, its root
being a slot of the block above. Paths go down the same way: a block gets the path of its root and adds its own levels.

Defined cases: null fields are written as such, a null id stands first in its group and a null group is the first group; rows that share
an id stand in the order of their leaves, and equal rows are equal leaves; a group of one row is its own subroot; an empty
table gives an empty result; a text of any length is one field; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsim.llm.shared import numbered, store

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, LEVELS = 3, 7
#: Ids of a container, and the positions up to which it stays a list (two bytes each against a bitmap's 512 bytes).
CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS
FEW = 128
#: Bits that an entry of a bitmap's directory covers, and chunks that one step of the offsets' sums does.
SPAN = 512
GROUP_BITS = 12
#: The chunk of rows without an id: below all others, as those are 64-bit ids without their last bits.
NO_ID = -(1 << 60)


def field(c: Column) -> Column:
    """``-`` if null, else byte count, ``:``, value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(fields[f]) for f in FIELDS]), 256)


def group_key(source: Column) -> Column:
    """The group as a text that is never null and sorts as the groups do: null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def containers(rows: DataFrame) -> DataFrame:
    """Per key and chunk of ids: few (sorted positions) or bitmap with its directory, again (pos, more) of repeated ids, n rows.

    ``rows`` has key, chunk, pos.
    """

    def pack(positions: np.ndarray) -> tuple[bytes | None, bytes | None]:
        if len(positions) <= FEW:
            return positions.astype("<u2").tobytes(), None
        bits = np.zeros(CHUNK, np.uint8)
        bits[positions] = 1
        return None, np.packbits(bits).tobytes()

    def unpack(few: bytes | None, bitmap: bytes | None) -> np.ndarray:
        return np.frombuffer(few, "<u2").astype(np.int64) if few is not None else np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8)))

    kind = pa.list_(pa.struct([("pos", pa.int32()), ("more", pa.int64())]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).dictionary_encode()
            names, code = key.dictionary, key.indices.to_numpy()
            chunk, pos = b.column(1).to_numpy(), b.column(2).to_numpy()
            order = np.lexsort((pos, chunk, code))
            code, chunk, pos = code[order], chunk[order], pos[order]
            edge = np.flatnonzero((code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            starts = np.concatenate([[0], edge]).astype(np.int64) if len(pos) else np.zeros(0, np.int64)
            out: list[list] = [[], [], []]
            for a, z in zip(starts, [*edge, len(pos)]):
                at, n = np.unique(pos[a:z], return_counts=True)
                more = np.flatnonzero(n > 1)
                for column, value in zip(out, (*pack(at), [{"pos": int(at[i]), "more": int(n[i]) - 1} for i in more])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(code[starts])), pa.array(chunk[starts]), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], kind)],
                                             names=["key", "chunk", "few", "bitmap", "again"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for parts in b.column(2):
                counts = np.zeros(CHUNK, np.int64)
                for p in parts.as_py():
                    counts[unpack(p["few"], p["bitmap"])] += 1
                    for r in p["again"]:
                        counts[r["pos"]] += r["more"]
                at = np.flatnonzero(counts)
                few, bitmap = pack(at)
                per_span = np.concatenate([[0], np.cumsum((counts > 0).reshape(-1, SPAN).sum(axis=1))])[:-1].tolist() if bitmap else None
                again = [{"pos": int(i), "more": int(counts[i]) - 1} for i in at[counts[at] > 1]]
                for column, value in zip(out, (at.tolist() if few is not None else None, bitmap, per_span, again, int(counts.sum()))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], kind), pa.array(out[4], pa.int64())],
                                             names=["key", "chunk", "few", "bitmap", "directory", "again", "n"])

    again = "array<struct<pos:int,more:bigint>>"
    parts = rows.select("key", "chunk", "pos").mapInArrow(split, f"key string, chunk long, few binary, bitmap binary, again {again}")
    lists = parts.groupBy("key", "chunk").agg(F.collect_list(F.struct("few", "bitmap", "again")).alias("parts"))
    merged = lists.mapInArrow(merge, f"key string, chunk long, few array<int>, bitmap binary, directory array<int>, again {again}, n long")
    return store(merged, "merkle-containers")


def offsets(chunks: DataFrame) -> DataFrame:
    """Adds ``before``, the rows of the key's earlier chunks, summed in two steps so that no window holds all chunks of a key, and ``n``, the key's rows."""
    rows = chunks.withColumnRenamed("n", "own").withColumn("step", F.shiftright("chunk", GROUP_BITS))
    steps = rows.groupBy("key", "step").agg(F.sum("own").alias("own"))
    w = Window.partitionBy("key").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(F.col("key").alias("_k"), F.col("step").alias("_s"), F.coalesce(F.sum("own").over(w), F.lit(0)).alias("_base"), F.sum("own").over(Window.partitionBy("key")).alias("n"))
    w = Window.partitionBy("key", "step").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("own").over(w), F.lit(0)))
    rows = rows.join(steps, (F.col("key") == F.col("_k")) & (F.col("step") == F.col("_s")))
    return store(rows.withColumn("before", F.col("_base") + F.col("_in")).drop("own", "step", "_k", "_s", "_base", "_in"), "merkle-offsets")


def below() -> Column:
    """Rows of the container whose id is less than the one at ``pos``."""
    from_span = F.expr(f"substring(bitmap, cast(floor(pos / {SPAN}) as int) * {SPAN // 8} + 1, cast(floor(pos / 8) as int) % {SPAN // 8})")
    own = F.conv(F.hex(F.expr("substring(bitmap, cast(floor(pos / 8) as int) + 1, 1)")), 16, 10).cast("int")
    bits = F.bit_count(F.call_function("shiftright", own, F.lit(8) - F.col("pos") % 8))
    dense = F.element_at("directory", F.floor(F.col("pos") / SPAN).cast("int") + 1) + F.bitmap_count(from_span) + bits
    sparse = F.array_position("few", F.col("pos")) - 1
    again = F.aggregate(F.filter("again", lambda r: r["pos"] < F.col("pos")), F.lit(0).cast("long"), lambda s, r: s + r["more"])
    return F.when(F.col("bitmap").isNotNull(), dense).otherwise(sparse).cast("long") + again


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows`` (key, doc_id, leaf, ...) with ``slot`` in their key and ``n``, the key's rows."""
    at = rows.withColumn("chunk", F.coalesce(F.shiftright("doc_id", CHUNK_BITS), F.lit(NO_ID))).withColumn("pos", F.coalesce(F.col("doc_id").bitwiseAND(CHUNK - 1), F.lit(0)).cast("int"))
    found = at.join(offsets(containers(at)), ["key", "chunk"]).withColumn("slot", F.col("before") + below())
    found = found.withColumn("tied", F.exists("again", lambda r: r["pos"] == F.col("pos"))).drop("few", "bitmap", "directory", "again", "before")
    found = store(found, "merkle-slots")
    ties = found.where("tied")
    if not ties.isEmpty():
        # Rows that share an id: numbered by leaf in all, each from the first of its id.
        ties = numbered(ties.withColumn("_row", F.monotonically_increasing_id()), [F.col(c).asc() for c in ("key", "slot", "leaf", "_row")], "_no", "merkle-ties")
        first = ties.groupBy(F.col("key").alias("_k"), F.col("slot").alias("_s")).agg(F.min("_no").alias("_first"))
        ties = ties.join(first, (F.col("key") == F.col("_k")) & (F.col("slot") == F.col("_s"))).withColumn("slot", F.col("slot") + F.col("_no") - F.col("_first"))
        found = found.where("not tied").unionByName(ties.select(*found.columns))
    return found.drop("chunk", "pos", "tied")


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def reduce_block(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The block's nodes level by level, its slots first; digests are hex text."""
    out = [nodes]
    for _ in range(levels):
        nodes = [sha256(b"".join(nodes[i:i + FAN])).hexdigest().encode() for i in range(0, len(nodes), FAN)]
        out.append(nodes)
    return out


def path_of(nodes: list[list[bytes]], at: int) -> list[tuple[bytes, bytes]]:
    """Per level the digests left and right of the node over slot ``at`` in its run."""
    out = []
    for level in nodes[:-1]:
        first = at - at % FAN
        out.append((b"".join(level[first:at]), b"".join(level[at + 1:first + FAN])))
        at //= FAN
    return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        digest = sha256(left + digest + right).hexdigest().encode()
    return digest


PATH = "array<struct<l:binary,r:binary>>"
_PATH = pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))


def _levels_here(n: int, stage: int, levels: int) -> int:
    return min(levels, height(n) - levels * stage)


def blocks_of(slots: DataFrame, extra: list[str], levels: int, what: str) -> DataFrame:
    """Slots (key, n, slot, leaf, ``extra``) as blocks: key, n, block, slots (sorted by slot), stored."""
    at = slots.withColumn("block", F.floor(F.col("slot") / FAN**levels).cast("long"))
    packed = at.groupBy("key", "n", "block").agg(F.sort_array(F.collect_list(F.struct("slot", "leaf", *extra))).alias("slots"))
    return store(packed, what)


def block_roots(blocks: DataFrame, stage: int, levels: int) -> DataFrame:
    """key, n, slot (the block's), leaf (its root): the slots of the stage above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = [reduce_block([x.encode() for x in leaves.as_py()], _levels_here(n.as_py(), stage, levels))[-1][0].decode() for n, leaves in zip(b.column(1), b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(roots, pa.string())], names=["key", "n", "slot", "leaf"])

    return blocks.select("key", "n", F.col("block").alias("slot"), F.col("slots.leaf").alias("leaves")).mapInArrow(run, "key string, n long, slot long, leaf string")


def build(slots: DataFrame, n_most: int, extra: list[str], levels: int, what: str) -> tuple[list[DataFrame], DataFrame]:
    """The stages' blocks from the leaves up, and every key's root (key, root). ``slots``: key, n, slot, leaf, extra."""
    stages, roots = [], []
    for stage in range(max(1, math.ceil(height(n_most) / levels))):
        blocks = blocks_of(slots, extra if stage == 0 else [], levels, f"{what}-blocks")
        stages.append(blocks)
        up = store(block_roots(blocks, stage, levels), f"{what}-roots")
        # A tree ends where all its slots are one block.
        alone = F.col("n") <= FAN ** (levels * (stage + 1))
        roots.append(up.where(alone).select("key", F.col("leaf").alias("root")))
        slots = up.where(~alone)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return stages, out


def _ups(leaves: list[str], depth: int, up: list[dict]) -> list[list[dict]]:
    """Per slot of a block its path to the root of all: the block's levels, then ``up``."""
    nodes = reduce_block([x.encode() for x in leaves], depth)
    return [[{"l": a, "r": z} for a, z in path_of(nodes, i)] + up for i in range(len(leaves))]


def paths(stages: list[DataFrame], top: DataFrame, levels: int, what: str) -> DataFrame:
    """The blocks of the leaves with ``up``, the path from the block's root to the root of all; ``top``: key, up (of the key's root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, n, stage, leaves, slots, up in zip(*(b.column(i).to_pylist() for i in range(6))):
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(leaves)), pa.array(slots, pa.int64()), pa.array(_ups(leaves, _levels_here(n, stage, levels), up), _PATH)], names=["key", "block", "up"])

    above = None
    for stage in range(len(stages) - 1, -1, -1):
        # Trees that end at this stage start from the top, others from the block above.
        ends = F.col("n") <= FAN ** (levels * (stage + 1))
        own = stages[stage].where(ends).join(top, "key")
        if above is not None:
            own = own.unionByName(stages[stage].where(~ends).join(above, ["key", "block"]))
        if stage:
            down = own.select("key", "n", F.lit(stage).alias("stage"), F.col("slots.leaf"), F.col("slots.slot"), "up")
            above = store(down.mapInArrow(run, f"key string, block long, up {PATH}"), f"{what}-paths")
    return own


def group_paths(subroots: DataFrame, n_groups: int, levels: int) -> DataFrame:
    """key, subroot, root, up (from the subroot to the root) of every group; ``subroots``: key, root."""
    slots = numbered(subroots, [F.col("key").asc()], "slot", "merkle-order")
    slots = slots.select(F.lit("").alias("key"), F.lit(n_groups).cast("long").alias("n"), (F.col("slot") - 1).alias("slot"), F.col("root").alias("leaf"), F.col("key").alias("group"))
    stages, root = build(slots, n_groups, ["group"], levels, "merkle-top")
    blocks = paths(stages, root.select("key", F.array().cast(PATH).alias("up")), levels, "merkle-top").join(root, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, slots, up, root in zip(*(b.column(i).to_pylist() for i in range(4))):
                leaves = [s["leaf"] for s in slots]
                yield pa.RecordBatch.from_arrays([pa.array([s["group"] for s in slots]), pa.array(leaves), pa.array([root] * len(slots)), pa.array(_ups(leaves, _levels_here(n, 0, levels), up), _PATH)], names=["key", "subroot", "root", "up"])

    return store(blocks.select("n", "slots", "up", "root").mapInArrow(run, f"key string, subroot string, root string, up {PATH}"), "merkle-tops")


def manifest(docs: DataFrame, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, slot, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs`` (``FIELDS``).

    ``changed`` is the text that is verified against the manifest (as it is stored, if not given); ``levels`` those of a block.
    """
    cols = {f: F.col(f) for f in FIELDS}
    seen = leaf(cols if changed is None else {**cols, "text": changed})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group_key(F.col("source")).alias("key"), leaf(cols).alias("leaf"), seen.alias("seen"))
    slots = coordinates(store(rows, "merkle-leaves"))
    most = slots.agg(F.max("n").alias("n")).first().n
    stages, subroots = build(slots, most or 0, ["doc_id", "seen"], levels, "merkle")
    subroots = store(subroots, "merkle-subroots")
    tops = group_paths(subroots, subroots.count(), levels)
    blocks = paths(stages, tops.select("key", "up"), levels, "merkle").join(tops.drop("up"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, n, slots, up, subroot, root in zip(*(b.column(i).to_pylist() for i in range(6))):
                leaves = [s["leaf"].encode() for s in slots]
                nodes = reduce_block(leaves, _levels_here(n, 0, levels))
                above = [(p["l"], p["r"]) for p in up]
                proofs, folded = [], []
                for i, s in enumerate(slots):
                    path = path_of(nodes, i) + above
                    proofs.append(sha256(b"".join(a + z for a, z in path)).hexdigest())
                    folded.append(fold(s["seen"].encode(), path).decode())
                m = len(slots)
                source = None if key == "-" else key[1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s["doc_id"] for s in slots], pa.int64()), pa.array([source] * m, pa.string()), pa.array([s["slot"] for s in slots], pa.int64()), pa.array([s["leaf"] for s in slots]),
                     pa.array([subroot] * m), pa.array([root] * m), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])],
                    names=["doc_id", "source", "slot", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return blocks.select("key", "n", "slots", "up", "subroot", "root").mapInArrow(
        run, "doc_id long, source string, slot long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
