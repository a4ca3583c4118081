"""Document fingerprints by one-permutation MinHash.

A text's shingles (``SHINGLE`` words, A-Z lowered; of fewer words the whole sequence) are hashed once; the hash's leading bits name
one of ``BINS`` bins, which keeps its least hash. Empty bins are filled by optimal densification: each takes the value of a
filled bin that its own pseudo-random order of all bins names first, so a pair of texts agrees in a filled bin as likely as
in any. The fingerprint is the low ``BITS`` bits of all bins, packed. Two fingerprints agree in a bin with probability
J + (1 - J) / 2^BITS for texts of Jaccard similarity J; ``likeness`` takes the chance part out.

``edited_pairs`` compares each document with an edited text of its own and with the next document by id. Rows are dealt by ranges of the id
and sorted inside them; a task compares neighbours as they pass and holds one row back; the neighbours across ranges
(two rows per range) are joined by the number of the range.

Defined cases: null reads as empty; a text without words has the empty fingerprint, alike (1) to another of them and to nothing
else (0); equal texts have equal fingerprints; rows without an id come last in descending order, rows that share an id go by their text's hash; a table of
one row has itself as next document; an empty table gives an empty result; texts of any length are hashed piece by piece; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pairsim.llm.shared import store

SHINGLE, BINS, BITS = 5, 512, 4
#: Words of a text whose shingles are hashed at once, and documents whose bins are.
PIECE, DOCS = 65_536, 512
EMPTY = np.uint64(2**64 - 1)
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, size: int = SHINGLE, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of the text's word shingles, piece by piece: a polynomial of the words' XXH64, mixed."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes.split: the six ASCII spaces
    width = min(size, len(words))
    for at in range(0, len(words) - width + 1 if words else 0, PIECE):
        part = words[at:at + PIECE + width - 1]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(seed)), np.uint64, len(part))
        n = len(part) - width + 1
        total = np.zeros(n, np.uint64)
        for i in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
        yield _mix(total)


def probe_order(bins: int, seed: int) -> np.ndarray:
    """Row i: the place of each bin in the order in which empty bin i asks for a value."""
    i = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
    return np.argsort(np.argsort(_mix(i * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)), axis=1, kind="stable"), axis=1, kind="stable").astype(np.int32)


class Printer:
    """Fingerprints of texts with fixed parameters."""

    def __init__(self, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS, seed: int = 42) -> None:
        if bins & (bins - 1) or bins < 2:
            raise ValueError("bins must be a power of two")
        if 8 % bits or bins * bits % 8:
            raise ValueError("bits must divide 8 and the bins fill whole bytes")
        self.shingle, self.bins, self.bits, self.seed = shingle, bins, bits, seed
        self.place = probe_order(bins, seed)
        self.first = np.argsort(self.place, axis=1).T.copy()  # row t: whom each bin asks at its t-th attempt

    def __reduce__(self):
        return Printer, (self.shingle, self.bins, self.bits, self.seed)

    def minima(self, texts: list[str]) -> np.ndarray:
        """Per text the least hash of every bin (``EMPTY``: none)."""
        low, shift = np.full((len(texts), self.bins), EMPTY), np.uint64(64 - (self.bins - 1).bit_length())
        for row, text in zip(low, texts):
            for h in shingles(text, self.shingle, self.seed):
                np.minimum.at(row, (h >> shift).astype(np.int64), h)
        return low

    def densify(self, low: np.ndarray) -> np.ndarray:
        """Fills the empty bins of rows that have a filled one."""
        full = low != EMPTY
        out = low.copy()
        row, hole = np.nonzero(~full & full.any(axis=1)[:, None])
        for t in range(8):
            if not len(row):
                break
            asked = self.first[t][hole]
            found = full[row, asked]
            out[row[found], hole[found]] = low[row[found], asked[found]]
            row, hole = row[~found], hole[~found]
        # Rows with few filled bins: the filled bin that comes first in the order, without asking the others.
        edges = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, np.int64)
        for a, z in zip(edges, [*edges[1:], len(row)]):
            r, holes = row[a], hole[a:z]
            filled = np.flatnonzero(full[r])
            out[r, holes] = low[r, filled[self.place[np.ix_(holes, filled)].argmin(axis=1)]]
        return out

    def pack(self, low: np.ndarray) -> list[bytes]:
        """The low bits of all bins as bytes; of rows without a filled bin, no byte."""
        value = (low & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        planes = (value[:, :, None] >> np.arange(self.bits - 1, -1, -1, dtype=np.uint8)) & 1
        rows = np.packbits(planes.reshape(len(low), -1), axis=1)
        return [r.tobytes() if n else b"" for r, n in zip(rows, (low != EMPTY).any(axis=1))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [p for at in range(0, len(texts), DOCS) for p in self.pack(self.densify(self.minima(texts[at:at + DOCS])))]

    def likeness(self, a: list[bytes], b: list[bytes]) -> np.ndarray:
        """Estimated Jaccard similarity of pairs of fingerprints, 0 to 1."""
        out = np.array([float(x == y) for x, y in zip(a, b)])
        both = [i for i, (x, y) in enumerate(zip(a, b)) if x and y]
        if both:
            values = [np.unpackbits(np.frombuffer(b"".join(s[i] for i in both), np.uint8)).reshape(len(both), self.bins, self.bits) for s in (a, b)]
            agree, chance = (values[0] == values[1]).all(axis=2).mean(axis=1), 0.5**self.bits
            out[both] = np.clip((agree - chance) / (1 - chance), 0.0, 1.0)
        return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (binary) of every row; no shuffle."""
    printer = Printer(shingle, bins, bits, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(printer(b.column(1).to_pylist()), pa.binary())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint binary")


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The likeness of two columns of fingerprints with the same parameters."""
    printer = Printer(bins=bins, bits=bits)

    @pandas_udf("double")
    def run(x, y):
        import pandas as pd

        return pd.Series(printer.likeness([bytes(v) for v in x], [bytes(v) for v in y]))

    return run(a, b)


def edited(text: str, following: str, parts: int = 3) -> str:
    """The text whose last 1/``parts`` of code points (rounded down) are replaced by the first as many of the following one."""
    n = len(text) // parts
    return text[:len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, side int, text string"


def edited_pairs(docs: DataFrame, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS, seed: int = 42) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs``.

    The edit and the neighbour come from the next row in descending order of doc_id; the last one's next is the first.
    """
    printer = Printer(shingle, bins, bits, seed)

    def facts(ids: list, texts: list[str], prints: list[bytes], following: list[str], next_prints: list[bytes]) -> dict:
        changed = [edited(t, f) for t, f in zip(texts, following)]
        changed_prints = printer(changed)
        return {"doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed], "fingerprint": prints,
                "edited_fingerprint": changed_prints, "near_edited": printer.likeness(prints, changed_prints), "near_next": printer.likeness(prints, next_prints)}

    def batch(part: object, cols: dict, side: int | None = None, text: str | None = None) -> pa.RecordBatch:
        n = len(cols["doc_id"])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        arrays = [pa.array(c, k) for c, k in zip(cols.values(), kinds)]
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), *arrays, pa.array([side] * n, pa.int32()), pa.array([text] * n, pa.string())],
                                          names=["part", *cols, "side", "text"])

    def whole(doc_id: int | None, text: str, fingerprint: bytes) -> dict:
        return {"doc_id": [doc_id], "n_chars": [None], "edited_sha256": [None], "fingerprint": [fingerprint], "edited_fingerprint": [None], "near_edited": [None], "near_next": [None]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, None
        for b in batches:
            for at in range(0, b.num_rows, DOCS):
                ids, texts = (b.column(i).slice(at, DOCS).to_pylist() for i in (0, 1))
                prints = printer(texts)
                if held is None:  # the range's first row, for the range before
                    part = b.column(2)[0].as_py()
                    yield batch(part, whole(ids[0], texts[0], prints[0]), 0, texts[0])
                else:
                    ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
                held = ids[-1], texts[-1], prints[-1]
                if len(ids) > 1:
                    yield batch(part, facts(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:]))
        if held is not None:  # the range's last row waits for the range behind
            yield batch(part, whole(*held), 1, held[1])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(None, facts(*(c.to_pylist() for c in b.columns)))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h").asc(), F.col("_row").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    out = store(dealt.mapInArrow(run, "part int, " + OUT), "oph-pairs")
    # Two rows per range are left: its first and its last.
    edge = out.where("side is not null").select("part", "side", "doc_id", "text", "fingerprint")
    parts = edge.where("side = 0").select("part")
    w = Window.orderBy("part")
    ring = parts.select("part", F.coalesce(F.lead("part").over(w), F.min("part").over(w)).alias("_next"))
    heads = edge.where("side = 0").select(F.col("part").alias("_next"), F.col("text").alias("following"), F.col("fingerprint").alias("next_print"))
    tails = edge.where("side = 1").join(ring, "part").join(heads, "_next").select("doc_id", "text", "fingerprint", "following", "next_print")
    closed = tails.mapInArrow(close, "part int, " + OUT)
    return out.where("side is null").unionByName(closed).drop("part", "side", "text")
