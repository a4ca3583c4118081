"""Token ids in fixed-width bit-packed files, with block offsets for vectorised and random access.

Texts are encoded where Spark's range partitioning by ``doc_id`` put them; every partition writes its documents in
order as files of about ``FILE_IDS`` ids. A file is one binary value of a Parquet row, so that Spark's writers carry it to any
store; its bytes are complete in themselves:

    magic "BPK1" | width u32 | block u32 | n_docs u32 | n_ids u64 | n_blocks u64
    doc starts u64 * (n_docs + 1) | block byte offsets u64 * (n_blocks + 1) | packed blocks

All numbers are little-endian. A block holds ``BLOCK`` ids of ``width`` bits each (the fewest that hold the largest
vocabulary id), lowest bit first, and starts on a byte, so ids [i, j) unpack from their blocks alone.

Defined cases: null and empty texts have the end id only; null doc_ids come first; rows that repeat a doc_id each get
their own span, ordered by text; an empty table gives no files and an empty result; very long texts are encoded whole,
and a file holds at least one document.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairsim.llm.shared import store, text_slices

MAGIC = b"BPK1"
HEAD = struct.Struct("<4sIIIQQ")
BLOCK = 4096
FILE_IDS = 1_000_000
#: Characters of text encoded together; bounds a task's memory besides its longest text.
CHARS = 1_000_000
FILES = "part int, no int, n_docs int, n_ids long, content binary"
SPANS = "part int, no int, k int, doc_id long, local long, n_tokens long, ids_crc32 long"


def bit_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as ``width`` bits each, lowest bit first, padded to a byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros((n, 32), np.uint8)
    out[:, :width] = bits
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


def to_file(ids: np.ndarray, starts: np.ndarray, width: int, block: int = BLOCK) -> bytes:
    """The bytes of one file. ``starts``: each document's first id, and the number of ids."""
    blocks = [pack(ids[i:i + block], width) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = HEAD.pack(MAGIC, width, block, len(starts) - 1, len(ids), len(blocks))
    return b"".join([head, starts.astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class PackedFile:
    """Reads ids of a packed file; only the blocks that a range touches are unpacked."""

    def __init__(self, data: bytes | memoryview) -> None:
        magic, self.width, self.block, self.n_docs, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        self.data, at = data, HEAD.size
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.body = at + 8 * (n_blocks + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = [unpack(self.data[self.body + self.offsets[b]:self.body + self.offsets[b + 1]], self.width, min(self.block, self.n_ids - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block:end - first * self.block]

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


#: Pieces that a worker remembers, each of at most PIECE characters; further ones are encoded each time.
MEMORY, PIECE = 100_000, 64


@cache
def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def _tokenizer(path: str) -> tuple[Tokenizer, dict[str, bytes]]:
    """The tokenizer and the pieces remembered so far, kept by a worker for its next tasks."""
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok, {}


class Encoder:
    """Whole texts to ids with a tokenizer file.

    A byte-level tokenizer that splits words before merging gives a text's ids as the ids of its pieces, when it is cut
    in front of single spaces between other characters. Pieces recur, so each distinct piece of a slice is looked up once.
    Texts in which a space touches another white space character are cut at the safe places only. A piece of Latin words, signs
    after them and single line ends between them is split like the tokenizer does (each is one unit there), and its words go
    straight to the merge model.
    """

    WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    UNSAFE = f"{WHITE} | {WHITE}|^ | $"
    CUT = re.compile(r"(?<=\S) (?=\S)")
    WORD = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
    SIGNS = r"[.,;:!?%$&*#|]"
    UNITS = re.compile(rf"({WORD.pattern}){SIGNS}*(?:\n[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+{SIGNS}*)*")
    UNIT = re.compile(rf"{WORD.pattern}|{SIGNS}+|\n")

    def __init__(self, path: str, as_pieces: bool = True) -> None:
        self.tok, self.known = _tokenizer(path)
        self.model, self.as_pieces = self.tok.model, as_pieces

    def _piece(self, piece: str) -> bytes:
        """A piece's ids as 32-bit numbers."""
        if self.as_pieces and self.WORD.fullmatch(piece):
            ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_byte_letters()))]
        elif self.as_pieces and self.UNITS.fullmatch(piece):
            units = self.UNIT.findall(piece)
            if len(units) > 1:
                return b"".join([x if (x := self.known.get(u)) is not None else self._piece(u) for u in units])
            ids = self.tok.encode(piece, add_special_tokens=False).ids
        else:
            ids = self.tok.encode(piece, add_special_tokens=False).ids
        found = array("I", ids).tobytes()
        if len(self.known) < MEMORY and len(piece) <= PIECE:
            self.known[piece] = found
        return found

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the end offset of each text."""
        known, piece = self.known.get, self._piece
        found = [x if (x := known(t)) is not None else piece(t) for t in texts]
        ends = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, out=ends[1:])
        return np.frombuffer(b"".join(found), np.uint32), ends

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and each text's number of ids. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.as_pieces:
            ids, ends = self._encode(texts.to_pylist())
            return ids, np.diff(ends)
        split = pc.split_pattern(texts, " ")
        unsafe = np.flatnonzero(pc.match_substring_regex(texts, self.UNSAFE).to_numpy(zero_copy_only=False))
        lens = np.diff(split.offsets.to_numpy())
        flat = split.flatten()
        if len(unsafe):
            rows, at, parts = np.concatenate([[0], np.cumsum(lens)]), 0, []
            for u in unsafe:
                own = self.CUT.split(texts[u].as_py())
                parts += [flat.slice(rows[at], rows[u] - rows[at]), pa.array(own, pa.large_string())]
                lens[u], at = len(own), u + 1
            flat = pa.concat_arrays([*parts, flat.slice(rows[at])])
        first = np.zeros(len(flat), bool)
        first[np.cumsum(lens)[:-1][lens[1:] > 0]] = True
        first[:1] = True
        # A text's first piece has no space in front: its code is told apart by a second dictionary.
        coded = pc.dictionary_encode(flat)
        index, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        heads, index_of_head = np.unique(index[first], return_inverse=True)
        ids, ends = self._encode([" " + w for w in words] + [words[h] for h in heads])
        index[first] = len(words) + index_of_head
        starts, n = ends[index], ends[index + 1] - ends[index]
        total = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat(starts - total[:-1], n) + np.arange(total[-1])]
        bounds = total[np.concatenate([[0], np.cumsum(lens)])]
        return out, np.diff(bounds)


def write_files(docs: DataFrame, path: str, end_id: int, parts: int | None = None, as_pieces: bool = True, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) in ascending doc_id order into packed files; returns them as stored: FILES."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, as_pieces)
        width = bit_width(enc.tok.get_vocab_size())
        part, no = TaskContext.get().partitionId(), 0
        held, counts, keys, n_held = [], [], [], 0

        def file() -> pa.RecordBatch:
            n = np.concatenate(counts)
            starts = np.concatenate([[0], np.cumsum(n)])
            # The doc ids lead the content: validity bytes, then the ids.
            ids = pa.concat_arrays(keys)
            known = pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.uint8)
            body = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype("<i8")
            content = known.tobytes() + body.tobytes() + to_file(np.concatenate(held), starts, width)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([len(n)], pa.int32()), pa.array([starts[-1]], pa.int64()), pa.array([content], pa.binary())], names=["part", "no", "n_docs", "n_ids", "content"])

        for doc_id, text in text_slices(batches, CHARS):
            ids, n = enc(text)
            # The end id after each document: shift every document's ids by the documents before it.
            out = np.full(len(ids) + len(n), end_id, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            held.append(out)
            counts.append(n + 1)
            keys.append(doc_id.cast(pa.int64()))
            n_held += len(out)
            if n_held >= file_ids:
                yield file()
                held, counts, keys, n_held, no = [], [], [], 0, no + 1
        if n_held:
            yield file()
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first()]
    rows = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    rows = rows.sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return store(rows.mapInArrow(encode, FILES), "tokens")


def read_spans(files: DataFrame) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one file at a time
                r = {c: b.column(c)[i].as_py() for c in ("part", "no", "n_docs")}
                n, content = r["n_docs"], memoryview(b.column("content")[i].as_buffer())
                known = np.frombuffer(content, np.uint8, n).astype(bool)
                keys = np.frombuffer(content, "<i8", n, n)
                f = PackedFile(content[9 * n:])
                ids = f.ids(0, f.n_ids).astype("<u4")
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(f.starts[:-1], f.starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["part"], np.int32)), pa.array(np.full(n, r["no"], np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(keys, pa.int64(), mask=~known), pa.array(f.starts[:-1]), pa.array(np.diff(f.starts)), pa.array(crc, pa.int64())], names=["part", "no", "k", "doc_id", "local", "n_tokens", "ids_crc32"])

    # One row per file: totals per partition first, then inside each partition.
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", before("all", Window.orderBy("part")).alias("base"))
    at = files.select("part", "no", "n_ids").join(sizes, "part")
    at = store(at.select("part", "no", (F.col("base") + before("n_ids", Window.partitionBy("part").orderBy("no"))).alias("file_start")), "token-index")
    spans = files.select("part", "no", "n_docs", "content").mapInArrow(decode, SPANS)
    return spans.join(at, ["part", "no"]).select("doc_id", (F.col("file_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, path: str, end_id: int, **options: object) -> DataFrame:
    return read_spans(write_files(docs, path, end_id, **options))
