"""Target-distribution importance resampling by bit-sliced aggregation.

Features are a text's words and pairs of neighbouring words, each in one of ``buckets`` buckets by its CRC32. A bucket's gain
is the scaled log ratio of its smoothed share in the target texts to that in all documents. A document's weight is the exact
floored mean of its features' gains: its bucket counts are cut into bit planes (plane j has bucket b's bit if the count has bit
j), the gains into signed bit planes of two's complement, and the sum of count x gain is the sum over plane pairs of
2^(j + k) x popcount(count plane j AND gain plane k), the gains' top plane counted negative.

Documents are drawn by the largest weight plus Gumbel noise of their id, which is sampling without replacement with
odds exp(weight / SCALE). The draw's ranks come from a sort by ranges, never from a window over all rows.

The driver holds two counts per bucket (``buckets`` is a parameter), nothing that grows with the documents. Texts are read
twice, once for the corpus's counts and once for the weights, and are never shuffled or stored.

Defined cases: null and empty texts and texts without a word have no feature and weight 0; without target texts (or without
documents) the smoothing decides; a null doc_id draws noise as empty text and ranks after other ids of its score; repeated rows
are drawn each for itself, ties of score and id in the order of n_features, then any; documents of fewer than ``min_words``
words get no rank; an empty table gives an empty result; very long texts are cut into features piece by piece; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsim.llm.shared import numbered, store, text_slices

BUCKETS = 10_000
SCALE = 1000
#: Bytes of a text whose words are held at once, and documents whose counts are.
PIECE, DOCS = 1_000_000, 256
#: Bytes: A-Z lowered, ASCII that is neither digit nor letter to a space.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def features(text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
    """Per piece of the text: its number of words, and the CRC32 of its words and of the word pairs that end in it."""
    plain, at, last = (text or b"").translate(TABLE), 0, None
    while at < len(plain):
        end = plain.find(b" ", at + PIECE) if len(plain) - at > PIECE else -1
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        at = end
        if not words:
            continue
        ones = list(map(crc32, words))
        # The CRC32 of "a b" goes on from that of "a ".
        before = ones[:-1] if last is None else [last, *ones[:-1]]
        pairs = list(map(crc32, words[len(words) - len(before):], map(crc32, repeat(b" "), before)))
        last = ones[-1]
        yield len(words), np.array(ones + pairs, np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The number of features of all texts in each bucket; ``texts`` has text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                for _, codes in features(text.as_py()):
                    total += np.bincount(codes % buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    binary = texts.select(F.col("text").cast("string").cast("binary").alias("text"))
    out = np.zeros(buckets, np.int64)
    for r in binary.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of the smoothed share in the target over that in the corpus), per bucket."""
    n, big_s, big_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(scale * math.log(float((t + 1) * (big_s + n)) / float((s + 1) * (big_t + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 as rows of 64-bit words."""
    rows = np.packbits(bits, axis=1)
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8))).view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gains' bit planes and what a bit of each is worth: two's complement, the top plane negative."""
    width = int(max(gain.max(initial=0), -gain.min(initial=0) - 1)).bit_length() + 1
    planes = _packed(np.stack([(gain >> k) & 1 for k in range(width)]).astype(np.uint8))
    return planes, np.array([1 << k for k in range(width - 1)] + [-(1 << (width - 1))], np.int64)


def gain_sums(counts: np.ndarray, planes: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Per row of bucket counts, the exact sum of count x gain from popcounts of ANDed planes."""
    out, top = np.zeros(len(counts), np.int64), counts.max(axis=1, initial=0)
    for j in range(int(top.max(initial=0)).bit_length()):
        rows = np.flatnonzero(top >> j)
        plane = _packed(((counts[rows] >> j) & 1).astype(np.uint8))
        for gain, value in zip(planes, worth):
            out[rows] += (np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) * value) << j
    return out


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    planes, worth = gain_planes(gain)
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            for at in range(0, len(ids), DOCS):
                part = texts.slice(at, DOCS)
                counts, n_words = np.zeros((len(part), buckets), np.int32), np.zeros(len(part), np.int64)
                for i, text in enumerate(part):
                    for n, codes in features(text.as_py()):
                        n_words[i] += n
                        counts[i] += np.bincount(codes % buckets, minlength=buckets).astype(np.int32)
                n = counts.sum(axis=1, dtype=np.int64)
                weight = np.where(n > 0, gain_sums(counts, planes, worth) // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([ids.slice(at, DOCS), pa.array(n_words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, scale: int = SCALE) -> Column:
    """Scaled Gumbel noise of doc_id: floor(-scale * ln(-ln u)), u from the first 32 bits of a SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-float(scale)) * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (of the drawn) for every row of ``docs``; ``target`` has text.

    Of the documents with ``min_words`` words, ``percent`` % are drawn (rounded down).
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), scale)
    rows = store(weights(docs, gain), "resample-weights").withColumn("score", F.col("weight") + noise(seed, scale))
    rows = rows.withColumn("_fits", F.col("n_words") >= min_words).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("_fits").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("_row").asc()]
    n = rows.where("_fits").count()
    out = numbered(rows, order, "_no", "resample-order")
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_fits") & (F.col("_no") <= n * percent // 100), F.col("_no")).alias("rank"))
