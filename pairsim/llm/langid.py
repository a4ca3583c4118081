"""Language identification by bit-sliced Bloom filters over character trigrams.

One table holds the Bloom filters of all languages: entry i has bit l set if language l's filter has bit i. AND-ing the
entries of a trigram's ``HASHES`` hashes yields at once the set of all languages that contain it. A document's trigrams are
looked up together, counted per language, corrected for each filter's false-positive rate (its fill to the power of the
hashes), and the language with the largest corrected share decides.

A trigram enters a language's filter if it is there ``MIN_COUNT`` times or more in the training sample, at ``MIN_SHARE`` or more
of the rate of the language where it is commonest, so that foreign passages don't fill filters. The fit uses a
sample of about ``sample_docs`` documents (a documented bound); every document is scored, over its whole text.

Defined cases: ``und`` with score 0 for null texts, texts without a letter, and when no language was learned; documents of null
lang take no part in the fit; ties go to the first language by code point; repeated rows get a row each; an empty table
gives an empty result; extra columns are ignored; very long texts are read whole, in pieces. At most 64 languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsim.llm.shared import bounded_sample, store, text_slices

SLOT_BITS = 18
HASHES = 3
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
MIN_COUNT, MIN_SHARE = 3, 0.2
SAMPLE_DOCS = 40_000
#: Characters in one piece; bounds a task's arrays.
PIECE = 500_000
UND = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all trigrams around a letter (other characters read as a space), and the text of each."""
    parts, owner = [], []
    for k, text in enumerate(texts):
        text = text.lower()
        for a in range(0, len(text), PIECE):
            parts.append((text[a - 1] if a else " ") + text[a:a + PIECE] + (text[a + PIECE] if a + PIECE < len(text) else " "))
            owner.append(k)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    ends = np.cumsum([len(p) for p in parts])
    centre = letter
    centre[ends - 1] = False
    centre[np.concatenate([[0], ends[:-1]])] = False
    at = np.flatnonzero(centre)
    keys = (codes[at - 1] << np.uint64(42)) | (codes[at] << np.uint64(21)) | codes[at + 1]
    return keys, np.array(owner)[np.searchsorted(ends, at, "right")]


def slots(keys: np.ndarray) -> list[np.ndarray]:
    return [((keys * np.uint64(f)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for f in FACTORS[:HASHES]]


class Filters:
    """The bit-sliced filters of some languages."""

    def __init__(self, languages: list[str], table: np.ndarray) -> None:
        if len(languages) > 64:
            raise ValueError("at most 64 languages")
        self.languages = languages
        width = next(w for w in (8, 16, 32, 64) if len(languages) <= w)
        self.table = table.astype(f"u{width // 8}")
        fill = np.array([((table >> np.uint64(i)) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false = fill**HASHES

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each text's trigrams per language, and the number of trigrams."""
        keys, owner = trigrams(texts)
        one, two, three = slots(keys)
        sets = self.table[one] & self.table[two] & self.table[three]
        n = np.bincount(owner, minlength=len(texts))
        out = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            hits = np.bincount(owner, (sets >> sets.dtype.type(i)) & sets.dtype.type(1), len(texts))
            raw = hits / np.maximum(n, 1)
            out[:, i] = np.maximum(0, (raw - self.false[i]) / max(1e-9, 1 - self.false[i]))
        return out, n

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts))
        share, n = self.shares([t or "" for t in texts])
        best = share.argmax(1)
        total = share.sum(1)
        score = np.where((n > 0) & (total > 0), share.max(1) / np.where(total > 0, total, 1), 0.0)
        return [self.languages[b] if k else UND for b, k in zip(best, n)], score


def fit(docs: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Filters from a bounded sample of the rows where ``learn`` holds (over doc_id); uses text and non-null lang."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = bounded_sample(rows.where(learn).where("text is not null and lang is not null"), sample_docs, "langid", "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in text_slices(batches, 2 * PIECE):
            langs, texts = np.array(langs.to_pylist(), object), texts.to_pylist()
            keys, owner = trigrams(texts)
            for lang in np.unique(langs):
                gram, n = np.unique(keys[langs[owner] == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    grams = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = store(grams, "langid-grams")
    totals = {r.lang: r.total for r in grams.groupBy("lang").agg(F.sum("n").alias("total")).collect()}  # one row a language
    languages = sorted(totals)
    table = np.zeros(2**SLOT_BITS, np.uint64)
    if not languages:
        return Filters([], table)
    each = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(languages)]
    wide = grams.groupBy("gram").agg(*each)

    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.stack([b.column(i + 1).to_numpy() for i in range(len(languages))], 1)
            rate = n / np.array([max(1, totals[x]) for x in languages])
            member = (n >= MIN_COUNT) & (rate >= MIN_SHARE * rate.max(1, keepdims=True))
            mask = (member.astype(np.uint64) << np.arange(len(languages), dtype=np.uint64)).sum(1, dtype=np.uint64)
            at = slots(b.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.tile(mask, len(at)).view(np.int64))], names=["slot", "mask"])

    # At most one row a slot: the table's size is fixed.
    for r in wide.mapInArrow(insert, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        table[r.slot] = np.uint64(r.mask & (2**64 - 1))
    return Filters(languages, table)


def predict(docs: DataFrame, model: Filters) -> DataFrame:
    """doc_id, lang_pred, score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches, 2 * PIECE):
            lang, score = model.decide(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
