"""Benchmark decontamination with a distributed positional inverted index.

The index holds the training documents' postings (doc, position, term) of every term that the benchmark uses. A benchmark
window of ``window`` words is looked up from its rarest term: the rarest terms of all windows give candidate alignments
(doc, item, delta = document position - item position), which must also hold the window's second rarest term at its
offset. The remaining alignments are intersected, offset-adjusted, with the postings of all the item's terms; runs of
``window`` consecutive matched positions are exactly the occurrences of windows. ``proximity`` returns documents that
hold a window's two rarest terms within ``slop`` of their distance.

Everything is DataFrame expressions. Frequent terms are only ever counted and intersected with alignments that rare terms
found; a hot term's postings are spread over documents, never gathered.

Defined cases: null text has no words; items without words have no windows; an item shorter than a window is one
window; repeated rows of a document are searched as one document per distinct (doc_id, text) and each row gets the
result; null doc_ids are documents too; items that repeat an id and a text count once, an id with several texts counts if
any occurs; empty tables give no hits; very long texts are searched whole; extra columns are ignored by ``search`` and kept by
``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsim.llm.shared import store, without

#: What separates words: ASCII that is neither digit nor letter. A-Z are lowered in each word that is compared.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10


def words(text: Column) -> Column:
    """The text's words, in order, case as given."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), GAP), lambda w: w != "")


def _tokens(rows: DataFrame, *key: str) -> DataFrame:
    """The key columns, pos and word (A-Z lowered) of rows that have a text."""
    return rows.select(*key, F.posexplode(words(F.col("text"))).alias("pos", "raw")).select(*key, "pos", F.translate("raw", UPPER, LOWER).alias("word"))


def benchmark_terms(items: DataFrame) -> DataFrame:
    """item (row key), item_id, n (words), pos, word, term of every item word."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows = rows.withColumn("item", F.xxhash64("item_id", "text")).withColumn("n", F.size(words(F.col("text"))))
    return store(_tokens(rows, "item", "item_id", "n").withColumn("term", F.xxhash64("word")), "bench-terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (doc, h, pos, term) of the benchmark's terms, stored; ``docs`` has doc, h and text."""
    vocabulary = store(terms.select("word", "term").distinct(), "bench-vocabulary")
    return store(_tokens(docs, "doc", "h").join(vocabulary, "word").select("doc", "h", "pos", "term"), "postings")


def rare_pairs(terms: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, start, o1, t1, o2, t2: each window's two rarest terms with their item positions (o2 null for one word).

    Windows of which a term never occurs are left out. Rarity is the number of postings.
    """
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    at = terms.select("item", "n", "pos", "term")
    at = at.join(counts, "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    # Each word belongs to the windows that start up to window - 1 before it.
    first, last = F.greatest(F.lit(0), F.col("pos") - (window - 1)), F.least(F.col("pos"), F.greatest(F.lit(0), F.col("n") - window))
    each = at.withColumn("start", F.explode(F.sequence(first, last)))
    lists = each.groupBy("item", "start").agg(F.sort_array(F.collect_list(F.struct("cf", "pos", "term"))).alias("l"))
    lists = lists.where(F.col("l")[0]["cf"] > 0)
    second = F.when(F.size("l") > 1, F.element_at(F.slice("l", 2, 1), 1))
    return store(lists.select("item", "start", F.col("l")[0]["pos"].alias("o1"), F.col("l")[0]["term"].alias("t1"), second["pos"].alias("o2"), second["term"].alias("t2")), "bench-windows")


def alignments(terms: DataFrame, index: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc, h, item, delta where some window's two rarest terms both stand at their offsets."""
    rare = pairs.select("item", F.col("o1").alias("o"), F.col("t1").alias("term")).distinct()
    first = index.join(rare, "term").select("doc", "h", "item", "o", (F.col("pos") - F.col("o")).alias("delta"))
    alone = pairs.where("o2 is null").select("item").distinct()
    done = first.join(alone, "item", "left_semi").select("doc", "h", "item", "delta")
    # What the rarest term's postings ask of the second rarest: its place in the same document.
    two = pairs.where("o2 is not null").select("item", F.col("o1").alias("o"), "o2", "t2").distinct()
    ask = first.join(two, ["item", "o"]).select("doc", "h", "item", "delta", (F.col("delta") + F.col("o2")).alias("pos"), F.col("t2").alias("term")).distinct()
    second = index.join(two.select(F.col("t2").alias("term")).distinct(), "term", "left_semi")
    return ask.join(second, ["doc", "h", "pos", "term"]).select("doc", "h", "item", "delta").union(done).distinct()


def occurrences(terms: DataFrame, index: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """doc, h, item, first, last: maximal runs of matched positions, as long as a window or the whole short item."""
    expect = found.join(terms.select("item", "n", F.col("pos").alias("o"), "term"), "item")
    expect = expect.select("doc", "h", "item", "n", "delta", (F.col("delta") + F.col("o")).alias("pos"), "term")
    here = index.join(store(found.select("doc").distinct(), "found-docs"), "doc", "left_semi")
    hit = expect.join(here, ["doc", "h", "pos", "term"]).select("doc", "h", "item", "n", "delta", "pos").distinct()
    w = Window.partitionBy("doc", "h", "item", "n", "delta").orderBy("pos")
    runs = hit.withColumn("run", F.col("pos") - F.row_number().over(w))
    runs = runs.groupBy("doc", "h", "item", "n", "delta", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.col("n"), F.lit(window))).select("doc", "h", "item", "first", "last")


def _key() -> list[Column]:
    """doc (the id; a stand-in for null), h (the text's hash, which tells apart texts that share an id)."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("h")]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, h, doc_id, text."""
    return docs.select(*_key(), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _hits(keyed: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """doc, h, n_hit, ids of the texts that hold a window, stored."""
    terms = benchmark_terms(items)
    index = build_index(keyed, terms)
    found = store(alignments(terms, index, rare_pairs(terms, index, window)), "alignments")
    runs = store(occurrences(terms, index, found, window), "occurrences")
    # Repeated rows of one document share a key, and so each position: distinct runs only.
    spans = runs.select("doc", "h", "first", "last").distinct()
    w = Window.partitionBy("doc", "h").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    past = F.coalesce(F.max("last").over(w), F.lit(-1))
    covered = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, past))
    hits = spans.select("doc", "h", covered.alias("c")).groupBy("doc", "h").agg(F.sum("c").alias("n_hit"))
    names = runs.join(terms.select("item", "item_id").distinct(), "item").select("doc", "h", "item_id").distinct()
    names = names.groupBy("doc", "h").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    return store(hits.join(names, ["doc", "h"], "left"), "hits")


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    keyed = _keyed(docs)
    hits = _hits(keyed, items, window)
    counted = keyed.select("doc_id", "doc", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return counted.join(hits, ["doc", "h"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def proximity(docs: DataFrame, items: DataFrame, slop: int = 3, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, start: windows whose two rarest terms stand in the document within ``slop`` of their distance."""
    keyed = _keyed(docs)
    terms = benchmark_terms(items)
    index = build_index(keyed, terms)
    pairs = rare_pairs(terms, index, window).where("o2 is not null")
    first = index.join(pairs, index["term"] == pairs["t1"]).select("doc", "h", "item", "start", "t2", (F.col("pos") + F.col("o2") - F.col("o1")).alias("want"))
    first = first.withColumn("pos", F.explode(F.sequence(F.col("want") - slop, F.col("want") + slop)))
    near = first.join(index.withColumnRenamed("term", "t2"), ["doc", "h", "pos", "t2"]).select("doc", "h", "item", "start").distinct()
    near = near.join(terms.select("item", "item_id").distinct(), "item")
    return near.select(F.nullif(F.col("doc"), F.lit(-(2**63))).alias("doc_id"), "item_id", "start").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with their columns; a row is known by doc_id and text hash."""
    return without(docs, _hits(_keyed(docs), items, window).where("n_hit > 0").select("doc", "h"), _key())
