"""Quality scores by co-training a text view and a page-metadata view.

The text view sees only facts of the content (repetition, case, signs, word shapes); the metadata view only facts around it (source,
length, host, kind of URL, mark-up). Both start from the labelled sample. In each round each view scores an unlabelled
pool, and the documents it is most sure of, of either class in the proportion of the labels, become pseudo-labelled training rows
of the other view, as far as held labelled rows bear out that it knows more than chance there; they weigh its calibrated confidence. After the rounds each view is calibrated (Platt) on labelled rows that it was not fitted on, and a regression
over the two calibrated log-odds, fitted there as well, combines them to score all documents.

Models are fitted on about ``sample_docs`` labelled and ``pool_docs`` unlabelled documents (documented bounds); every
document is scored, over its whole text.

Defined cases: null and empty texts have the facts of an empty text; documents without a page have "no page" facts, several pages
of a document are summed; without labels of both classes the score is the share of label 1 (0 without any) for all; null labels take no
part; repeated rows get a row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsim.llm.models import Logistic
from pairsim.llm.shared import bounded_sample, store, text_slices

SAMPLE_DOCS, POOL_DOCS = 20_000, 20_000
ROUNDS, SHARE = 3, 0.05
VIEWS = ("text", "metadata")
#: Check rows that bear out a view's sureness, at least.
LEAST = 20
BINS, HASHED = 8, 16
CHECK = 4  # one in so many labelled rows calibrates and combines, and fits no view
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def text_facts(text: str | None) -> list[float]:
    """Facts of the whole text, each a ratio or a logarithm."""
    text = text or ""
    words = TOKEN.findall(text)
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    pairs = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    upper = sum(map(str.isupper, words)) / n
    # Letters, digits and white space are counted by what a translation takes away.
    signs = len(re.findall(r"[^\w\s]", text))
    digits = len(re.findall(r"[0-9]", text))
    alone = sum(1 for w in counts if not any(map(str.isalnum, w)))
    ends = sum(w[-1] in "!%$*&#|@~^" for w in counts) / max(1, len(counts))
    return [len(counts) / n, math.log1p(len(counts)), pairs / n, counts.most_common(1)[0][1] / n if words else 0.0, upper, signs / chars, digits / chars,
            len(text) / n, len(set(lines)) / max(1, len(lines)), math.log1p(len(lines)), alone / max(1, len(counts)), ends, float(max((len(w) for w in counts), default=0))]


def page_facts(pages: DataFrame) -> DataFrame:
    """One row per document of ``pages`` (doc_id, url, html): its page's facts; no text of either goes on."""
    url, html = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    facts = pages.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract(url, r"://([^/?#]*)", 1).alias("host"),
        F.regexp_extract(url, r"(\.[a-z]+|/|\?|#)[^./?#]*$", 1).alias("shape"), F.length(html).alias("size"),
        F.regexp_count(html, F.lit("<a ")).alias("links"), F.regexp_count(html, F.lit("<")).alias("tags"))
    return facts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.min("host").alias("host"), F.min("shape").alias("shape"), F.sum("size").alias("size"), F.sum("links").alias("links"), F.sum("tags").alias("tags"))


def _rows(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, metadata columns, chars and t (text facts) of every row; texts become facts where they lie, and only facts are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            facts, chars = [], []
            for _, texts in text_slices([b]):
                facts += [text_facts(t) for t in texts.to_pylist()]
                chars += pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), pa.array(chars, pa.int64()), pa.array(facts, pa.list_(pa.float64()))], names=["doc_id", "source", "lang", "chars", "t"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, source string, lang string, chars long, t array<double>")
    facts = store(page_facts(pages), "page-facts").withColumnRenamed("doc_id", "page_doc")
    return rows.join(facts, F.col("doc_id") == F.col("page_doc"), "left").drop("page_doc")


META = ["source", "lang", "host", "shape", "n_pages", "size", "links", "tags"]


def meta_facts(batch: dict[str, list], lengths: np.ndarray) -> np.ndarray:
    """Hashed one-hot columns of names, and logarithms of sizes."""
    n = len(lengths)
    out = []
    for c in ("source", "lang", "host", "shape"):
        hot = np.zeros((n, HASHED))
        hot[np.arange(n), [zlib.crc32(f"{c}:{v}".encode("utf-8", "surrogatepass")) % HASHED for v in batch[c]]] = 1
        out.append(hot)
    sizes = np.array([[float(v or 0) for v in batch[c]] for c in ("n_pages", "size", "links", "tags")]).reshape(4, n).T
    out += [np.log1p(sizes), np.log1p(lengths)[:, None], (np.log1p(lengths)[:, None] > np.array([4, 5, 6, 7, 8, 9, 10])).astype(float)]
    return np.column_stack(out)


class View:
    """A logistic regression over facts and their quantile bins."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> View:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        self.model = Logistic().fit(self._wide(x), y, weight)
        return self

    def _wide(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, *[x[:, [j]] > e for j, e in enumerate(self.edges) if len(e)]])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.model.margin(self._wide(x)), -15, 15)


def sure_from(margin: np.ndarray, y: np.ndarray) -> float:
    """The least margin from which on the check rows hold more of label 1 than chance would; infinite if there is none.

    The share of label 1 above a margin must exceed the class's share by more than its standard error (Wilson's bound), so a
    view hands over what it knows best in its own terms, be it weak, and next to nothing where it knows nothing.
    """
    order, n = np.argsort(-margin, kind="stable"), np.arange(1, len(y) + 1)
    right, z = np.cumsum(y[order]) / n, 1.0
    low = (right + z * z / (2 * n) - z * np.sqrt(right * (1 - right) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    good = np.flatnonzero((low > y.mean()) & (n % LEAST == 0))
    return float(margin[order][good[-1]]) if len(good) else np.inf


def co_train(x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], check: list[np.ndarray], check_y: np.ndarray, rounds: int = ROUNDS, share: float = SHARE) -> tuple[list[View], list[tuple[int, str, int, int]]]:
    """Two views fitted in turns: in each round each view labels the share of the pool that it is surest of, for the other one.

    Both classes are handed over in proportion, within what the view's check rows bear out. The other view takes a label unless it is
    itself surer of the opposite, both by their calibration on the check rows, so a weak view can add to a strong one but not
    overrule it; a label weighs the squared share of doubt that it removes from the class's prior. Returns the views, and (round, from, zeros, ones) handed over.
    """
    own = [[(x[v], y, np.ones(len(y)))] for v in (0, 1)]
    free, handed = [np.ones(len(pool[0]), bool) for _ in (0, 1)], []
    fit = lambda v: View().fit(*(np.concatenate(c) for c in zip(*own[v])))
    views = [fit(v) for v in (0, 1)]
    for no in range(1, rounds + 1):
        lessons = []
        platt = [Logistic().fit(views[v].margin(check[v])[:, None], check_y) for v in (0, 1)]
        for v in (0, 1):
            at, proof = np.flatnonzero(free[v]), views[v].margin(check[v])
            margin = views[v].margin(pool[v][at])
            order = np.argsort(margin, kind="stable")
            n_high, n_low = (int(np.ceil(len(pool[0]) * share * part)) for part in (y.mean(), 1 - y.mean()))
            low, high = order[:n_low], order[max(0, len(order) - n_high):]
            low, high = low[-margin[low] >= sure_from(-proof, 1 - check_y)], high[margin[high] >= sure_from(proof, check_y)]
            pick, label = np.concatenate([low, high]), np.repeat([0.0, 1.0], [len(low), len(high)])
            teacher, taught = (np.abs(1 - label - platt[u].score(views[u].margin(pool[u][at[pick]])[:, None])) for u in (v, 1 - v))
            taken = teacher >= 1 - taught  # the share of certainty in the label against the other view's in the opposite
            pick, label, teacher = pick[taken], label[taken], teacher[taken]
            prior = np.where(label == 1, check_y.mean(), 1 - check_y.mean())
            lessons.append((pool[1 - v][at[pick]], label, np.clip((teacher - prior) / (1 - prior), 0, 1) ** 2))
            free[v][at[pick]] = False
            handed.append((no, VIEWS[v], int((label == 0).sum()), int((label == 1).sum())))
        for v in (0, 1):
            own[1 - v].append(lessons[v])
        views = [fit(v) for v in (0, 1)]
    return views, handed


class Model:
    """Calibrated views and their combination; ``constant`` where labels are missing; ``handed``: the labels exchanged by round."""

    def __init__(self, views: list[View] | None, platt: list[Logistic] | None, both: Logistic | None, constant: float = 0.0, handed: list[tuple[int, str, int, int]] | None = None) -> None:
        self.views, self.platt, self.both, self.constant, self.handed = views, platt, both, constant, handed or []

    def score(self, x: list[np.ndarray]) -> np.ndarray:
        """text score, metadata score and combined score in columns."""
        if self.views is None:
            return np.full((len(x[0]), 3), self.constant)
        margins = [p.margin(v.margin(f)[:, None]) for p, v, f in zip(self.platt, self.views, x)]
        one = [1 / (1 + np.exp(-m)) for m in margins]
        return np.column_stack([*one, self.both.score(np.column_stack(margins))])


def _facts(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Text facts and metadata facts of a batch of ``_rows``."""
    text = np.array(batch.column("t").to_pylist(), float).reshape(batch.num_rows, -1)
    return [text, meta_facts({c: batch.column(c).to_pylist() for c in META}, batch.column("chars").to_numpy().astype(float))]


def fit(docs: DataFrame, pages: DataFrame, labels: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS, pool_docs: int = POOL_DOCS) -> Model:
    """Co-trains on bounded samples; labels (doc_id, quality) are used where ``learn`` holds (over doc_id)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(learn).where("y in (0, 1) and doc_id is not null")
    known = store(bounded_sample(known, sample_docs, "quality", "doc_id").groupBy("doc_id").agg(F.max("y").alias("y")), "quality-sample")
    every = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    pool = bounded_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").join(every, "doc_id", "left_anti").distinct(), pool_docs, "pool", "doc_id")
    ask = store(known.unionByName(pool.withColumn("y", F.lit(-1))).withColumnRenamed("doc_id", "ask_id"), "quality-ask")  # bounded by both samples

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _facts(b)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *(pa.array(list(v), pa.list_(pa.float64())) for v in x)], names=["doc_id", "y", "t", "m"])

    small = docs.select("doc_id", "source", "lang", "text").join(F.broadcast(ask), F.col("doc_id").cast("long") == F.col("ask_id")).drop("ask_id")
    rows = _rows(small, pages).join(F.broadcast(ask), F.col("doc_id") == F.col("ask_id"))
    found = rows.select("doc_id", "y", *META, "chars", "t").mapInArrow(facts, "doc_id long, y int, t array<double>, m array<double>").collect()
    if not found:
        return Model(None, None, None)
    found.sort(key=lambda r: (r.doc_id, r.t, r.m))
    y = np.array([r.y for r in found], float)
    x = [np.array([r[c] for r in found], float).reshape(len(found), -1) for c in ("t", "m")]
    check = np.array([zlib.crc32(f"check{r.doc_id}".encode()) % CHECK == 0 for r in found], bool)
    labelled = y >= 0
    use, held = labelled & ~check, labelled & check
    if any(not 0 < y[s].sum() < s.sum() for s in (use, held)):
        return Model(None, None, None, float(y[labelled].mean()) if labelled.any() else 0.0)
    views, handed = co_train([v[use] for v in x], y[use], [v[~labelled] for v in x], [v[held] for v in x], y[held])
    platt = [Logistic().fit(v.margin(f[held])[:, None], y[held]) for v, f in zip(views, x)]
    margins = np.column_stack([p.margin(v.margin(f[held])[:, None]) for p, v, f in zip(platt, views, x)])
    return Model(views, platt, Logistic().fit(margins, y[held]), handed=handed)


def score(docs: DataFrame, pages: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_score, meta_score, score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.score(_facts(b))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(s[:, i]) for i in range(3))], names=["doc_id", "text_score", "meta_score", "score"])

    return _rows(docs, pages).select("doc_id", *META, "chars", "t").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
