"""Toxicity from a lexicon trie intersected with Levenshtein automata, weighed by context windows.

The lexicon is learned from labelled documents: words, and word beginnings that stand for many forms, whose documents are
toxic beyond chance (near copies count once) or explain toxic documents that no other term does. Terms form a trie; the
automaton of all words within a term's edit budget (0 under five letters, 1 under nine, else 2; of a beginning, edits count in
the part of the word that it stands for) is intersected with it and made deterministic state by state as words demand. Words mixed with digits or signs are also read with look-alikes replaced.
A near form that clean labelled documents use is no misspelling. Learned words stay beside beginnings that cover them.

Each match has a context-window score: the words around it against those around matches in toxic and in clean labelled documents,
and whether it is quoted. A logistic regression over a document's matches gives the score.

The lexicon and regression are fitted on about ``sample_docs`` labelled documents (a documented bound); every document is
scored, over its whole text.

Defined cases: null and empty texts have no match and get the score of that; with labels of one class only, all documents get
that class (0 without labels); null labels take no part; repeated texts count once in the fit; repeated rows get a row
each; an empty table gives an empty result; extra columns are ignored by ``score`` and kept by ``clean``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pairsim.llm.models import Logistic
from pairsim.llm.shared import bounded_sample, store, text_slices

WORD = re.compile(r"[^\W_]+(?:[@$*!][^\W_]+)*")
LOOK_ALIKE = str.maketrans("013457@$!", "oieastasi")
ODD = re.compile(r"[\d@$*!]")
QUOTES = "\"“”«»„‘’'`"
SAMPLE_DOCS = 20_000
STEMS = (4, 5, 6)
MIN_DOCS, MIN_ODDS = 3, 3.0
WINDOW = 6
#: Memorised words and automaton states of one worker; forgotten together when full.
MEMORY = 100_000
MATCH = "array<struct<start:int,end:int,term:string,edits:int,quoted:boolean,context:double>>"


def edit_budget(term: str, stem: bool, exact: frozenset[str]) -> int:
    """Edits of a word, or of the part of a word that a stem stands for."""
    return 0 if len(term) < 5 or term in exact else 1 if len(term) < 9 else 2


class Automaton:
    """All words within each term's edit budget, as a lazily built deterministic automaton over the lexicon's trie."""

    def __init__(self, terms: list[tuple[str, bool]], exact: frozenset[str] = frozenset()) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, bool, int]]] = [[]]
        self.most = [0]  # the largest edit budget at or below a node
        for term, stem in terms:
            node, budget = 0, edit_budget(term, stem, exact)
            self.most[0] = max(self.most[0], budget)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], budget)
            self.ends[node].append((term, stem, budget))
        self.forget()

    def forget(self) -> None:
        self.states: list[dict[int, int]] = []
        self.number: dict[tuple, int] = {}
        self.step: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a set of (trie node, edits), closed under leaving out letters of the term; -1 if dead."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            e = nodes[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        if not nodes:
            return -1
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(nodes)
            self.step.append({})
        return self.number[key]

    def _next(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.states[state].items():
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < out.get(child, 99):
                    out[child] = cost
            if e + 1 <= self.most[node] and e + 1 < out.get(node, 99):
                out[node] = e + 1
            if any(stem and e <= b for _, stem, b in self.ends[node]) and e < out.get(node, 99):
                out[node] = e  # a stem takes any ending
        return self._state(out)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term (then the first by text) and its edits."""
        state = self.start
        for c in word:
            step = self.step[state]
            if c not in step:
                step[c] = self._next(state, c)
            state = step[c]
            if state < 0:
                return None
        found = [(e, term) for node, e in self.states[state].items() for term, _, b in self.ends[node] if e <= b]
        return min(found)[::-1] if found else None


class Matcher:
    """Finds lexicon terms in texts.

    ``exact`` are terms that take no misspelling, ``clean`` near forms that clean documents use, ``context`` word weights.
    """

    def __init__(self, terms: list[tuple[str, bool]], exact: frozenset[str] = frozenset(), clean: frozenset[str] = frozenset(), context: dict[str, float] | None = None) -> None:
        self.terms, self.exact, self.clean, self.context = terms, exact, clean, context or {}
        self._ready()

    def _ready(self) -> None:
        self.automaton = Automaton(self.terms, self.exact)
        self.misses: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def __getstate__(self) -> tuple:
        return self.terms, self.exact, self.clean, self.context

    def __setstate__(self, state: tuple) -> None:
        self.terms, self.exact, self.clean, self.context = state
        self._ready()

    def look_up(self, word: str) -> tuple[str, int] | None:
        found = self.automaton.match(word)
        if found is None and ODD.search(word) and re.search(r"[^\W\d_]", word):
            plain = self.automaton.match(word.translate(LOOK_ALIKE))
            found = (plain[0], plain[1] + 1) if plain and plain[0] not in self.exact else None
        return None if found and found[1] and word in self.clean else found

    def matches(self, text: str) -> list[tuple[int, int, str, int, bool, float]]:
        """start, end, term, edits, quoted, context score of every match, in order."""
        low = text.lower()
        new = set(WORD.findall(low)).difference(self.misses)
        # A known term, or else one among the words seen for the first time; either way all of the text is gone through.
        if not new.isdisjoint(self.hits) or any([self._learn(w) for w in new]):
            return self._spans(low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text))
        return []

    def _learn(self, word: str) -> bool:
        if len(self.misses) + len(self.hits) > MEMORY or len(self.automaton.states) > MEMORY:
            self._ready()
        found = self.look_up(word)
        if found:
            self.hits[word] = found
        else:
            self.misses.add(word)
        return bool(found)

    def _spans(self, low: str) -> list[tuple[int, int, str, int, bool, float]]:
        words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(low)]
        out = []
        for i, (a, b, w) in enumerate(words):
            found = self.hits.get(w) or (None if w in self.misses else self.look_up(w))
            if found:
                around = [x[2] for x in words[max(0, i - WINDOW):i] + words[i + 1:i + 1 + WINDOW]]
                before, after = low[words[max(0, i - WINDOW)][0]:a], low[b:words[min(len(words) - 1, i + WINDOW)][1]]
                quoted = any(before.count(q) % 2 and q in after for q in QUOTES if q not in "'’") or (before[-1:] in QUOTES and after[:1] in QUOTES and bool(before) and bool(after))
                out.append((a, b, found[0], found[1], quoted, sum(self.context.get(x, 0.0) for x in around)))
        return out


FEATURES = 7


def features(matches: list[tuple[int, int, str, int, bool, float]], n_chars: int) -> list[float]:
    if not matches:
        return [0.0] * FEATURES
    exact = sum(1 for m in matches if not m[3])
    own = sum((0.5 if m[4] else 1.0) / (1 + m[3]) for m in matches)
    context = sum(m[5] for m in matches) / len(matches)
    return [math.log1p(exact), math.log1p(len(matches) - exact), math.log1p(own), float(len({m[2] for m in matches})),
            sum(m[4] for m in matches) / len(matches), max(-5.0, min(5.0, context)), min(1.0, 20.0 * len(matches) / max(1, n_chars))]


HASH_A = np.random.default_rng(7).integers(1, 2**31, 32, dtype=np.int64)


def minhash(words: list[str]) -> list[int]:
    """32 minima of hashed words; near copies agree in most."""
    h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words] or [0], np.int64)
    return ((h[:, None] * HASH_A) % (2**31 - 1)).min(0).tolist()


def families(prints: np.ndarray) -> np.ndarray:
    """A number per row, equal for rows linked by equal MinHash values in three quarters of the positions."""
    label = np.arange(len(prints))
    for i in range(len(prints)):
        near = np.flatnonzero((prints[:i] == prints[i]).mean(1) >= 0.75)
        if len(near):
            label[np.isin(label, label[near])] = label[near].min()
            label[i] = label[near].min()
    return label


def choose(docs: dict[int, tuple[int, set[tuple[str, bool]]]], clean: dict[tuple[str, bool], int], n_clean: int, vocabulary: int) -> list[tuple[str, bool]]:
    """The lexicon: ``docs`` are toxic documents with their family and strong terms, ``clean`` the terms' clean documents.

    A term enters if its families would not be so toxic by chance for any of the vocabulary's words, or, by sequential
    covering, if it adds MIN_DOCS families of toxic documents that no other term explains.
    """
    family = {d: f for d, (f, _) in docs.items()}
    users = defaultdict(set)
    for d, (_, terms) in docs.items():
        for t in terms:
            users[t].add(d)
    n_toxic = len(set(family.values()))
    share, bar = n_toxic / (n_toxic + n_clean), math.log(max(2, vocabulary)) + 3
    size = lambda u: len({family[d] for d in u})
    odds = lambda t, n: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1))

    def sure(t: tuple[str, bool], u: set[int]) -> bool:
        a, b = size(u), clean.get(t, 0)
        if a < MIN_DOCS or odds(t, a) < MIN_ODDS:
            return False
        r = a / (a + b)
        return a * math.log(r / share) + (b * math.log((1 - r) / (1 - share)) if b else 0.0) >= bar

    chosen = [t for t, u in users.items() if not t[1] and sure(t, u)]
    stems: list[tuple[str, bool]] = []
    for t in sorted((t for t in users if t[1]), key=lambda t: (len(t[0]), t[0])):
        named = set().union(*[users[w] for w in chosen if w[0].startswith(t[0])]) if chosen else set()
        if not any(t[0].startswith(x[0]) for x in stems) and sure(t, users[t] - named):
            stems.append(t)
    chosen += stems  # words stay beside their stems: theirs are the larger edit budgets
    covered = set().union(*[users[t] for t in chosen]) if chosen else set()
    rest = {t: u - covered for t, u in users.items() if t not in chosen}
    while rest := {t: u for t, u in rest.items() if len(u) >= MIN_DOCS and size(u) >= MIN_DOCS and odds(t, size(u)) >= MIN_ODDS}:
        best = max(rest, key=lambda t: (size(rest[t]), not t[1], len(t[0]), t[0]))
        chosen.append(best)
        rest = {t: u - rest[best] for t, u in rest.items() if t != best}
    return sorted(chosen, key=lambda t: (-size(users[t]), t))


class Model:
    def __init__(self, matcher: Matcher, regression: Logistic) -> None:
        self.matcher, self.regression = matcher, regression


def _labelled(docs: DataFrame, labels: DataFrame, learn: Column, sample_docs: int) -> DataFrame:
    """doc_id, toxic, text of the bounded sample; the sample of labels is broadcast, its size is the bound's."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(learn).where("toxic in (0, 1) and doc_id is not null")
    known = bounded_sample(known, sample_docs, "toxicity", "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.join(F.broadcast(store(known, "toxic-sample")), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from rows of ``labels`` (doc_id, toxic) where ``learn`` holds (over doc_id)."""
    sample = _labelled(docs, labels, learn, sample_docs)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted({w for w in WORD.findall(t.lower()) if not w.isdigit()}) for t in b.column(2).to_pylist()]
            stems = [sorted({w[:k] for w in row for k in STEMS if len(w) > k}) for row in words]
            prints = [minhash(row) for row in words]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.list_(pa.string())) for x in (words, stems)), pa.array(prints, pa.list_(pa.int64()))], names=["key", "toxic", "words", "stems", "prints"])

    words = sample.select(F.xxhash64("text").alias("key"), "toxic", "text").mapInArrow(tokens, "key long, toxic int, words array<string>, stems array<string>, prints array<long>")
    words = store(words.dropDuplicates(["key"]), "toxic-words")
    n = {r.toxic: r.n for r in words.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        constant = Logistic().fit(np.zeros((0, FEATURES)), np.zeros(0))
        constant.beta[-1] = 30.0 if n.get(1) else -30.0
        return Model(Matcher([]), constant)
    each = words.select("key", "toxic", F.explode("words").alias("t"), F.lit(False).alias("stem")).union(words.select("key", "toxic", F.explode("stems"), F.lit(True)))
    counts = store(each.groupBy("t", "stem").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")), "toxic-counts")
    odds = F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))
    strong = store(counts.where((F.col("n1") >= MIN_DOCS) & (odds >= MIN_ODDS)), "toxic-strong")
    # Bounded by the sample: at most its toxic documents' strong terms.
    by_doc = each.where("toxic = 1").join(strong, ["t", "stem"]).select("key", "t", "stem", "n0").collect()
    toxic = words.where("toxic = 1").select("key", "prints").orderBy("key").collect()
    use = {r.key: (int(f), set()) for r, f in zip(toxic, families(np.array([r.prints for r in toxic])))}
    for r in by_doc:
        use[r.key][1].add((r.t, r.stem))
    terms = choose(use, {(r.t, r.stem): r.n0 for r in by_doc}, n[0], counts.count())
    matcher = Matcher(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [w for w in b.column(0).to_pylist() if (m := matcher.look_up(w)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], names=["word"])

    # Near forms in clean documents are no misspellings.
    near_forms = words.where("toxic = 0").select(F.explode("words").alias("word")).distinct().mapInArrow(near, "word string").collect()
    clean_forms = frozenset(r.word for r in near_forms)
    matcher = Matcher(terms, clean=clean_forms)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = text.lower()
                for a, z, *_ in matcher.matches(text):
                    near_by = WORD.findall(low[max(0, a - 60):a])[-WINDOW:] + WORD.findall(low[z:z + 60])[:WINDOW]
                    seen.update((w, toxic) for w in set(near_by))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["word", "toxic", "n"])

    windows = sample.select("toxic", "text").mapInArrow(around, "word string, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0"))
    windows = store(windows, "toxic-windows")
    total = windows.agg(F.sum("n1").alias("a"), F.sum("n0").alias("b")).first()
    context = {}
    if total.a and total.b:  # without matches in clean documents, windows tell nothing
        r1, r0 = total.a / (total.a + total.b), total.b / (total.a + total.b)  # rare words lean to the share of all windows
        rows = windows.where("n1 + n0 >= 5").collect()  # bounded by the sample
        context = {r.word: math.log((r.n1 + 20 * r1) / (r.n0 + 20 * r0)) - math.log(r1 / r0) for r in rows}
    matcher = Matcher(terms, clean=clean_forms, context=context)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(matcher.matches(t), len(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.select("toxic", "text").mapInArrow(facts, "toxic int, x array<double>").groupBy("toxic", "x").agg(F.count(F.lit(1)).alias("n")).collect()
    rows.sort(key=lambda r: (r.toxic, r.x))
    x, y = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float)
    return Model(matcher, Logistic().fit(x, y, np.array([r.n for r in rows], float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, matches (spans with term, edits, quoted, context) for every row."""
    matcher, regression = model.matcher, model.regression

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            found, x = [], []
            for t in texts.to_pylist():
                m = matcher.matches(t) if t else []
                x.append(features(m, len(t or "")))
                found.append([dict(zip(("start", "end", "term", "edits", "quoted", "context"), s)) for s in m])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("context", pa.float64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(regression.score(np.array(x))), pa.array(found, kind)], names=["doc_id", "score", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, score double, matches {MATCH}")


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold`` or has no match at all, with their columns; no shuffle.

    A text without a match stays whatever the model's base rate: nothing in it speaks for its removal.
    """
    matcher, regression = model.matcher, model.regression
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, start = b.column(0), 0
            for _, texts in text_slices([pa.RecordBatch.from_arrays([rows.field(at).cast(pa.string())], names=["text"])]):
                found = [matcher.matches(t) if t else [] for t in texts.to_pylist()]
                x = np.array([features(m, len(t.as_py() or "")) for m, t in zip(found, texts)])
                stays = (regression.score(x) < threshold) | np.array([not m for m in found])
                yield pa.RecordBatch.from_arrays([rows.slice(start, len(texts)).filter(pa.array(stays))], names=["row"])
                start += len(texts)

    return docs.select(F.struct(*docs.columns).alias("row")).mapInArrow(run, StructType([StructField("row", docs.schema)])).select("row.*")
