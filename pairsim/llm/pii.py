"""Personal data: base patterns, plus high-recall candidate spans that boosted trees accept.

Base spans are e-mail addresses, IP addresses, payment cards and international phone numbers by pattern and check (octets,
Luhn, number of digits), and always stay. Generators propose looser, overlapping spans: addresses with spelled-out signs, and
every sequence of neighbouring digit groups, with any of the usual separators, whose digits fit a kind. Boosted trees score a candidate by its format (digits, groups, signs,
checks) and its context (the words before it, the characters at its ends). They are fitted, without labels, on all
documents: base spans put into other notations, in their own context, are positive; candidates that
hold more, less or another kind, and those of look-alikes put between words (tables, dates, prices, ids, versions, sentences), are negative. All
of these could pass a check, as all that is ever scored. Per kind, a threshold is calibrated on the examples of a quarter of the documents, which no tree
has seen: the least score, in steps of 1 / ``STEPS`` of its margin, at which the share of positives stays at ``precision``. Accepted candidates that overlap no base span
are added, best score first where they overlap.

Defined cases: null and empty texts have no spans; with fewer than ``MIN_FIT`` positives or negatives nothing is added;
repeated rows get a row each; an empty table gives an empty result; extra columns are ignored by ``find`` and kept by ``redact``.
Offsets are code points, ends exclusive; patterns run in time linear in the text.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsim.llm.boosting import block, fit_boosted, rows_of
from pairsim.llm.models import Boosted, sigmoid
from pairsim.llm.shared import store, text_slices

KINDS = ("email", "ip", "card", "phone")
# Possessive: a run of digits is matched as a whole or not at all, so that failing runs are not tried again.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")
NUMBERS = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[\x20()./_-]{0,3}[0-9]){3,}+")
#: A local part of at most 64 characters and up to nine labels of at most 63, as mail systems allow.
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:\s?[(\[]at[)\]]\s?|\sat\s|\s?@\s?)[A-Za-z0-9-]{1,63}(?:(?:\s?[(\[]dot[)\]]\s?|\sdot\s|\.)[A-Za-z0-9-]{1,63}){1,8}+", re.IGNORECASE)
#: What any address of SPELLED holds: texts without it need no search.
AT = re.compile(r"@|[\s(\[]at[\s)\]]", re.IGNORECASE)
MIN_FIT = 50
CONTEXT_BINS = 64
#: Digits of candidates by kind, at least and at most.
LENGTHS = (("ip", 4, 12), ("card", 12, 20), ("phone", 7, 16))
#: Candidates of one text that are scored together.
SCORED = 8192
PRECISION = 0.99
#: Steps of a margin of 1 in which held-out scores are counted.
STEPS = 1024
#: Look-alikes of a document in the fit.
LOOK_ALIKES = 4
N_FEATURES = 24
TWICE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
WORDS, LONG_WORDS, SIGN, TAIL = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W\d_]{2,}"), re.compile(r"[^\w]"), re.compile(r"[A-Za-z]{2,}$")
#: By code point: whether ``\s`` matches.
SPACES = np.zeros(0x110000, bool)
SPACES[[c for c in range(0x3001) if chr(c).isspace()]] = True


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum([TWICE[x] for x in d[1::2]])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: the longest local part before each ``@`` that a domain follows."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def sub_runs(text: str, a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, digits, groups) of every sequence of neighbouring digit groups of a run with at most 20 digits."""
    groups = [m.span() for m in DIGITS.finditer(text, a, b)]
    for i, (start, _) in enumerate(groups):
        start = start - (text[start - 1] == "(") if i else a
        n = 0
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > 20:
                break
            yield start, groups[j][1], n, j - i + 1


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of high-recall spans; kinds and spans may overlap."""
    out = []
    if AT.search(text):
        out += [("email", *m.span()) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            for a, b, n, groups in sub_runs(text, *m.span()):
                out += [(k, a, b) for k, low, high in LENGTHS if low <= n <= high and (k != "ip" or groups == 4)]
        out += [("ip", *m.span()) for m in IP.finditer(text)]
    return out


def could_be(kind: str, span: str) -> bool:
    """Whether a check of the kind could accept the span in some notation; what can't be is a negative."""
    groups = DIGITS.findall(span)
    digits = "".join(groups)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return bool(TAIL.search(span))


def other_notation(kind: str, span: str, no: int) -> str:
    """A base span as people write it around a pattern: what the trees are to find. ``no`` picks the notation."""
    if kind == "email":
        local, _, domain = span.partition("@")
        at, dot = ((" (at) ", " dot "), (" at ", " dot "), ("[at]", "[dot]"), (" @ ", "."), (" AT ", " DOT "), ("(at)", "."))[no % 6]
        return local + at + domain.replace(".", dot)
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "ip":
        return (" . ", " ", "-", "_")[no % 4].join(str(int(g)) for g in span.split("."))
    if kind == "card":
        return ("." if no % 4 == 0 else "_" if no % 4 == 1 else "/" if no % 4 == 2 else "  ").join(digits[i:i + 4] for i in range(0, len(digits), 4))
    sep = ("-", ".", " ")[no % 3]
    head, rest = digits[:-7], (digits[-7:-4], digits[-4:])
    return (f"({head}) " if no % 2 and len(head) <= 3 else head + sep) + sep.join(rest)


def look_alike(words: list[str], no: int, rng: random.Random) -> str:
    """What has the shape of personal data and is none: tables, dates, prices, ids, versions, hex strings, plain sentences."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = [rng.choice(words) for _ in range(4)] if words else ["a", "b", "c", "d"]
    return (lambda: " ".join(number(rng.randrange(1, 6)) for _ in range(rng.randrange(4, 8))),
            lambda: f"{rng.randrange(1950, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02} {rng.randrange(24):02}.{rng.randrange(60):02}.{rng.randrange(60):02}",
            lambda: " ".join(f"{number(rng.randrange(1, 4))}.{number(2)}" for _ in range(rng.randrange(2, 7))),
            lambda: rng.choice("./_").join(number(rng.randrange(2, 8)) for _ in range(rng.randrange(2, 5))),
            lambda: ".".join(str(rng.randrange(0, 400)) for _ in range(rng.randrange(2, 6))) + rng.choice(["", "-", "rc1"]),
            lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
            lambda: f"{w[0]} at {w[1]}.{w[2]}",
            lambda: f"{w[0]} at {w[1]} {w[2]}. {w[3]}",
            lambda: f"{w[0]} at {w[1]} dot {w[2]}")[no % 9]()


def examples(key: str, text: str) -> list[tuple[str, int, list[float]]]:
    """(kind, label, features) of candidates that ``Model.added`` would score, made from a text by rule.

    Every base span stands once in another notation, in its own context: that span is right, candidates that hold more, less or
    another kind are wrong. Look-alikes stand between the text's words: all their candidates are wrong.
    """
    rng, out = random.Random(f"pii:{key}"), []
    words = LONG_WORDS.findall(text[:4000])  # for sentences between words; any will do
    places = [(k, a, b, other_notation(k, text[a:b], rng.randrange(12))) for k, a, b in base_spans(text)]
    gaps = np.flatnonzero(SPACES[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]).tolist() or [len(text)]
    for no in rng.sample(range(9), LOOK_ALIKES):
        at = rng.choice(gaps)
        places.append(("", at, at, f" {look_alike(words, no, rng)} "))
    for kind, a, b, put in places:
        left = text[max(0, a - 60):a]
        snippet = left + put + text[b:b + 40]
        start, end = len(left), len(left) + len(put)
        own = Cover(base_spans(snippet))
        for c in dict.fromkeys(candidates(snippet)):
            if c[1] < end and start < c[2] and could_be(*_named(c, snippet)) and not own.meets(c[1], c[2]):
                out.append((c[0], int(c == (kind, start, end)), features(c[0], snippet, c[1], c[2])))
    return out


def features(kind: str, text: str, a: int, b: int) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[a:b], text[max(0, a - 40):a], text[b:b + 20]
    groups = DIGITS.findall(span)
    digits = "".join(groups)
    words = [w.lower() for w in WORDS.findall(before)[-2:]]
    lens = [len(g) for g in groups] or [0]
    return [*(float(kind == k) for k in KINDS), float(len(span)), float(len(digits)), float(len(groups)), float(max(lens)), float(min(lens)), float(lens[0]),
            float(kind != "email" and len(digits) > 1 and luhn(digits)), float(sum(int(g) > 255 for g in groups if len(g) < 10)), float(span[:1] == "+"), float("(" in span),
            float(sum(map(str.isalpha, span))), float(len(set(SIGN.findall(span)))), float(span.count(".")), float(len(span.rsplit(".", 1)[-1])),
            float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:].isspace() or not before), float(len(before.split())),
            *(float(zlib.crc32(w.encode("utf-8", "surrogatepass")) % CONTEXT_BINS) for w in ([""] * (2 - len(words)) + words))]


class Cover:
    """Spans that may overlap each other, and whether one meets a range."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        order = sorted((a, b) for _, a, b in spans)
        self.starts, self.reach = [a for a, _ in order], list(accumulate((b for _, b in order), max))

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.reach[i - 1] > a


class Model:
    """Trees and a threshold per kind; kinds without one add nothing."""

    def __init__(self, trees: Boosted | None, thresholds: dict[str, float]) -> None:
        self.trees, self.thresholds = trees, thresholds

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        if self.trees is None:
            return []
        own = Cover(base)
        open_ = [c for c in dict.fromkeys(candidates(text)) if c[0] in self.thresholds and could_be(*_named(c, text)) and not own.meets(c[1], c[2])]
        good = []
        for at in range(0, len(open_), SCORED):
            some = open_[at:at + SCORED]
            score = sigmoid(self.trees.margin(np.array([features(k, text, a, b) for k, a, b in some])))
            good += [(s, c) for s, c in zip(score.tolist(), some) if s >= self.thresholds[c[0]]]
        taken: list[tuple[int, int, str]] = []
        for _, (k, a, b) in sorted(good, key=lambda x: (-x[0], x[1][1], x[1][2], x[1][0])):
            i = bisect_left(taken, (a,))
            if (not i or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                taken.insert(i, (a, b, k))
        return [(k, a, b) for a, b, k in taken]


def _named(c: tuple[str, int, int], text: str) -> tuple[str, str]:
    return c[0], text[c[1]:c[2]]


def fit(docs: DataFrame, precision: float = PRECISION) -> Model:
    """Trees from made candidates (``examples``) of all documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            out: dict[bool, list] = {False: [], True: []}
            for d, t in zip(ids.to_pylist(), texts.to_pylist()):
                out[zlib.crc32(str(d).encode()) % 4 == 0] += examples(str(d), t)
            some = [(held, block(np.array([x for *_, x in e]), np.array([y for _, y, _ in e]))) for held, e in out.items() if e]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in some], pa.bool_()), *(pa.array([b[k] for _, b in some], pa.binary()) for k in (0, 1))], names=["held", "x", "y"])

    found = store(texts.mapInArrow(label, "held boolean, x binary, y binary"), "pii-examples")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = [np.frombuffer(v, np.uint8) for v in b.column("y").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("held"), pa.array([len(v) for v in y], pa.int64()), pa.array([int(v.sum()) for v in y], pa.int64())], names=["held", "n", "n_right"])

    n = {r.held: (r.n, r.n_right) for r in found.select("held", "y").mapInArrow(numbers, "held boolean, n long, n_right long").groupBy("held").agg(F.sum("n").alias("n"), F.sum("n_right").alias("n_right")).collect()}
    rows, right = (sum(v[k] for v in n.values()) for k in (0, 1))
    if min(right, rows - right) < MIN_FIT or False not in n:
        return Model(None, {})
    trees = fit_boosted(found.where("not held"), N_FEATURES)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list[int]] = {}
        for x, y in rows_of(batches, N_FEATURES):
            step = np.floor(trees.margin(x) * STEPS).astype(np.int64)
            for k, s, t in zip(x[:, :len(KINDS)].argmax(1).tolist(), step.tolist(), y.tolist()):
                seen.setdefault((k, s), [0, 0])[t] += 1
        cols = [[k for k, _ in seen], [s for _, s in seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["kind", "step", "n_wrong", "n_right"])

    # As many rows as there are steps between the least and the greatest margin, whatever the examples.
    steps = found.where("held").select("x", "y").mapInArrow(scored, "kind long, step long, n_wrong long, n_right long")
    steps = steps.groupBy("kind", "step").agg(F.sum("n_wrong").alias("n_wrong"), F.sum("n_right").alias("n_right")).collect()
    thresholds = {}
    for i, k in enumerate(KINDS):
        own = sorted((r for r in steps if r.kind == i), key=lambda r: -r.step)
        t, w = (np.cumsum([r[c] for r in own]) for c in ("n_right", "n_wrong"))
        good = np.flatnonzero(t / np.maximum(1, t + w) >= precision) if len(own) else []
        if len(good) and t[-1] >= 10:
            thresholds[k] = float(max(0.5, sigmoid(np.float64(own[good[-1]].step / STEPS))))
    return Model(trees, thresholds)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, spans (kind, start, end, base) by kind as listed, then start, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for ids, texts in text_slices(batches):
            rows = []
            for t in texts.to_pylist():
                base = base_spans(t or "")
                spans = [(KINDS.index(k), a, b, True) for k, a, b in base] + [(KINDS.index(k), a, b, False) for k, a, b in model.added(t or "", base)]
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in sorted(spans)])
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with each span's characters replaced by its kind in angle brackets."""

    def one(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        out, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in [*base, *model.added(text, base)]):
            if b > at:
                out += [text[at:max(at, a)], f"<{k}>"]
                at = b
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return docs.withColumn("text", run(F.col("text").cast("string")))
