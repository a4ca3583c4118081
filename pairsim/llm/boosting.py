"""Boosted trees (``models.Boosted``) fitted on all rows of a stored table, whatever their number.

Rows are whole numbers in blocks and are kept as a few codes each. Every level of a tree is a pass over them: tasks return their sums by
node, column and bin (some KB, whatever the rows), from which the driver draws the splits. Several columns make one code, so
that rows are counted once per code and the columns' sums are read off its table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsim.llm.models import Boosted, sigmoid
from pairsim.llm.shared import store

#: Cells of a code's table, at most (more only where one column has more bins).
CELLS = 2048
#: Rows that are counted at once: their codes, slopes and the tables stay in the cache.
SLAB = 65_536


def block(x: np.ndarray, y: np.ndarray) -> tuple[bytes, bytes]:
    """Rows of whole numbers and their labels as the bytes of a block."""
    return np.clip(x, -32768, 32767).astype(np.int16).tobytes(), np.asarray(y, np.uint8).tobytes()


def rows_of(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of the blocks of Arrow batches with columns x and y."""
    for b in batches:
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
            yield np.frombuffer(x, np.int16).reshape(-1, columns), np.frombuffer(y, np.uint8)


def quantiles(values: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``np.quantile`` of the values, ascending, each taken as often as it counts."""
    ends = np.cumsum(counts)
    place = (ends[-1] - 1) * at
    low = np.floor(place)
    a, b = (values[np.searchsorted(ends, np.minimum(p, ends[-1] - 1), "right")].astype(float) for p in (low, low + 1))
    share = place - low
    return np.where(share >= 0.5, b - (b - a) * (1 - share), a + (b - a) * share)


def value_counts(blocks: DataFrame, columns: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int]:
    """(values, ascending, and their counts) of every column, the number of rows and that of labels 1. As many rows as there are different values."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for x, y in rows_of(batches, columns):
            for j in range(columns + 1):
                for v, n in zip(*(a.tolist() for a in np.unique(y if j == columns else x[:, j], return_counts=True))):
                    seen[j, v] = seen.get((j, v), 0) + n
        cols = [[j for j, _ in seen], [v for _, v in seen], list(seen.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["j", "v", "n"])

    found = blocks.select("x", "y").mapInArrow(count, "j long, v long, n long").groupBy("j", "v").agg(F.sum("n").alias("n")).collect()
    by: list[list] = [sorted((r.v, r.n) for r in found if r.j == j) for j in range(columns + 1)]
    return [tuple(np.array(c, np.int64) for c in (zip(*b) if b else ((), ()))) for b in by[:-1]], sum(n for _, n in by[-1]), sum(n for v, n in by[-1] if v)


def _codes(sizes: list[int]) -> list[list[int]]:
    """Columns that make a code together."""
    out: list[list[int]] = []
    for j in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
        own = next((g for g in out if np.prod([sizes[k] for k in g]) * sizes[j] <= CELLS), None)
        if own is None:
            out.append([j])
        else:
            own.append(j)
    return out


def fit_boosted(blocks: DataFrame, columns: int, trees: int = 60, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0) -> Boosted:
    """``Boosted(...).fit`` of all rows of ``blocks`` (x, y: bytes of ``block``), of which there must be some."""
    counts, n_rows, n_right = value_counts(blocks, columns)
    model = Boosted(trees, depth, rate, bins, l2)
    model.edges = [np.unique(quantiles(v, n, np.linspace(0, 1, bins + 1)[1:-1])) for v, n in counts]
    share = np.clip(n_right / n_rows, 1e-6, 1 - 1e-6)
    model.base, model.forest = float(np.log(share / (1 - share))), []
    sizes = [len(e) + 1 for e in model.edges]
    codes = _codes(sizes)
    shapes = [[sizes[j] for j in g] for g in codes]
    group = {j: k for k, g in enumerate(codes) for j in g}
    base, edges = model.base, model.edges
    kind = np.uint16 if max(map(np.prod, shapes)) <= 65_536 else np.uint32

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            code, y = np.concatenate([c for c, _ in held], 1), np.concatenate([y for _, y in held])
            return pa.RecordBatch.from_arrays([pa.array([code.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["code", "y"])

        held: list = []
        for x, y in rows_of(batches, columns):
            b = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
            held.append((np.stack([np.ravel_multi_index([b[j] for j in g], s) for g, s in zip(codes, shapes)]).astype(kind), y))
            if sum(len(y) for _, y in held) >= SLAB:
                yield out(held)
                held = []
        if held:
            yield out(held)

    def unpack(r) -> tuple:
        y = np.frombuffer(r.y, np.uint8)
        return np.frombuffer(r.code, kind).reshape(len(codes), -1), y, np.full(len(y), base)

    def place(code: np.ndarray, tree: list) -> np.ndarray:
        """The nodes that rows are in after the levels of a tree."""
        node = np.zeros(code.shape[1], np.uint8)
        for feature, cut in tree:
            goes = np.zeros(len(node), bool)
            for q, (j, most) in enumerate(zip(feature.tolist(), cut.tolist())):
                k = group[j]
                # Of each cell of the code that decides: whether its rows go right.
                right = np.unravel_index(np.arange(int(np.prod(shapes[k]))), shapes[k])[codes[k].index(j)] > most
                goes |= (node == q) & right[code[k]]
            node = node * np.uint8(2) + goes.astype(np.uint8)
        return node

    def sums(tree: list):
        """The slopes and curvatures of a task's rows by column, node and bin."""
        n = 2 ** len(tree)

        def run(_: int, rows: Iterator[tuple]) -> Iterator[np.ndarray]:
            tables = [np.zeros((2, n, *s)) for s in shapes]
            for code, y, f in rows:
                p = sigmoid(f)
                grad, hess, node = y - p, np.maximum(p * (1 - p), 1e-6), place(code, tree)
                for c, table, s in zip(code, tables, shapes):
                    cells = int(np.prod(s))
                    at = c.astype(np.int64) if n == 1 else node * np.int64(cells) + c
                    for k, weight in enumerate((grad, hess)):
                        table[k] += np.bincount(at, weight, n * cells).reshape(n, *s)
            out: list[np.ndarray] = [np.zeros(0)] * columns
            for g, table in zip(codes, tables):
                for i, j in enumerate(g):
                    out[j] = table.sum(axis=tuple(a + 2 for a in range(len(g)) if a != i)).ravel()
            yield np.concatenate(out)

        return run

    def moved(tree: list, leaf: np.ndarray):
        return lambda row: (row[0], row[1], row[2] + leaf[place(row[0], tree)])

    # Every task reads some blocks; a tree's rows are kept (beyond memory on disk) until the next tree has moved them.
    tasks = max(1, blocks.sparkSession.sparkContext.defaultParallelism)
    packed = store(blocks.select("x", "y").repartition(tasks).mapInArrow(load, "code binary, y binary"), "boosted-codes")
    rows = packed.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)
    before = None
    for _ in range(trees):
        tree: list = []
        for level in range(depth):
            n = 2**level
            # Some KB of each task, added up in their order.
            whole = np.sum(rows.mapPartitionsWithIndex(sums(tree)).collect(), axis=0)
            if before is not None:
                before.unpersist()
                before = None
            best, feature, cut = np.zeros(n), np.zeros(n, np.int64), np.full(n, bins + 1)  # a cut beyond all bins: nothing goes right
            left = np.zeros((2, n))
            at = 0
            for j, size in enumerate(sizes):
                g, h = np.cumsum(whole[at:at + 2 * n * size].reshape(2, n, size), 2)
                at += 2 * n * size
                if j == 0:
                    every = np.stack([g[:, -1], h[:, -1]])
                    left = every.copy()
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + l2) + rest_g**2 / (rest_h + l2) - g[:, -1:] ** 2 / (h[:, -1:] + l2)
                c = gain.argmax(1)
                here = np.arange(n)
                more = gain[here, c] > best + 1e-9
                best, feature, cut = np.where(more, gain[here, c], best), np.where(more, j, feature), np.where(more, c, cut)
                left = np.where(more, np.stack([g[here, c], h[here, c]]), left)
            tree.append((feature, cut))
        grad, hess = np.stack([left, every - left], 2).reshape(2, -1)
        leaf = rate * grad / (np.maximum(hess, 0) + l2)
        model.forest.append((tree, leaf))
        before, rows = rows, rows.map(moved(tree, leaf)).persist(StorageLevel.MEMORY_AND_DISK)
    before.unpersist()
    rows.unpersist()
    return model
