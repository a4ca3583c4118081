"""Exact top-k inner-product search by MaxScore over shards.

Vectors of integers are documents whose terms are the dimensions: a dimension's postings are the vectors with a non-zero
value there. Candidates are hashed into shards and queries into blocks; each (block, shard) pair is one task group of
bounded size. Inside a shard candidates are numbered by falling length, and every posting list is cut into blocks of
neighbouring numbers with their greatest and least value: a bound per query, block and dimension. The dimensions whose
bounds together stay under the query's current k-th score are non-essential, the others essential. A block is passed over
if all are non-essential; otherwise only candidates in an essential posting list are scored, and those that can still reach
the k-th score are probed in the other dimensions, in falling order of bound. Shards' top-k lists are merged per query.
Dimensions without a posting cost nothing, so vectors may be sparse and of many dimensions.

Defined cases: vectors that are null, empty of values (a null or non-finite component) or without id take no part; a
shorter vector counts as 0 in missing dimensions; an empty vector scores 0. ``vec_id`` is the identity: every row with
the query's id is the query's own; a repeated query row is one query, a repeated candidate row is ranked each time. Ties
go to the smaller id. Scores are exact while |score| < 2**63.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
BLOCK_ROWS = 4096
#: Candidates of a block of postings, queries traversed at once, and the values of a block that are laid out together.
STEP, QUERIES, CELLS = 2048, 512, 1 << 23


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id, v array<long> = floor(scale * x) of every finite vector; other rows take no part."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * float(scale)).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def entries(rows: np.ndarray | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and value of all that is not 0, by row."""
    if isinstance(rows, np.ndarray):
        row, dim = np.nonzero(rows)
        return row, dim, rows[row, dim].astype(np.int64)
    lists = rows.column("v").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    lens = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    value = lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    dim = np.arange(len(value)) - np.repeat(np.cumsum(lens) - lens, lens)
    held = value != 0
    return row[held], dim[held], value[held]


def _top(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by falling score, then id."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[keep], score[keep]


def _groups(row: np.ndarray, dim: np.ndarray, n: int) -> list[tuple[int, int, np.ndarray]]:
    """Runs of queries (from, to, their dimensions), at most QUERIES, fewer where they have many different dimensions."""
    out, at = [], 0
    while at < n:
        size = min(QUERIES, n - at)
        while True:
            dims = np.unique(dim[np.searchsorted(row, at):np.searchsorted(row, at + size)])
            if size == 1 or len(dims) * STEP <= CELLS:
                break
            size //= 2
        out.append((at, at + size, dims))
        at += size
    return out


def max_score(qid: np.ndarray, q: np.ndarray | pa.Table, cid: np.ndarray, x: np.ndarray | pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top k of each query row over one shard: (query row, candidate id, score)."""
    (q_row, q_dim, q_val), (row, dim, val) = entries(q), entries(x)
    held = np.isin(dim, q_dim)  # other dimensions add nothing to any score
    row, dim, val = row[held], dim[held], val[held]
    groups = _groups(q_row, q_dim, len(qid))
    top = float(np.abs(q_val).max(initial=0)) * float(np.abs(val).max(initial=0)) * max((len(g[2]) for g in groups), default=1)
    kind = np.float64 if top < 2**53 else np.int64
    step = max(1, min(STEP, CELLS // max([1, *(len(g[2]) for g in groups)])))
    # Long vectors first, for high k-th scores early; postings by block, dimension and number.
    order = np.argsort(-np.bincount(row, np.abs(val).astype(np.float64), len(cid)), kind="stable")
    number = np.empty(len(cid), np.int64)
    number[order] = np.arange(len(cid))
    cid, row = cid[order], number[row]
    order = np.lexsort((row, dim, row // step))
    row, dim, val = row[order], dim[order], val[order].astype(kind)
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    kth = np.full(len(qid), -np.inf)  # the k-th score so far
    dense = []
    for lo, hi, dims in groups:
        at = slice(np.searchsorted(q_row, lo), np.searchsorted(q_row, hi))
        rows = np.zeros((hi - lo, len(dims)), kind)
        rows[q_row[at] - lo, np.searchsorted(dims, q_dim[at])] = q_val[at]
        dense.append(rows)
    for first in range(0, len(cid), step):
        ids = cid[first:first + step]
        at = slice(*np.searchsorted(row // step, [first // step, first // step + 1]))
        b_row, b_dim, b_val = row[at] - first, dim[at], val[at]
        lists, starts, counts = np.unique(b_dim, return_index=True, return_counts=True)
        high = np.maximum.reduceat(b_val, starts) if len(starts) else np.zeros(0, kind)
        low = np.minimum.reduceat(b_val, starts) if len(starts) else np.zeros(0, kind)
        some = counts < len(ids)  # a candidate outside the list has 0
        high, low = np.where(some, np.maximum(high, 0), high), np.where(some, np.minimum(low, 0), low)
        new = [found]
        for (lo, hi, dims), rows in zip(groups, dense):
            new.append(_block(qid[lo:hi], rows, dims, kth[lo:hi], ids, b_row, b_dim, b_val, lists, high, low))
            new[-1][0] += lo
        found = list(_top(*[np.concatenate(c) for c in zip(*new)], k))
        counts = np.bincount(found[0], minlength=len(qid))
        full = counts >= k
        kth[full] = found[2][(np.cumsum(counts) - 1)[full]]
    return tuple(found)


def _block(qid, q, dims, kth, ids, row, dim, val, lists, high, low) -> list[np.ndarray]:
    """(query, candidate id, score) of all in one block of postings that reach the k-th scores ``kth``; maybe some more."""
    mine = np.isin(lists, dims)
    lists, high, low = lists[mine], high[mine], low[mine]
    q = q[:, np.searchsorted(dims, lists)]
    bound = np.maximum(q * high, q * low)
    by_bound = np.argsort(bound, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(bound, by_bound, 1), axis=1)
    # Non-essential: the longest run of least bounds whose sum stays under the k-th score.
    under = sums < kth[:, None]
    n_spare = np.where(under.any(1), len(lists) - np.argmax(under[:, ::-1], axis=1), 0) if len(lists) else np.zeros(len(q), np.int64)
    live = np.flatnonzero((n_spare < len(lists)) | ((len(lists) == 0) & (kth <= 0)))
    none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    if not len(live):
        return none
    qid, q, kth, n_spare, bound, by_bound, sums = (a[live] for a in (qid, q, kth, n_spare, bound, by_bound, sums))
    spare = np.zeros(q.shape, bool)
    np.put_along_axis(spare, by_bound, np.arange(len(lists)) < n_spare[:, None], 1)
    rest = np.where(spare, bound, 0).sum(1)
    place = np.searchsorted(lists, dim)
    own = (place < len(lists)) & (lists[np.minimum(place, len(lists) - 1)] == dim) if len(lists) else np.zeros(len(dim), bool)
    row, place, val = row[own], place[own], val[own]
    # Only candidates in an essential list, unless one in none of them can still be among the best.
    touched = np.zeros(len(ids), bool)
    if (rest >= kth).any():
        touched[:] = True
    else:
        touched[row[(~spare & (q != 0)).any(0)[place]]] = True
    part = np.zeros((len(ids), len(lists)), q.dtype)
    part[row, place] = val
    part, ids = part[touched], ids[touched]
    score = np.where(spare, 0, q) @ part.T
    qi, ci = np.nonzero((score + rest[:, None] >= kth[:, None]) & (ids[None, :] != qid[:, None]))
    score = score[qi, ci]
    # Probe the others in falling order of bound, in groups, while the candidate stays competitive.
    for group in range(0, int(n_spare.max(initial=0)), 8):
        if not (n_spare[qi] > group).any():
            break
        pos = n_spare[:, None] - 1 - np.arange(group, group + 8)[None, :]
        cols = np.take_along_axis(by_bound, np.maximum(pos, 0), 1)
        weight = np.where(pos >= 0, np.take_along_axis(q, cols, 1), 0)
        rest = rest - np.where(pos >= 0, np.take_along_axis(bound, cols, 1), 0).sum(1)
        for lo in range(0, len(qi), 65536):
            s = slice(lo, lo + 65536)
            score[s] += (weight[qi[s]] * part[ci[s][:, None], cols[qi[s]]]).sum(1)
        keep = score + rest[qi] >= kth[qi]
        qi, ci, score = qi[keep], ci[keep], score[keep]
    return [live[qi], ids[ci], score.astype(np.int64)]


def top_k(queries: DataFrame, candidates: DataFrame, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query; both sides have vec_id, v."""
    queries = queries.dropDuplicates(["vec_id", "v"])
    shards = max(1, -(-candidates.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))
    part = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("vec_id")), F.lit(n)).cast("int")
    left = queries.withColumn("block", part(blocks, "b")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = candidates.withColumn("shard", part(shards, "s")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        qid, cid = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
        row, ids, score = max_score(qid, a, cid, b, k) if len(qid) and len(cid) else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": qid[row].astype(np.int64), "q_row": _row_keys(a)[row], "vec_id": ids.astype(np.int64), "score": score.astype(np.int64)})

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(search, "query_id long, q_row long, vec_id long, score long")
    w = Window.partitionBy("query_id", "q_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _row_keys(q: pa.Table) -> np.ndarray:
    """A key of each query vector, equal in all shards: tells apart query rows that share an id but not a vector."""
    row, dim, value = entries(q)  # missing dimensions add nothing, as zeros do
    keys = np.zeros(q.num_rows, np.uint64)
    factors = np.cumprod(np.full(int(dim.max(initial=0)) + 1, 1099511628211, np.uint64))
    np.add.at(keys, row, value.astype(np.uint64) * factors[dim])
    return keys.view(np.int64)


def top_k_rows(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, **sizes: int) -> DataFrame:
    """Quantises a table of vectors and searches every row for the rows that ``is_query`` (over vec_id) selects."""
    every = quantise(vectors, id_col, vec_col, scale)
    return top_k(every.where(is_query), every, k, **sizes)
