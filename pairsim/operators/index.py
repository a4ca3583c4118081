"""Vector candidate index and hybrid selection (O105): the best partner of every entity without scoring every pair.

Entities of equal vectors are one class. Classes are hashed in several tables by orthonormal directions that follow the
spread of the (unit, centred) encodings; a group of n classes uses ceil(log2 n) bits, so its buckets stay small as it grows.
A class is a member of its own bucket and probes the next ones in the order of its margins to their borders. Only pairs that
meet in a bucket are scored; a pair whose classes probe each other is scored once per table. Buckets of any size are tiled.

The unprobed buckets of a table are at least as far as the next probe's margins, as the directions are orthonormal. In exact mode
a class whose best partner is not nearer than that in any table is scored against its whole group, in tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsim.operators.model import encode_entities, head_np, tile_head
from pairsim.operators.select import best_of
from pairsim.session import cut_lineage

TABLES, PROBES = 8, 5
TILE_ROWS = 1024
#: Pairs whose encodings are held at once by a task.
PAIRS = 65_536
#: Pairs of a tile from which on it is scored as a whole.
GRID = 1024
MEMBER, PROBE, PASSIVE = 0, 1, 2


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of float64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(z: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    return np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)


def vector_classes(entities: DataFrame, group: str = "group_id", ident: str = "entity_id", vec: str = "encoding") -> tuple[DataFrame, DataFrame]:
    """(classes, members): distinct vectors of a group as (group, class_id, second, encoding), and every entity's class.

    ``class_id`` is the lowest id, ``second`` the next one (null for a class of one).
    """
    rows = entities.where(F.col(vec).isNotNull() & F.col(ident).isNotNull()).select(group, ident, F.col(vec).alias("_v"))
    # The two lowest ids by partial aggregates: a hot vector costs a row per task.
    least = rows.groupBy(group, "_v").agg(F.min(ident).alias("class_id"))
    classes = cut_lineage(least)
    members = cut_lineage(rows.join(classes, [group, "_v"]).select(group, ident, "class_id"))
    second = members.where(F.col(ident) != F.col("class_id")).groupBy(group, "class_id").agg(F.min(ident).alias("second"))
    return classes.join(second, [group, "class_id"], "left").select(group, "class_id", "second", F.col("_v").alias(vec)), members


def spread_of(encoded: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the unit encodings: sums per task, dim + dim^2 numbers in all."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim + 1, dim)), 0
        for b in batches:
            u = _unit(_matrix(b.column(0)))
            total[0] += u.sum(axis=0)
            total[1:] += u.T @ u
            n += len(u)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), n))], names=["i", "s"])

    rows = encoded.select("z").mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros(dim * (dim + 1) + 1)
    for r in rows:
        flat[r.i] = r.s
    n = max(flat[-1], 1.0)
    total = flat[:-1].reshape(dim + 1, dim) / n
    return total[0], total[1:] - np.outer(total[0], total[0])


def directions(covariance: np.ndarray, tables: int = TABLES, seed: int = 0) -> np.ndarray:
    """tables x dim x dim: orthonormal columns, drawn with the covariance's square root so that the first ones split well."""
    values, vectors = np.linalg.eigh(covariance)
    root = vectors @ (np.sqrt(np.maximum(values, 0))[:, None] * vectors.T) + 1e-9 * np.eye(len(values))
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(root @ rng.standard_normal(root.shape))[0] for _ in range(tables)])


def probes_of(margins: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``probes`` nearest other buckets as bits to flip (one or two bits), and the squared margin of the next one."""
    n, bits = margins.shape
    one = [(1 << i, np.eye(bits)[i]) for i in range(bits)]
    two = [(a | b, x + y) for i, (a, x) in enumerate(one) for b, y in one[:i]]
    flips, weight = zip(*(one + two))
    cost = margins**2 @ np.array(weight).T
    order = np.argsort(cost, axis=1, kind="stable")
    taken = np.array(flips, np.int64)[order[:, :probes]]
    least = np.take_along_axis(cost, order[:, probes:probes + 1], axis=1)[:, 0] if len(flips) > probes else np.full(n, np.inf)
    # Flips of three and more bits cost at least the three smallest margins.
    if bits > 2:
        least = np.minimum(least, np.sort(margins**2, axis=1)[:, :3].sum(axis=1))
    return taken, least


def index_rows(encoded: DataFrame, mean: np.ndarray, tables: np.ndarray, probes: int = PROBES, group: str = "group_id") -> DataFrame:
    """Bucket rows (group, t, code, role, id, own, asked, bound, z) of classes (group, class_id, z, bits).

    ``bound``: the squared distance that every class in an unprobed bucket of the table keeps.
    """
    gtype = dict(encoded.dtypes)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            z = _matrix(b.column(2))
            bits = b.column(3).to_numpy()
            for k in np.unique(bits):
                pick = np.flatnonzero(bits == k)
                rows, u = b.take(pa.array(pick)), _unit(z[pick]) - mean
                for t, axes in enumerate(tables):
                    at = u @ axes[:, :k]
                    own = ((at > 0) << np.arange(k)).sum(axis=1).astype(np.int64)
                    taken, bound = probes_of(np.abs(at), probes) if k else (np.zeros((len(pick), 0), np.int64), np.full(len(pick), np.inf))
                    codes = np.concatenate([own[:, None], own[:, None] ^ taken], axis=1)
                    m, width = codes.shape
                    fixed = np.pad(codes, ((0, 0), (0, probes + 1 - width)), constant_values=-1)
                    asked = pa.FixedSizeListArray.from_arrays(pa.array(fixed.ravel()), probes + 1).cast(pa.list_(pa.int64()))
                    # Row by row: the member, then its probes.
                    repeat = pa.array(np.repeat(np.arange(m), width))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).take(repeat), pa.array(np.full(m * width, t, np.int32)), pa.array(codes.ravel()), pa.array(np.tile([MEMBER] + [PROBE] * (width - 1), m).astype(np.int32)),
                         rows.column(1).take(repeat), pa.array(np.repeat(own, width)), asked.take(repeat), pa.array(np.repeat(bound, width)), rows.column(2).take(repeat)],
                        names=[group, "t", "code", "role", "id", "own", "asked", "bound", "z"])

    return encoded.select(group, "class_id", "z", "bits").mapInArrow(
        run, f"{group} {gtype}, t int, code long, role int, id long, own long, asked array<long>, bound double, z array<double>")


def tiled(rows: DataFrame, key: list[str], tile_rows: int = TILE_ROWS) -> DataFrame:
    """Adds (_i, _j), the tile of a bucket: members are dealt to blocks and meet each other and the probes block by block."""
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    rows = rows.join(sizes.withColumn("_nb", F.ceil(F.col("_n") / float(tile_rows)).cast("int")).drop("_n"), key)
    block = F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int")
    side = lambda i, j, s: F.struct(i.alias("_i"), j.alias("_j"), F.lit(s).alias("_side"))
    every = F.sequence(F.lit(0), F.col("_nb") - 1)
    # Rows of the grid hold members; columns hold members of later blocks, and all probes.
    as_row = F.when(F.col("role") != PROBE, F.transform(every, lambda j: side(block, j, 0)))
    as_column = F.when(F.col("role") == MEMBER, F.transform(F.filter(every, lambda i: i <= block), lambda i: side(i, block, 1)))
    probe = F.transform(every, lambda i: side(i, block, 1))
    tiles = F.coalesce(F.when(F.col("role") == PROBE, probe), F.concat(as_row, F.coalesce(as_column, F.array().cast("array<struct<_i:int,_j:int,_side:int>>"))))
    return rows.withColumn("_tile", F.explode(tiles)).select("*", "_tile.*").drop("_tile", "_nb")


def pair_best(rows: DataFrame, head: Callable[[np.ndarray, np.ndarray], np.ndarray], key: list[str], decimals: int = 6, group: str = "group_id", every_pair: bool = False,
              grid: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(group, entity, partner, score): the best partner that each class meets in a tile, per task and class.

    With ``every_pair`` all scored pairs, both ways. ``grid``: ``head`` for all pairs of two blocks, used for tiles of ``GRID`` pairs
    and more; their best partners are read off rows and columns, without a list of pairs.
    """
    gtype = dict(rows.dtypes)[group]
    full = [*key, "_i", "_j"]

    def tiles_in(b: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, first row of the column side, and end of every tile."""
        codes = [b.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in full]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
        lo, hi = np.concatenate([[0], change]), np.concatenate([change, [b.num_rows]])
        side = b.column("_side").to_numpy()
        return lo, lo + np.add.reduceat(side == 0, lo), hi  # sides are sorted inside a tile

    def best_in(b: pa.Table, lo: int, cut: int, hi: int) -> pa.RecordBatch:
        """The best partners of a tile's rows and columns; both are sorted by id, so the first of equal scores has the lowest."""
        ids, z = b.column("id").to_numpy()[lo:hi], _matrix(b.column("z").slice(lo, hi - lo).combine_chunks())
        n = cut - lo
        s = np.round(grid(z[:n], z[n:]), decimals)
        s[np.isnan(s) | (ids[:n, None] == ids[None, n:])] = -np.inf
        j, i = s.argmax(axis=1), s.argmax(axis=0)
        own, other = np.concatenate([ids[:n], ids[n:]]), np.concatenate([ids[n:][j], ids[:n][i]])
        top = np.concatenate([s[np.arange(n), j], s[i, np.arange(s.shape[1])]])
        good = top > -np.inf
        name = b.column(group).slice(lo, 1).combine_chunks()
        return pa.RecordBatch.from_arrays([name.take(pa.array(np.zeros(good.sum(), np.int64))), pa.array(own[good]), pa.array(other[good]), pa.array(top[good])],
                                          names=[group, "entity", "partner", "score"])

    def pairs_of(lo: np.ndarray, cut: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the row and column sides of all pairs, tile by tile."""
        na, nb = cut - lo, hi - cut
        n = na * nb
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(np.maximum(nb, 1), n)
        return np.repeat(lo, n) + k // wide, np.repeat(cut, n) + k % wide

    def score(b: pa.Table) -> Iterator[pa.RecordBatch]:
        lo, cut, hi = tiles_in(b)
        large = (cut - lo) * (hi - cut) >= GRID if grid is not None and not every_pair else np.zeros(len(lo), bool)
        for tile in zip(lo[large], cut[large], hi[large]):
            yield best_in(b, *map(int, tile))
        if large.all():
            return
        i, j = pairs_of(lo[~large], cut[~large], hi[~large])
        ids, own, role, code = (b.column(c).to_numpy() for c in ("id", "own", "role", "code"))
        # Two members meet once; a probe is left to the other bucket if that class probes back and has the larger code.
        keep = ids[i] != ids[j]
        both = (role[i] == MEMBER) & (role[j] == MEMBER)
        same_block = b.column("_i").to_numpy()[i] == b.column("_j").to_numpy()[i]
        keep &= ~both | ~same_block | (ids[i] < ids[j])
        asked = b.column("asked").combine_chunks()
        if len(asked) and len(asked.flatten()):
            width = len(asked.flatten()) // len(asked)
            codes = asked.flatten().to_numpy().reshape(-1, width)
            back = (codes[i] == own[j][:, None]).any(axis=1) if width * len(i) < 50_000_000 else np.concatenate([(codes[i[a:a + PAIRS]] == own[j[a:a + PAIRS], None]).any(axis=1) for a in range(0, len(i), PAIRS)])
            keep &= ~((role[j] == PROBE) & (role[i] == MEMBER) & back & (own[j] < code[j]))
        i, j = i[keep], j[keep]
        z = _matrix(b.column("z").combine_chunks())
        s = np.concatenate([np.zeros(0)] + [head(z[i[a:a + PAIRS]], z[j[a:a + PAIRS]]) for a in range(0, len(i), PAIRS)])
        s = np.round(s, decimals)
        good = ~np.isnan(s)
        i, j, s = i[good], j[good], s[good]
        at, to, s = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([s, s])
        names = b.column(group).combine_chunks()
        if not every_pair:
            g = names.dictionary_encode().indices.to_numpy()
            order = np.lexsort((ids[to], -s, ids[at], g[at]))
            at, to, s = at[order], to[order], s[order]
            first = np.ones(len(at), bool)
            first[1:] = (ids[at[1:]] != ids[at[:-1]]) | (g[at[1:]] != g[at[:-1]])
            at, to, s = at[first], to[first], s[first]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(ids[at]), pa.array(ids[to]), pa.array(s)], names=[group, "entity", "partner", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            codes = [b.column(c).dictionary_encode().indices.to_numpy() for c in full]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
            new = bool(held) and any(held[-1].column(c)[-1].as_py() != b.column(c)[0].as_py() for c in full)
            if len(change) or new:
                cut = int(change[-1]) if len(change) else 0
                whole = pa.Table.from_batches([*held, b.slice(0, cut)])
                held = [b.slice(cut)]
                if whole.num_rows:
                    yield from score(whole)
            else:
                held.append(b)
        if held:
            yield from score(pa.Table.from_batches(held))

    spread = rows.select(*full, "_side", "role", "id", "own", "asked", "z", *([] if "code" in full else ["code"])).repartition(*full).sortWithinPartitions(*full, "_side", "id")
    return spread.mapInArrow(run, f"{group} {gtype}, entity long, partner long, score double")


def _encoded(classes: DataFrame, w: dict, group: str) -> DataFrame:
    """group, class_id, z, bits (of the class's group)."""
    z = encode_entities(classes.withColumnRenamed("class_id", "entity_id"), w, group=group).withColumnRenamed("entity_id", "class_id")
    sizes = classes.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    bits = F.least(F.ceil(F.log2(F.greatest(F.col("_n"), F.lit(1)))), F.lit(24)).cast("int")
    return cut_lineage(z.join(sizes, group).withColumn("bits", bits).drop("_n"))


def index_pairs(entities: DataFrame, w: dict, tables: int = TABLES, probes: int = PROBES, seed: int = 0, group: str = "group_id", tile_rows: int = TILE_ROWS) -> DataFrame:
    """Every pair of classes that the index scores (group, entity, partner, score), both ways, once per table that finds it."""
    classes, _ = vector_classes(entities, group)
    z = _encoded(classes, w, group)
    mean, covariance = spread_of(z, _width(w))
    rows = index_rows(z, mean, directions(covariance, tables, seed), probes, group)
    return pair_best(tiled(rows, [group, "t", "code"], tile_rows), lambda a, b: head_np(w, a, b), [group, "t", "code"], group=group, every_pair=True)


def _width(w: dict) -> int:
    return len(w["b2"]) if "b2" in w else len(w["be"])


def hybrid_partners(entities: DataFrame, w: dict, exact: bool = False, tables: int = TABLES, probes: int = PROBES, seed: int = 0, decimals: int = 6, group: str = "group_id", tile_rows: int = TILE_ROWS) -> DataFrame:
    """O105: (group, entity, partner, score), the best partner by the network's score; ties go to the lower id.

    Without ``exact`` the best among the candidates of the index. With it, classes that the index can't settle are scored
    against their group; for a network whose score is not a rising function of the cosine that is every class.
    Entities without a partner in their group have no row.
    """
    head, grid = lambda a, b: head_np(w, a, b), tile_head(w)
    classes, members = vector_classes(entities, group)
    z = _encoded(classes, w, group)
    mean, covariance = spread_of(z, _width(w))
    rows = index_rows(z, mean, directions(covariance, tables, seed), probes, group)
    found = pair_best(tiled(rows, [group, "t", "code"], tile_rows), head, [group, "t", "code"], decimals, group, grid=grid)
    best = cut_lineage(best_of(found, group))
    if exact:
        rising = w["kind"] == "siamese_dot" and float(w["Wo"][0, 0]) > 0
        bound = rows.where(F.col("role") == MEMBER).groupBy(group, F.col("id").alias("class_id")).agg(F.max("bound").alias("bound"))
        open_ = z.join(bound, [group, "class_id"], "left").join(best.select(group, F.col("entity").alias("class_id"), "score"), [group, "class_id"], "left")
        if rising:
            # Unit vectors at squared distance d have cosine 1 - d / 2: the best score that an unseen class can have.
            scale, shift = float(w["Wo"][0, 0]), float(w["bo"][0])
            unseen = F.round(1 / (1 + F.exp(-(scale * (1 - F.col("bound") / 2 + 1e-9) + shift))), decimals)
            settled = F.isnan("bound") | (F.col("bound") == float("inf")) | (F.col("score") > unseen)
            open_ = open_.where(~F.coalesce(settled, F.lit(False)))
        plain = lambda df, role: df.select(group, F.lit(0).alias("code"), F.lit(role).alias("role"), F.col("class_id").alias("id"), F.lit(-1).cast("long").alias("own"), F.array().cast("array<long>").alias("asked"), "z")
        whole = plain(z, PASSIVE).unionByName(plain(open_, PROBE))
        rest = pair_best(tiled(whole, [group, "code"], tile_rows), head, [group, "code"], decimals, group, grid=grid)
        best = cut_lineage(best_of(best.unionByName(rest), group))
    # Entities of one class have each other at the class's own score.
    twin = z.join(classes.where("second is not null").select(group, "class_id", "second"), [group, "class_id"])
    twin = _own_scores(twin, head, decimals, group)
    out = members.join(best.withColumnRenamed("entity", "class_id"), [group, "class_id"]).select(group, F.col("entity_id").alias("entity"), "partner", "score")
    own = members.join(twin, [group, "class_id"]).select(
        group, F.col("entity_id").alias("entity"), F.when(F.col("entity_id") == F.col("class_id"), F.col("second")).otherwise(F.col("class_id")).alias("partner"), "score")
    return best_of(out.unionByName(own), group)


def _own_scores(classes: DataFrame, head: Callable, decimals: int, group: str) -> DataFrame:
    gtype = dict(classes.dtypes)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = _matrix(b.column(3))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.round(head(z, z), decimals))], names=[group, "class_id", "second", "score"])

    return classes.select(group, "class_id", "second", "z").mapInArrow(run, f"{group} {gtype}, class_id long, second long, score double").where(~F.isnan("score"))
