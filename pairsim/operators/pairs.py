"""Candidate-pair generation and pair-level joins (O27-O35, O109, O111).

Pairs never cross a group, so the group is the natural partition key. A
single group may hold a large share of all entities, so the exhaustive
self-join is tiled: each group of n entities is cut into ceil(n / tile_rows)
hash blocks and the join key is (group, row block, column block). Only the
upper triangle of tiles is generated, so every unordered pair is produced
exactly once and no tile is larger than tile_rows x tile_rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TILE_ROWS = 2048


def _keys(group) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def _with_blocks(entities: DataFrame, group, ident: str, tile_rows: int) -> DataFrame:
    keys = _keys(group)
    # Per-key sizes are pre-aggregated (map-side combine), one row per key.
    sizes = entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # A key with one member has no pair: its row goes no further than this.
    sizes = sizes.where("_n > 1").select(*keys, F.ceil(F.col("_n") / F.lit(tile_rows)).cast("int").alias("_nb"))
    # No hint: AQE broadcasts the aggregated side when its measured size is small,
    # and keeps a shuffle join (with skew splitting) otherwise.
    sized = entities.join(sizes, keys)
    return sized.withColumn("_b", F.pmod(F.xxhash64(F.col(ident)), F.col("_nb")).cast("int"))


def all_pairs(entities: DataFrame, group="group_id", ident: str = "entity_id",
              payload: list[str] | None = None, tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """Every unordered pair (id1 < id2) of entities sharing the key ``group`` (a column or a list of columns).

    ``payload`` columns are carried along as ``<col>1`` / ``<col>2``.
    """
    payload = payload or []
    keys = _keys(group)
    blk = _with_blocks(entities.select(*keys, ident, *payload), keys, ident, tile_rows)
    left = blk.select(*keys, F.col(ident).alias("_l"), *[F.col(c).alias(f"_l_{c}") for c in payload],
                      F.col("_b").alias("_bi"), F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)).alias("_bj"))
    right = blk.select(*[F.col(k).alias(f"_k2_{k}") for k in keys], F.col(ident).alias("_r"),
                       *[F.col(c).alias(f"_r_{c}") for c in payload],
                       F.col("_b").alias("_bj2"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_bi2"))
    cond = (F.col("_bi") == F.col("_bi2")) & (F.col("_bj") == F.col("_bj2"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k2_{k}"))
    joined = left.join(right, cond & ((F.col("_bi") < F.col("_bj")) | (F.col("_l") < F.col("_r"))))
    first = F.col("_l") < F.col("_r")
    out = [*[F.col(k) for k in keys], F.least("_l", "_r").alias("id1"), F.greatest("_l", "_r").alias("id2")]
    for c in payload:
        out.append(F.when(first, F.col(f"_l_{c}")).otherwise(F.col(f"_r_{c}")).alias(f"{c}1"))
        out.append(F.when(first, F.col(f"_r_{c}")).otherwise(F.col(f"_l_{c}")).alias(f"{c}2"))
    return joined.select(*out)


def _tiled_features(entities: DataFrame, group: str, ident: str, cols: list[str], tile_rows: int) -> DataFrame:
    """Every pair of a group with ``cols`` of both members: what joining them to ``all_pairs`` gives, without moving a pair.

    An entity travels once per tile of its block. A member that is listed m times is met m times by the pairs and m times by
    the join, so each of its pairs stands that often.
    """
    copies = entities.groupBy(group, ident).agg(F.count(F.lit(1)).alias("_copies"))
    each = entities.select(group, ident, *cols).join(copies, [group, ident])
    pairs = all_pairs(each, group, ident, payload=[*cols, "_copies"], tile_rows=tile_rows)
    times = F.array_repeat(F.lit(0), (F.col("_copies1") * F.col("_copies2")).cast("int"))
    return pairs.withColumn("_time", F.explode(times)).drop("_copies1", "_copies2", "_time")


def pair_features(pairs: DataFrame | None, entities: DataFrame, group: str = "group_id", ident: str = "entity_id",
                  feature: str = "encoding", tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """Attach the feature of both members on the composite key (group, id).

    ``pairs`` are stored and dealt to tiles once, where both features are
    looked up (``lookup.pair_rows``): filter them before, as nothing is
    pushed below that. With ``pairs`` None all pairs of every group (``all_pairs``): their features
    are attached inside the tiles, so neither a pair nor its features are shuffled.
    """
    if pairs is None:
        return _tiled_features(entities, group, ident, [feature], tile_rows)
    from pairsim.operators.lookup import pair_rows

    return pair_rows(pairs, entities, group, ident, feature)


def pair_features_uid(pairs: DataFrame | None, encodings: DataFrame, uid: str = "uid", feature: str = "encoding",
                      group: str = "group_id", ident: str = "entity_id", tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """Attach features by a dense surrogate id (one long key per side).

    With ``pairs`` None all pairs of every ``group`` of ``encodings``, numbered and attached inside their tiles.
    """
    if pairs is None:
        return _tiled_features(encodings, group, ident, [uid, feature], tile_rows).select(f"{uid}1", f"{uid}2", f"{feature}1", f"{feature}2")
    e1 = encodings.select(F.col(uid).alias("uid1"), F.col(feature).alias(f"{feature}1"))
    e2 = encodings.select(F.col(uid).alias("uid2"), F.col(feature).alias(f"{feature}2"))
    return pairs.join(e1, "uid1").join(e2, "uid2")


def _both_sides(pairs: DataFrame, group: str, extra: list[str] | None = None) -> DataFrame:
    """Each pair as two rows (entity, partner) from one pass over ``pairs`` (explode, not a union that
    would evaluate the pair plan twice)."""
    extra = extra or []
    sides = F.explode(F.array(
        F.struct(F.col("id1").alias("entity"), F.col("id2").alias("partner")),
        F.struct(F.col("id2").alias("entity"), F.col("id1").alias("partner")))).alias("_s")
    return pairs.select(F.col(group), *[F.col(c) for c in extra], sides).select(group, *extra, "_s.entity", "_s.partner")


def mirror(pairs: DataFrame, group: str, score: str) -> DataFrame:
    """Both directions of each pair as (group, entity, partner, score); pairs without a score (NULL, NaN) are left out."""
    named = pairs.withColumnRenamed(score, "score") if score != "score" else pairs
    named = named.where(F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))
    return _both_sides(named, group, ["score"]).select(group, "entity", "partner", "score")


def semi_members(entities: DataFrame, pairs: DataFrame, group: str = "group_id", ident: str = "entity_id") -> DataFrame:
    """Entities referenced by either side of a pair table (left semi join)."""
    # Distinct ids are found map-side first: a task's pairs name the same entities over and over.
    ids = _both_sides(pairs, group).select(F.col(group), F.col("entity").alias(ident)).distinct()
    return entities.join(ids, [group, ident], "left_semi")


def pair_member_ids(pairs: DataFrame, group: str = "group_id") -> DataFrame:
    """Distinct ids referenced by either side (UNION distinct)."""
    return _both_sides(pairs, group).select(F.col(group), F.col("entity").alias("entity_id")).distinct()


def semi_groups(groups: DataFrame, pairs: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups referenced by a pair table."""
    return groups.join(pairs.select(group), group, "left_semi")


def listed_pairs(entities: DataFrame, listed: DataFrame, group: str = "group_id", ident: str = "entity_id") -> DataFrame:
    """O109: the listed pairs whose members are both entities of the group; no pair table is built.

    The list is unordered, so it is normalised to (least, greatest); a pair of an entity with itself is none.
    """
    norm = listed.select(F.col(group), F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2")).where("id1 < id2").distinct()
    ids = entities.select(group, ident)
    for side in ("id1", "id2"):
        norm = norm.join(ids.withColumnRenamed(ident, side), [group, side], "left_semi")
    return norm.select(group, "id1", "id2")


def content_digest(content: str) -> list[Column]:
    """Length, md5 and a 64-bit hash of a text."""
    return [F.octet_length(content).alias("_len"), F.md5(F.col(content)).alias("_md5"), F.xxhash64(content).alias("_hash")]


def exact_duplicates(entities: DataFrame, content: str, group: str = "group_id", ident: str = "entity_id", digest=content_digest) -> DataFrame:
    """O111: entities of equal content, as (group, entity, class, members): class is the lowest id of the content.

    Hash, then verify: digests name classes, as rows of k copies, not k(k-1)/2 pairs (a hot digest is counted map-side and split
    by AQE when its class is joined back). Only members of classes carry their content further, where each is compared with its
    class's representative; the rows that differ from it are classes by their whole content.
    """
    keys = digest(content)
    h = entities.where(F.col(content).isNotNull()).select(group, F.col(ident), *keys)
    key = [group, *h.columns[2:]]
    classes = h.groupBy(*key).agg(F.min(ident).alias("class_id"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    found = h.join(classes, key).select(group, ident, "class_id")
    texts = entities.select(group, ident, F.col(content).alias("_text"))
    heads = texts.select(group, F.col(ident).alias("class_id"), F.col("_text").alias("_head"))
    heads = heads.join(found.where(F.col(ident) == F.col("class_id")).select(group, "class_id"), [group, "class_id"], "left_semi")
    checked = found.join(texts, [group, ident]).join(heads, [group, "class_id"])
    same = checked.where(F.col("_text") == F.col("_head")).select(group, ident, "class_id")
    # Rows that share a digest with another content: next to none, so their classes may be keyed by the content itself.
    other = checked.where(F.col("_text") != F.col("_head")).select(group, ident, "_text")
    own = other.groupBy(group, "_text").agg(F.min(ident).alias("class_id"))
    out = same.unionByName(other.join(own, [group, "_text"]).select(group, ident, "class_id"))
    sizes = out.groupBy(group, "class_id").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return out.join(sizes, [group, "class_id"]).select(group, ident, "class_id", "members")


def tile_sides(entities: DataFrame, group: str, ident: str, cols: list[str], tile_rows: int) -> DataFrame:
    """Rows of every tile (group, _ti, _tj) of the upper triangle, tagged with their side (0 = row block, 1 = column block)."""
    blk = _with_blocks(entities.select(group, ident, *cols), group, ident, tile_rows)
    left = blk.select(group, ident, *cols, F.col("_b").alias("_ti"),
                      F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)).alias("_tj"), F.lit(0).alias("_side"))
    right = blk.select(group, ident, *cols, F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_ti"),
                       F.col("_b").alias("_tj"), F.lit(1).alias("_side"))
    return left.unionByName(right)


def _tile_scores(a, b, measure):
    """Scores of all pairs of two float64 row blocks: dot, cosine (NaN on a zero norm), L1 or a function of both."""
    import numpy as np

    if callable(measure):
        return measure(a, b)
    if measure == "l1":
        out = np.empty((len(a), len(b)))
        for s in range(0, len(a), 64):
            out[s:s + 64] = np.abs(a[s:s + 64, None, :] - b[None, :, :]).sum(axis=2)
        return out
    if measure not in ("dot", "cosine"):
        raise ValueError(measure)
    out = a @ b.T
    if measure == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            out = out / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        out[~np.isfinite(out)] = np.nan
    return out


def vector_partners(entities: DataFrame, k: int, group: str = "group_id", ident: str = "entity_id", vec: str = "encoding",
                    measure="cosine", decimals: int = 6, tile_rows: int = 1024) -> DataFrame:
    """O79 / O85 over vectors without a pair table: each tile returns the k best partners of its rows and columns.

    ``measure``: as in ``_tile_scores``, or a function of two row blocks.

    (group, entity, partner, score): at most 2 x tile_rows x k rows leave a
    tile; the k best over all tiles are picked by ``topk_of``. Scores are
    rounded before ranking; ties go to the lower partner; NaN scores take no
    part.
    """
    import numpy as np
    import pandas as pd

    gtype = dict(entities.dtypes)[group]

    def best(score, own, other):
        """Rows of (own, other, score): the k best columns of each row."""
        order = np.lexsort((np.broadcast_to(other, score.shape), -np.nan_to_num(score, nan=-np.inf)), axis=1)[:, :k]
        i = np.repeat(np.arange(len(own)), order.shape[1])
        j = order.ravel()
        keep = ~np.isnan(score[i, j])
        return own[i[keep]], other[j[keep]], score[i[keep], j[keep]]

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({group: [], "entity": [], "partner": [], "score": []})
        score = np.round(_tile_scores(np.stack(a[vec].to_numpy()).astype(np.float64), np.stack(b[vec].to_numpy()).astype(np.float64), measure), decimals)
        ia, ib = a[ident].to_numpy(np.int64), b[ident].to_numpy(np.int64)
        score[ia[:, None] == ib[None, :]] = np.nan  # no entity is its own partner
        parts = [best(score, ia, ib)]
        if pdf["_ti"].iat[0] != pdf["_tj"].iat[0]:  # a diagonal tile holds each row on both sides
            parts.append(best(score.T, ib, ia))
        e, p, s = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({group: pdf[group].iat[0], "entity": e, "partner": p, "score": s})

    tiles = tile_sides(entities, group, ident, [vec], tile_rows)
    return tiles.groupBy(group, "_ti", "_tj").applyInPandas(tile, f"{group} {gtype}, entity long, partner long, score double")


def vector_pair_scores(entities: DataFrame, group: str = "group_id", ident: str = "entity_id",
                       vec: str = "encoding", measure: str = "cosine", tile_rows: int = 1024, decimals: int | None = None,
                       above: float | None = None, below: float | None = None) -> DataFrame:
    """O32 + O53 fused: every pair of a group with its vector similarity, one matrix product per tile.

    ``decimals`` rounds the scores; ``above`` and ``below`` (exclusive, after
    rounding) keep only such pairs, inside the tile.

    Tiles are formed exactly as in ``all_pairs`` (a tile holds at most
    2 x tile_rows entities), so the pandas batch of a task is bounded whatever
    the group size. Scores are computed in float64: dot, cosine (NULL on a
    zero norm) or L1.
    """
    import numpy as np
    import pandas as pd

    gtype = dict(entities.dtypes)[group]
    schema = f"{group} {gtype}, id1 long, id2 long, score double"

    def score_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        a_rows, b_rows = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        if len(a_rows) == 0 or len(b_rows) == 0:
            return pd.DataFrame({group: [], "id1": [], "id2": [], "score": []})
        A = np.stack(a_rows[vec].to_numpy()).astype(np.float64)
        B = np.stack(b_rows[vec].to_numpy()).astype(np.float64)
        ia, ib = a_rows[ident].to_numpy(np.int64), b_rows[ident].to_numpy(np.int64)
        S = _tile_scores(A, B, measure)
        if decimals is not None:
            S = np.round(S, decimals)
        diagonal = pdf["_ti"].iat[0] == pdf["_tj"].iat[0]
        mask = (ia[:, None] < ib[None, :]) if diagonal else np.ones(S.shape, dtype=bool)
        if above is not None:
            mask &= above < S
        if below is not None:
            mask &= below > S
        i, j = np.nonzero(mask)
        x, y = ia[i], ib[j]
        return pd.DataFrame({group: pdf[group].iat[0], "id1": np.minimum(x, y), "id2": np.maximum(x, y),
                             "score": S[i, j]})

    tiles = tile_sides(entities, group, ident, [vec], tile_rows)
    return tiles.groupBy(group, "_ti", "_tj").applyInPandas(score_tile, schema)


def vector_pair_table(entities: DataFrame, measures: dict, group: str = "group_id", ident: str = "entity_id", vec: str = "encoding",
                      tile_rows: int = 1024, decimals: int | None = None) -> DataFrame:
    """Every pair of a group with several measures (name -> as in ``_tile_scores``), all computed inside its tile.

    No vector travels with a pair: a tile of at most 2 x tile_rows vectors is all that a task holds.
    """
    import numpy as np
    import pandas as pd

    gtype = dict(entities.dtypes)[group]
    schema = f"{group} {gtype}, id1 long, id2 long, " + ", ".join(f"{n} double" for n in measures)

    def score_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        a_rows, b_rows = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        if len(a_rows) == 0 or len(b_rows) == 0:
            return pd.DataFrame({group: [], "id1": [], "id2": [], **{n: [] for n in measures}})
        a, b = (np.stack(r[vec].to_numpy()).astype(np.float64) for r in (a_rows, b_rows))
        ia, ib = a_rows[ident].to_numpy(np.int64), b_rows[ident].to_numpy(np.int64)
        diagonal = pdf["_ti"].iat[0] == pdf["_tj"].iat[0]
        i, j = np.nonzero(ia[:, None] < ib[None, :] if diagonal else np.ones((len(ia), len(ib)), dtype=bool))
        x, y = ia[i], ib[j]
        scores = {n: _tile_scores(a, b, m)[i, j] for n, m in measures.items()}
        if decimals is not None:
            scores = {n: np.round(s, decimals) for n, s in scores.items()}
        return pd.DataFrame({group: pdf[group].iat[0], "id1": np.minimum(x, y), "id2": np.maximum(x, y), **scores})

    tiles = tile_sides(entities, group, ident, [vec], tile_rows)
    return tiles.groupBy(group, "_ti", "_tj").applyInPandas(score_tile, schema)


def pairs_filtered(pairs: DataFrame, predicate) -> DataFrame:
    """A caller predicate on the pair table, given as a Column or a SQL expression string.

    Apply it to the pairs before attaching features; Catalyst pushes what it can into the scan.
    """
    return pairs.filter(F.expr(predicate) if isinstance(predicate, str) else predicate)
