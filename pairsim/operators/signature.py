"""Fingerprints, MinHash signatures and LSH (O33-O35, O39, O40, O42, O45, O46, O106, O110).

Parameters follow the run flags: MinHash rows per band and bands, bucket
cap, rank distance. Base hashes are md5-derived so any engine can reproduce
them; the k hash functions are (a*x + b) mod (2^31 - 1) with coefficients
derived by a rule from md5 as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsim.functions.sequences import minhash_similarity, shingles, tokens
from pairsim.operators.lookup import MOST_PAIRS, TILE_PAIRS, score_pairs
from pairsim.operators.pairs import all_pairs, tile_sides
from pairsim.session import cut_lineage

PRIME = 2147483647  # 2^31 - 1
DEFAULT_ROWS, DEFAULT_BANDS = 2, 100
DEFAULT_BUCKET_CAP = 100
DEFAULT_RANK_DISTANCE = 1.0


def base_hash(s: Column) -> Column:
    """32-bit base hash of a string: the first 8 hex digits of its md5."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    """a_i = 1 + int(md5('a<i>')[:7], 16), b_i = int(md5('b<i>')[:7], 16) for i = 0..k-1."""
    a = [1 + int(hashlib.md5(f"a{i}".encode()).hexdigest()[:7], 16) for i in range(k)]
    b = [int(hashlib.md5(f"b{i}".encode()).hexdigest()[:7], 16) for i in range(k)]
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def token_histogram(entities: DataFrame, text: str = "text", ident: str = "entity_id",
                    group: str | None = None) -> DataFrame:
    """(group, entity, token, n) — the frequency fingerprint in tall form."""
    keys = [c for c in (group, ident) if c]
    ex = entities.select(*keys, F.explode(tokens(text)).alias("token"))
    return ex.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def fingerprint_size(hist: DataFrame, ident: str = "entity_id", group: str | None = None) -> DataFrame:
    """size = sum of the frequencies."""
    keys = [c for c in (group, ident) if c]
    return hist.groupBy(*keys).agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("distinct_tokens"))


def shared_items(members: DataFrame, keys: list[str], ident: str = "entity_id", item: str = "item") -> DataFrame:
    """(keys, ident, _items): the numbers, ascending, of those distinct items of an entity that others of the same ``keys`` have too.

    Items that one entity alone has are in no intersection, so they go no further than their count; the others travel as a
    number each. NULL items equal none. Entities that share nothing have no row.
    """
    m = members.select(*keys, ident, item).distinct()
    # A frequent item is one partial row per task; stored, as a number must be the same wherever it is read.
    numbers = m.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_holders")).where("_holders > 1").select(*keys, item, F.monotonically_increasing_id().alias("_no"))
    return m.join(cut_lineage(numbers), [*keys, item]).groupBy(*keys, ident).agg(F.sort_array(F.collect_list("_no")).alias("_items"))


def with_items(entities: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """``entities`` with their ``_items`` of ``shared_items``, an empty array where they share nothing."""
    return entities.join(items, keys, "left").withColumn("_items", F.coalesce("_items", F.array().cast("array<bigint>")))


def common_items(pairs: DataFrame, out: str) -> DataFrame:
    """Pairs that carry both members' ``_items``, with the number of common ones as ``out`` instead."""
    return pairs.withColumn(out, F.size(F.array_intersect("_items1", "_items2")).cast("long")).drop("_items1", "_items2")


def freq_distance(hist: DataFrame, group: str, ident: str = "entity_id", tile_rows: int = 2048) -> DataFrame:
    """Manhattan distance of the histograms of every pair of entities in a group.

    sum |f1 - f2| = n1 + n2 - 2 * sum min(f1, f2). With the k-th occurrence of a token as an item the shared part is the
    size of an intersection, which is taken inside the tile of a pair: an entity's items travel once per tile
    of its block, and neither pairs nor what they share are shuffled.
    """
    items = hist.select(group, ident, "token", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("_k"))
    items = shared_items(items.where("token is not null").select(group, ident, F.struct("token", "_k").alias("_item")), [group], ident, "_item")
    sizes = fingerprint_size(hist, ident, group).select(group, ident, "size")
    pairs = all_pairs(with_items(sizes, items, [group, ident]), group=group, ident=ident, payload=["size", "_items"], tile_rows=tile_rows)
    j = common_items(pairs, "_shared")
    return j.select(group, "id1", "id2", "size1", "size2", (F.col("size1") + F.col("size2") - 2 * F.col("_shared")).alias("freq_distance"))


def size_estimate(hist: DataFrame, costs: DataFrame, ident: str = "entity_id", group: str | None = None) -> DataFrame:
    """O106: sum over tokens of n * cost(token class); ``costs`` is a small (class, cost) table."""
    keys = [c for c in (group, ident) if c]
    cls = F.when(F.length("token") <= 3, F.lit("short")).when(F.length("token") <= 7, F.lit("medium")) \
           .otherwise(F.lit("long"))
    # No hint: the table is the caller's, and AQE broadcasts it by its measured size.
    j = hist.withColumn("token_class", cls).join(costs, "token_class")
    return j.groupBy(*keys).agg(F.sum(F.col("n") * F.col("cost")).alias("estimated_size"))


#: Base hashes that are worked on at once: they and their multiples stay in the cache.
SLAB = 4096
#: Rows of an Arrow batch that are signed at once.
BATCH_ROWS = 512


def minhash_rows(hashes: pa.Array, k: int) -> pa.Array:
    """Signatures of a column of base-hash lists (each hash below 2^32); NULL for a null or empty list.

    All lists are one flat run, cut into slabs whatever their lengths, so the working set is a slab and the ``k`` minima of each row.
    """
    sizes = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    own = sizes > 0
    ends = np.cumsum(sizes[own])
    starts = ends - sizes[own]
    flat = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.uint64, copy=False)
    a, b = (c.astype(np.uint64) for c in coefficients(k))
    prime, fold = np.uint64(PRIME), np.uint64(31)
    out = np.full((k, len(ends)), PRIME, np.uint64)
    for s in range(0, len(flat), SLAB):
        x = flat[s:s + SLAB]
        first, last = np.searchsorted(ends, s, "right"), np.searchsorted(starts, s + len(x), "left")
        at = np.maximum(starts[first:last] - s, 0)
        v, w = np.empty_like(x), np.empty_like(x)
        for i in range(k):
            np.multiply(x, a[i], out=v)
            np.add(v, b[i], out=v)
            # The prime is 2^31 - 1, so upper bits are added to the lower 31; what is left is under twice the prime (less wraps around).
            np.right_shift(v, fold, out=w)
            np.bitwise_and(v, prime, out=v)
            np.add(v, w, out=v)
            np.subtract(v, prime, out=w)
            np.minimum(v, w, out=v)
            np.minimum(out[i, first:last], np.minimum.reduceat(v, at), out=out[i, first:last])
    values = pa.array(np.ascontiguousarray(out.T).astype(np.int64).ravel())
    offsets = np.concatenate([[0], np.cumsum(own * k)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~own))


def _minhash_udf(k: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def minhash(hashes: pa.Array) -> pa.Array:
        # Some rows at a time, so that a batch of any number of rows costs its signatures and little else.
        return pa.concat_arrays([minhash_rows(hashes.slice(at, BATCH_ROWS), k) for at in range(0, max(1, len(hashes)), BATCH_ROWS)])

    return minhash


def minhash_signature(df: DataFrame, shingle_col: str, k: int = DEFAULT_ROWS * DEFAULT_BANDS,
                      out: str = "signature") -> DataFrame:
    """K-permutation MinHash of the shingle set (NULL for an empty set).

    Base hashes are computed in the JVM; the k x n min is vectorised NumPy over
    Arrow batches.
    """
    h = F.transform(F.array_distinct(F.col(shingle_col)), lambda s: base_hash(s))
    return df.withColumn(out, _minhash_udf(k)(h))


def minhash_text(df: DataFrame, text: str, k: int = DEFAULT_ROWS * DEFAULT_BANDS, cross_blocks: bool = True,
                 out: str = "signature") -> DataFrame:
    """O41 + O42 for whole texts: shingles and md5 base hashes in the JVM, the k-permutation minimum in NumPy."""
    return minhash_signature(df.withColumn("_shingles", shingles(text, cross_blocks)), "_shingles", k, out).drop("_shingles")


def band_keys(sig: Column, bands: int = DEFAULT_BANDS, rows: int = DEFAULT_ROWS) -> Column:
    """The signature cut into ``bands`` slices of ``rows`` values, each hashed."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                       lambda i: F.md5(F.array_join(F.slice(sig, i * rows + 1, rows), ",")))


def packed_keys(sig: Column, bands: int = DEFAULT_BANDS) -> Column:
    """The slices of ``band_keys`` of two values (below 2^31) each, as one long: equal where they are equal."""
    value = lambda i: F.coalesce(F.get(sig, i).cast("long"), F.lit(PRIME).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.shiftleft(value(i * 2), 31).bitwiseOR(value(i * 2 + 1)))


def band_table(df: DataFrame, group: str, ident: str, sig: str = "signature", bands: int = DEFAULT_BANDS,
               rows: int = DEFAULT_ROWS, packed: bool = False) -> DataFrame:
    """(group, entity, band, key) — one row per band of every signed entity.

    ``packed``: where keys are only compared, bands of two rows have a number as key, which costs less to make and to shuffle.
    """
    s = df.filter(F.col(sig).isNotNull())
    keys = packed_keys(F.col(sig), bands) if packed and rows == 2 else band_keys(F.col(sig), bands, rows)
    return s.select(group, ident, F.posexplode(keys).alias("band", "key"))


def lsh_candidates(bands_df: DataFrame, group: str, ident: str = "entity_id", tile_rows: int = 2048) -> DataFrame:
    """Pairs of the same group sharing at least one (band, key) bucket, with the number of shared bands.

    The bucket self-join is tiled (a bucket holding many entities is split
    over tasks) and the per-band pair rows are combined map-side by the
    grouped count.
    """
    p = all_pairs(bands_df.select(group, "band", "key", ident), group=[group, "band", "key"], ident=ident,
                  tile_rows=tile_rows)
    return p.groupBy(group, "id1", "id2").agg(F.count(F.lit(1)).alias("shared_bands"))


def signature_classes(signed: DataFrame, group: str, ident: str = "entity_id", sig: str = "signature") -> DataFrame:
    """(group, ident, class_id) of signed entities: those of equal signatures share the lowest id among them.

    Equal signatures share every band, so all bands see one representative; what they are to each other is in this table.
    """
    s = signed.where(F.col(sig).isNotNull()).select(group, ident, F.md5(F.array_join(sig, ",")).alias("_m"), F.xxhash64(sig).alias("_x"))
    return s.join(s.groupBy(group, "_m", "_x").agg(F.min(ident).alias("class_id")), [group, "_m", "_x"]).select(group, ident, "class_id")


def lsh_class_candidates(signed: DataFrame, group: str, ident: str = "entity_id", sig: str = "signature", bands: int = DEFAULT_BANDS,
                         rows: int = DEFAULT_ROWS, tile_rows: int = 2048) -> tuple[DataFrame, DataFrame]:
    """O33 for copies: (candidate pairs of class representatives, classes). k equal signatures are k rows of ``classes`` and one
    in each band; a pair of entities is a candidate if their classes are one or a pair.
    """
    classes = signature_classes(signed, group, ident, sig)
    heads = signed.join(classes.where(F.col(ident) == F.col("class_id")).select(group, ident), [group, ident], "left_semi")
    return lsh_candidates(band_table(heads, group, ident, sig, bands, rows, packed=True), group, ident, tile_rows), classes


def bucket_cap(bands_df: DataFrame, group: str, cap: int = DEFAULT_BUCKET_CAP) -> DataFrame:
    """Every bucket member with its bucket's size and whether that exceeds ``cap``.

    The collection flag leaves the surplus members out; here the flag only
    marks such buckets, and candidates come from whole buckets (tiled).
    """
    keys = [group, "band", "key"]
    sizes = bands_df.groupBy(*keys).agg(F.count(F.lit(1)).alias("bucket_size"))
    return bands_df.join(sizes, keys).withColumn("over_cap", F.col("bucket_size") > cap)


def bucket_report(bands_df: DataFrame, group: str) -> DataFrame:
    """O110: distribution of bucket sizes: (bucket_size, buckets)."""
    sizes = bands_df.groupBy(group, "band", "key").agg(F.count(F.lit(1)).alias("bucket_size"))
    return sizes.groupBy("bucket_size").agg(F.count(F.lit(1)).alias("buckets"))


# Fixed values (our policy; the reference names the switches, not the formulas):
# group-size range [lo, hi) -> (bands, rows, threshold).
ADAPTIVE_POLICY = [
    (0, 64, 100, 2, 0.0),
    (64, 1024, 50, 4, 0.2),
    (1024, 1 << 62, 25, 8, 0.4),
]


def adaptive_parameters(sizes: DataFrame, group: str, size_col: str = "size") -> DataFrame:
    """The LSH parameters that the policy names for a group of that size: a report, candidates don't depend on it."""
    spark = sizes.sparkSession
    pol = spark.createDataFrame(ADAPTIVE_POLICY, "lo long, hi long, bands int, rows int, threshold double")
    # Bounded: three policy rows.
    j = sizes.join(F.broadcast(pol), (F.col(size_col) >= F.col("lo")) & (F.col(size_col) < F.col("hi")))
    return j.select(group, size_col, "bands", "rows", "threshold")


#: Rows per band that ``tuned_parameters`` considers, sampled members of a group, and bins of their similarities.
TUNED_ROWS, TUNED_SAMPLE, TUNED_BINS = 8, 64, 20


def similarity_histogram(signed: DataFrame, group: str, ident: str = "entity_id", sig: str = "signature", k: int = DEFAULT_ROWS * DEFAULT_BANDS,
                         sample: int = TUNED_SAMPLE, bins: int = TUNED_BINS) -> DataFrame:
    """(group, n, bin, pairs): sizes of all groups, and the MinHash similarities of the pairs of about ``sample`` members of each.

    Members are sampled by a hash of their id; a group without a sampled pair has one row with a null bin.
    """
    s = signed.where(F.col(sig).isNotNull())
    sizes = s.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    drawn = s.join(sizes, group).where(base_hash(F.col(ident).cast("string")) < F.lit(float(1 << 32)) * sample / F.col("n"))
    pairs = all_pairs(drawn.select(group, ident, sig), group=group, ident=ident, payload=[sig])
    same = minhash_similarity(f"{sig}1", f"{sig}2")
    counts = pairs.select(group, F.least(F.floor(same * bins), F.lit(bins - 1)).cast("int").alias("bin")).groupBy(group, "bin").agg(F.count(F.lit(1)).alias("pairs"))
    return sizes.join(counts, group, "left")


def tuned_parameters(histogram: DataFrame, threshold: float, group: str, recall: float = 0.95, k: int = DEFAULT_ROWS * DEFAULT_BANDS,
                     bins: int = TUNED_BINS) -> DataFrame:
    """(group, n, bands, rows, cost): the cheapest cut of each group's signatures that finds pairs at ``threshold`` with ``recall``.

    For r rows the S-curve 1 - (1 - s^r)^b says how many bands find a pair of similarity ``threshold`` (and any more similar one) with that
    probability; cuts that need more than ``k`` values are out. The cost is the band rows of the group, n b, and the candidates
    that its sampled similarities foretell. No group loses members or pairs by its size.
    """
    import math

    cuts = []
    for r in range(1, TUNED_ROWS + 1):
        b = math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)) if threshold < 1 else 1
        if b * r <= k:
            cuts.append((r, b))
    if not cuts:
        raise ValueError(f"{k} values can't find similarity {threshold} with recall {recall}")
    each = histogram.withColumn("_cut", F.explode(F.array(*[F.struct(F.lit(r).alias("rows"), F.lit(b).alias("bands")) for r, b in cuts])))
    mid = (F.col("bin") + 0.5) / bins
    found = 1 - F.pow(1 - F.pow(mid, F.col("_cut.rows")), F.col("_cut.bands"))
    per = each.groupBy(group, "n", "_cut").agg(F.sum(found * F.col("pairs")).alias("_found"), F.sum("pairs").alias("_all"))
    share = F.coalesce(F.try_divide(F.col("_found"), F.col("_all")), F.lit(0.0))
    cost = F.round(F.col("n") * F.col("_cut.bands") + F.col("n") * (F.col("n") - 1) / 2 * share, 3)
    per = per.withColumn("cost", cost)
    return per.groupBy(group, "n").agg(F.min_by("_cut", F.struct("cost", "_cut.rows")).alias("_c"), F.min("cost").alias("cost")).select(group, "n", "_c.bands", "_c.rows", "cost")


def tuned_bands(signed: DataFrame, parameters: DataFrame, group: str, ident: str = "entity_id", sig: str = "signature") -> DataFrame:
    """(group, ident, band, key): every signature cut as its group's parameters say."""
    s = signed.where(F.col(sig).isNotNull()).join(parameters.select(group, "bands", "rows"), group)
    keys = F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda i: F.md5(F.array_join(F.slice(sig, i * F.col("rows") + 1, F.col("rows")), ",")))
    return s.select(group, ident, F.posexplode(keys).alias("band", "key"))


def set_jaccard(entities: DataFrame, members: DataFrame, group: str, ident: str = "entity_id", item: str = "item",
                tile_rows: int = 2048) -> DataFrame:
    """O44 over every pair of a group: |A n B| / (|A| + |B| - |A n B|).

    The intersections are taken inside the tiles of all pairs, on numbered items: a set travels once per tile of its block,
    and neither pairs nor shared items are shuffled. The set sizes come from a grouped count; pairs whose sets share
    nothing get 0, and two empty sets NULL. ``entities`` lists every entity (also those without members).
    """
    m = members.select(group, ident, item).distinct()
    sizes = m.groupBy(group, ident).agg(F.count(F.lit(1)).alias("_size"))
    ents = entities.select(group, ident).join(sizes, [group, ident], "left") \
                   .withColumn("_size", F.coalesce("_size", F.lit(0)))
    ents = with_items(ents, shared_items(m, [group], ident, item), [group, ident])
    j = common_items(all_pairs(ents, group=group, ident=ident, payload=["_size", "_items"], tile_rows=tile_rows), "_inter")
    union = F.col("_size1") + F.col("_size2") - F.col("_inter")
    return j.select(group, "id1", "id2", F.col("_inter").alias("intersection"), union.alias("union"),
                    F.try_divide(F.col("_inter").cast("double"), union.cast("double")).alias("jaccard"))


def listed_minhash_distance(pairs: DataFrame, signed: DataFrame, ident: str = "entity_id", sig: str = "signature", out: str = "minhash_distance",
                            tile_pairs: int = TILE_PAIRS) -> DataFrame:
    """O43 for listed pairs (id1, id2, ...): 1 - share of equal positions of signatures of one length (values below 2^31); NULL without one.

    A signature travels once per tile in which its entity has a pair, not with each pair.
    """
    def equal(rows: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, dict]:
        known = rows["_sig"].notna().to_numpy()
        n = len(rows["_sig"][known].iat[0]) if known.any() else 0
        sigs = np.zeros((len(rows), n), np.int32)
        if known.any():
            sigs[known] = np.stack(rows["_sig"][known].to_numpy())
        same = np.zeros(len(i), np.int32)
        for s in range(0, len(i), 4096):
            same[s:s + 4096] = (sigs[i[s:s + 4096]] == sigs[j[s:s + 4096]]).sum(axis=1)
        same = pd.arrays.IntegerArray(same, ~(known[i] & known[j]))
        return np.arange(len(i)), {"_equal": same, "_size": np.full(len(i), n, np.int32)}

    p = score_pairs(pairs, signed.select(ident, F.col(sig).cast("array<int>").alias("_sig")), equal, "_equal int, _size int", ident, tile_pairs, MOST_PAIRS)
    return p.withColumn(out, F.lit(1.0) - F.try_divide(F.col("_equal"), F.col("_size"))).drop("_equal", "_size")


def minhash_pair_distance(signed: DataFrame, group: str, ident: str = "entity_id", sig: str = "signature",
                          k: int = DEFAULT_ROWS * DEFAULT_BANDS, tile_rows: int = 1024) -> DataFrame:
    """O43 over every pair of signed entities of a group: 1 - (equal positions) / k; signatures have one length.

    Equal positions are counted inside tiles of at most 2 x tile_rows signatures, so neither pairs nor the positions that
    they share are shuffled. An entity listed m times stands in m times as many pairs, each with the equal positions of all its copies.
    """
    gtype = dict(signed.dtypes)[group]
    copies = signed.filter(F.col(sig).isNotNull()).groupBy(group, ident).agg(F.collect_list(sig).alias("_sigs"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({group: [], "id1": [], "id2": [], "minhash_distance": []})
        na, nb = (side["_sigs"].map(len).to_numpy() for side in (a, b))
        sa, sb = (np.ascontiguousarray(np.stack([x for sigs in side["_sigs"] for x in sigs]).T) for side in (a, b))
        equal = np.zeros((sa.shape[1], sb.shape[1]), np.int32)
        for s in range(0, len(equal), 64):  # a slab that stays in the cache
            for x, y in zip(sa, sb):
                equal[s:s + 64] += x[s:s + 64, None] == y
        times = np.outer(na, nb)
        if times.max() > 1:
            equal = np.add.reduceat(np.add.reduceat(equal, np.cumsum(na) - na, axis=0), np.cumsum(nb) - nb, axis=1)
        ia, ib = a[ident].to_numpy(np.int64), b[ident].to_numpy(np.int64)
        diagonal = pdf["_ti"].iat[0] == pdf["_tj"].iat[0]
        i, j = np.nonzero(ia[:, None] < ib[None, :] if diagonal else np.ones(equal.shape, dtype=bool))
        if times.max() > 1:
            i, j = np.repeat(i, times[i, j]), np.repeat(j, times[i, j])
        x, y = ia[i], ib[j]
        return pd.DataFrame({group: pdf[group].iat[0], "id1": np.minimum(x, y), "id2": np.maximum(x, y), "minhash_distance": 1.0 - equal[i, j] / float(k)})

    tiles = tile_sides(copies.where(F.col(ident).isNotNull()), group, ident, ["_sigs"], tile_rows)
    return tiles.groupBy(group, "_ti", "_tj").applyInPandas(tile, f"{group} {gtype}, id1 long, id2 long, minhash_distance double")
