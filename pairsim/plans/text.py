"""Text-world queries: documents as entities, source as group (O33-O35, O39-O47, O106, O110)."""

from pyspark.sql import functions as F

from pairsim.functions import sequences as S
from pairsim.operators import signature as G
from pairsim.operators.pairs import all_pairs
from pairsim.plans.registry import query
from pairsim.session import cut_lineage
from pairsim.sources.tables import text_entities

R = 6
K = G.DEFAULT_ROWS * G.DEFAULT_BANDS

# DuckDB twins of the token / shingle / signature expressions.
TOK = "list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> '')"
PAIRS_OF = ("CASE WHEN len({l}) >= 2 THEN list_transform(range(1, len({l})), lambda i: {l}[i] || ' ' || {l}[i + 1]) "
            "ELSE []::VARCHAR[] END")
DOCS_SQL = f"""
docs AS (SELECT source AS group_name, doc_id, text, {TOK.format(t='text')} AS toks FROM documents),
shg AS (SELECT group_name, doc_id, {PAIRS_OF.format(l='toks')} AS sh FROM docs)"""
SIGNATURE_PART = f"""
hx AS (SELECT group_name, doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT AS h
       FROM (SELECT group_name, doc_id, unnest(list_distinct(sh)) AS s FROM shg)),
co AS (SELECT i, 1 + ('0x' || substr(md5('a' || i), 1, 7))::BIGINT AS a, ('0x' || substr(md5('b' || i), 1, 7))::BIGINT AS b
       FROM range({K}) t(i)),
mv AS (SELECT group_name, doc_id, i, min((a * h + b) % 2147483647) AS v FROM hx, co GROUP BY ALL),
sig AS (SELECT group_name, doc_id, list(v ORDER BY i) AS sig FROM mv GROUP BY ALL)"""
BANDS_PART = f"""
bands AS (SELECT group_name, doc_id, b AS band,
                 md5(array_to_string(sig[b * {G.DEFAULT_ROWS} + 1 : b * {G.DEFAULT_ROWS} + {G.DEFAULT_ROWS}], ',')) AS key
          FROM sig, range({G.DEFAULT_BANDS}) t(b))"""
CAND_PART = """
cand AS (SELECT a.group_name, a.doc_id AS id1, b.doc_id AS id2, count(*)::BIGINT AS shared_bands
         FROM bands a JOIN bands b ON a.group_name = b.group_name AND a.band = b.band AND a.key = b.key
                                  AND a.doc_id < b.doc_id
         GROUP BY ALL)"""
SIG_SQL = DOCS_SQL + "," + SIGNATURE_PART + "," + BANDS_PART + "," + CAND_PART


def docs(spark, d):
    return text_entities(spark, d)


def signed_docs(spark, d, group_expr=None):
    e = docs(spark, d)
    if group_expr is not None:
        e = e.withColumn("group_name", group_expr)
    # Signatures are reused by every band and both join sides: materialise them once.
    return cut_lineage(G.minhash_text(e.select("group_name", "entity_id", "text"), "text", K).drop("text"))


def doc_bands(spark, d, group_expr=None, packed=False):
    return G.band_table(signed_docs(spark, d, group_expr), "group_name", "entity_id", packed=packed)


@query("fingerprint", oracle="WITH " + DOCS_SQL.lstrip() + """
SELECT doc_id AS entity_id, token, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(toks) AS token FROM docs) GROUP BY ALL""")
def q_fingerprint(spark, d):
    return G.token_histogram(docs(spark, d))


@query("freq_distance", oracle="WITH " + DOCS_SQL.lstrip() + """,
h AS (SELECT group_name, doc_id, token, count(*) AS n FROM (SELECT group_name, doc_id, unnest(toks) AS token FROM docs)
      GROUP BY ALL),
sz AS (SELECT group_name, doc_id, sum(n) AS size FROM h GROUP BY ALL),
p AS (SELECT a.group_name, a.doc_id AS id1, b.doc_id AS id2, a.size AS size1, b.size AS size2
      FROM sz a JOIN sz b ON a.group_name = b.group_name AND a.doc_id < b.doc_id),
sh AS (SELECT a.group_name, a.doc_id AS id1, b.doc_id AS id2, sum(least(a.n, b.n)) AS shared
       FROM h a JOIN h b ON a.group_name = b.group_name AND a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT p.group_name, p.id1, p.id2, size1::BIGINT AS size1, size2::BIGINT AS size2,
       (size1 + size2 - 2 * coalesce(shared, 0))::BIGINT AS freq_distance
FROM p LEFT JOIN sh USING (group_name, id1, id2)""")
def q_freq_distance(spark, d):
    # The histogram feeds two tiled joins (token co-occurrence and pair sizes): materialise it once.
    hist = cut_lineage(G.token_histogram(docs(spark, d), group="group_name"))
    return G.freq_distance(hist, "group_name")


@query("shingles", oracle="WITH " + DOCS_SQL.lstrip() + f""",
bl AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda ln: {TOK.format(t='ln')}) AS lt FROM docs),
blk AS (SELECT doc_id, flatten(list_transform(lt, lambda t: {PAIRS_OF.format(l='t')})) AS bs FROM bl)
SELECT doc_id AS entity_id, len(sh)::BIGINT AS n_cross, len(list_distinct(sh))::BIGINT AS n_cross_distinct,
       len(bs)::BIGINT AS n_block, len(list_distinct(bs))::BIGINT AS n_block_distinct
FROM shg JOIN blk USING (doc_id)""")
def q_shingles(spark, d):
    e = docs(spark, d).select("entity_id", S.shingles("text").alias("sh"), S.shingles("text", False).alias("bs"))
    return e.select("entity_id", F.size("sh").cast("long").alias("n_cross"),
                    F.size(F.array_distinct("sh")).cast("long").alias("n_cross_distinct"),
                    F.size("bs").cast("long").alias("n_block"),
                    F.size(F.array_distinct("bs")).cast("long").alias("n_block_distinct"))


@query("minhash_signature", oracle="WITH " + SIG_SQL.lstrip() + """
SELECT doc_id AS entity_id, array_to_string(sig, ',') AS signature FROM sig""")
def q_minhash_signature(spark, d):
    s = signed_docs(spark, d).filter(F.col("signature").isNotNull())
    return s.select("entity_id", F.array_join("signature", ",").alias("signature"))


@query("lsh_bands", oracle="WITH " + SIG_SQL.lstrip() + """
SELECT doc_id AS entity_id, band::INTEGER AS band, key FROM bands""")
def q_lsh_bands(spark, d):
    return doc_bands(spark, d).select("entity_id", "band", "key")


@query("lsh_candidates", oracle="WITH " + SIG_SQL.lstrip() + " SELECT group_name, id1, id2, shared_bands FROM cand")
def q_lsh_candidates(spark, d):
    return G.lsh_candidates(doc_bands(spark, d, packed=True), "group_name")


@query("lsh_candidates_global", oracle="WITH " + SIG_SQL.lstrip().replace(
    "docs AS (SELECT source AS group_name", "docs AS (SELECT 'all' AS group_name", 1) +
       " SELECT group_name, id1, id2, shared_bands FROM cand")
def q_lsh_candidates_global(spark, d):
    # One constant group: candidates across sources (e.g. copies placed in different sources).
    return G.lsh_candidates(doc_bands(spark, d, F.lit("all"), packed=True), "group_name")


@query("lsh_rank_distance", oracle="WITH " + SIG_SQL.lstrip() + f""",
cs AS (SELECT c.*, 1.0 - len(list_filter(list_zip(s1.sig, s2.sig), lambda z: z[1] = z[2])) / {K}.0 AS dist
       FROM cand c JOIN sig s1 ON s1.doc_id = c.id1 JOIN sig s2 ON s2.doc_id = c.id2)
SELECT group_name, id1, id2, round(dist, 6) AS minhash_distance FROM cs WHERE dist <= 0.5""")
def q_lsh_rank_distance(spark, d):
    s = signed_docs(spark, d)
    cand = G.lsh_candidates(G.band_table(s, "group_name", "entity_id", packed=True), "group_name")
    j = G.listed_minhash_distance(cand.select("group_name", "id1", "id2"), s, out="d")
    return j.filter(
        F.col("d") <= 0.5).select("group_name", "id1", "id2", F.round("d", R).alias("minhash_distance"))


@query("lsh_bucket_cap", oracle="WITH " + SIG_SQL.lstrip().replace(
    "docs AS (SELECT source AS group_name", "docs AS (SELECT 'all' AS group_name", 1) + """,
sized AS (SELECT *, count(*) OVER (PARTITION BY group_name, band, key) AS bucket_size FROM bands)
SELECT doc_id AS entity_id, band::INTEGER AS band, key, bucket_size, bucket_size > 3 AS over_cap FROM sized""")
def q_lsh_bucket_cap(spark, d):
    b = doc_bands(spark, d, F.lit("all"))
    return G.bucket_cap(b, "group_name", cap=3).select("entity_id", "band", "key", "bucket_size", "over_cap")


@query("lsh_bucket_report", oracle="WITH " + SIG_SQL.lstrip() + """,
bs AS (SELECT group_name, band, key, count(*) AS bucket_size FROM bands GROUP BY ALL)
SELECT bucket_size::BIGINT AS bucket_size, count(*)::BIGINT AS buckets FROM bs GROUP BY bucket_size""")
def q_lsh_bucket_report(spark, d):
    return G.bucket_report(doc_bands(spark, d, packed=True), "group_name")


@query("minhash_distance", oracle="WITH " + SIG_SQL.lstrip() + f""",
pp AS (SELECT a.group_name, a.doc_id AS id1, b.doc_id AS id2, a.sig AS s1, b.sig AS s2
       FROM sig a JOIN sig b ON a.group_name = b.group_name AND a.doc_id < b.doc_id)
SELECT group_name, id1, id2,
       round(1.0 - len(list_filter(list_zip(s1, s2), lambda z: z[1] = z[2])) / {K}.0, 6) AS minhash_distance FROM pp""")
def q_minhash_distance(spark, d):
    # Values lie below 2^31 - 1.
    s = signed_docs(spark, d).withColumn("signature", F.col("signature").cast("array<int>"))
    m = G.minhash_pair_distance(s, "group_name", k=K)
    return m.select("group_name", "id1", "id2", F.round("minhash_distance", R).alias("minhash_distance"))


@query("jaccard_exact", oracle="WITH " + DOCS_SQL.lstrip() + """,
pp AS (SELECT a.group_name, a.doc_id AS id1, b.doc_id AS id2, list_distinct(a.sh) AS x, list_distinct(b.sh) AS y
       FROM shg a JOIN shg b ON a.group_name = b.group_name AND a.doc_id < b.doc_id)
SELECT group_name, id1, id2,
       round(CASE WHEN len(x) + len(y) - len(list_intersect(x, y)) = 0 THEN NULL
                  ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE END, 6)
       AS jaccard FROM pp""")
def q_jaccard_exact(spark, d):
    e = docs(spark, d)
    # Distinct shingles of every document, materialised once (used by the co-occurrence join and the set sizes).
    members = cut_lineage(e.select("group_name", "entity_id", F.explode(F.array_distinct(S.shingles("text")))
                                   .alias("item")))
    j = G.set_jaccard(e, members, "group_name")
    return j.select("group_name", "id1", "id2", F.round("jaccard", R).alias("jaccard"))


@query("align_pa", oracle="WITH " + DOCS_SQL.lstrip() + """,
pp AS (SELECT a.group_name, a.doc_id AS id1, b.doc_id AS id2, a.toks AS x, b.toks AS y
       FROM docs a JOIN docs b ON a.group_name = b.group_name AND a.doc_id < b.doc_id AND len(a.toks) = len(b.toks)),
m AS (SELECT *, len(list_filter(list_zip(x, y), lambda z: z[1] = z[2])) AS m, len(x) AS n FROM pp)
SELECT group_name, id1, id2, m::BIGINT AS matches,
       round(CASE WHEN 2 * n - m = 0 THEN NULL ELSE m / (2 * n - m)::DOUBLE END, 6) AS score FROM m""")
def q_align_pa(spark, d):
    e = docs(spark, d).select("group_name", "entity_id", S.tokens("text").alias("t")).withColumn("n", F.size("t"))
    # Positional alignment only applies to equal lengths: pair inside (group, length). Positions are compared once a pair.
    p = all_pairs(e, group=["group_name", "n"], payload=["t"]).withColumn("m", S.equal_positions("t1", "t2"))
    return p.select("group_name", "id1", "id2", F.col("m").cast("long").alias("matches"), F.round(S.positional_score("m", "n"), R).alias("score"))


@query("size_estimate", oracle="WITH " + DOCS_SQL.lstrip() + """,
t AS (SELECT doc_id, unnest(toks) AS token FROM docs)
SELECT doc_id AS entity_id, sum(CASE WHEN length(token) <= 3 THEN 1 WHEN length(token) <= 7 THEN 2 ELSE 3 END)::BIGINT
       AS estimated_size FROM t GROUP BY doc_id""")
def q_size_estimate(spark, d):
    hist = G.token_histogram(docs(spark, d))
    # Cost per token class.
    costs = spark.createDataFrame([("short", 1), ("medium", 2), ("long", 3)], "token_class string, cost long")
    return G.size_estimate(hist, costs)


@query("lsh_adaptive", oracle="""
WITH s AS (SELECT source AS group_name, count(*)::BIGINT AS size FROM documents GROUP BY source),
pol AS (SELECT * FROM (VALUES (0, 64, 100, 2, 0.0), (64, 1024, 50, 4, 0.2), (1024, 4611686018427387904, 25, 8, 0.4))
        t(lo, hi, bands, rows, threshold))
SELECT group_name, size, bands::INTEGER AS bands, rows::INTEGER AS rows, threshold::DOUBLE AS threshold
FROM s JOIN pol ON size >= lo AND size < hi""")
def q_lsh_adaptive(spark, d):
    sizes = docs(spark, d).groupBy("group_name").agg(F.count(F.lit(1)).alias("size"))
    return G.adaptive_parameters(sizes, "group_name")


# ---- classes and thresholded joins: copies are members of a class, only representatives meet ----

JACCARD, RELATIVE = 0.5, 0.25
CLASS_SQL = """,
sets AS (SELECT group_name, doc_id, list_sort(list_distinct({items})) AS x FROM {source} WHERE len({items}) > 0),
cls AS (SELECT group_name, doc_id, min(doc_id) OVER (PARTITION BY group_name, x) AS class_id, x FROM sets),
rep AS (SELECT * FROM cls WHERE doc_id = class_id),
jp AS (SELECT a.group_name, a.doc_id AS id1, b.doc_id AS id2, len(a.x) AS n1, len(b.x) AS n2, len(list_intersect(a.x, b.x)) AS n
       FROM rep a JOIN rep b ON a.group_name = b.group_name AND a.doc_id < b.doc_id)"""
SET_SQL = CLASS_SQL.format(items="sh", source="shg")
FREQ_SQL = """,
th AS (SELECT group_name, doc_id, token, count(*) AS n FROM (SELECT group_name, doc_id, unnest(toks) AS token FROM docs) GROUP BY ALL),
occ AS (SELECT group_name, doc_id, list(token || chr(10) || k) AS o FROM (SELECT group_name, doc_id, token, unnest(range(n)) AS k FROM th) GROUP BY ALL)""" + CLASS_SQL.format(items="o", source="occ")


def _shingle_members(spark, d):
    return docs(spark, d).select("group_name", "entity_id", F.explode(F.array_distinct(S.shingles("text"))).alias("item"))


@query("jaccard_join", oracle="WITH " + DOCS_SQL.lstrip() + SET_SQL + f"""
SELECT group_name, id1, id2, n::BIGINT AS overlap, round(n / (n1 + n2 - n)::DOUBLE, 6) AS jaccard FROM jp WHERE n / (n1 + n2 - n)::DOUBLE >= {JACCARD}""")
def q_jaccard_join(spark, d):
    from pairsim.operators.setjoin import jaccard_join
    return jaccard_join(_shingle_members(spark, d), JACCARD, "group_name")[0].withColumn("jaccard", F.round("jaccard", R))


@query("jaccard_classes", oracle="WITH " + DOCS_SQL.lstrip() + SET_SQL + " SELECT group_name, doc_id AS entity_id, class_id FROM cls")
def q_jaccard_classes(spark, d):
    from pairsim.operators.setjoin import item_sets, set_classes
    return set_classes(item_sets(_shingle_members(spark, d), "group_name"), "group_name")


@query("freq_join", oracle="WITH " + DOCS_SQL.lstrip() + FREQ_SQL + f"""
SELECT group_name, id1, id2, n1::BIGINT AS size1, n2::BIGINT AS size2, (n1 + n2 - 2 * n)::BIGINT AS freq_distance FROM jp WHERE n1 + n2 - 2 * n <= (n1 + n2) * {RELATIVE}::DOUBLE""")
def q_freq_join(spark, d):
    from pairsim.operators.setjoin import freq_join
    return freq_join(G.token_histogram(docs(spark, d), group="group_name"), RELATIVE, "group_name")[0]


_SIG_CLASSES = """,
sc AS (SELECT group_name, doc_id, sig, min(doc_id) OVER (PARTITION BY group_name, sig) AS class_id FROM sig)"""


@query("lsh_class_candidates", oracle="WITH " + SIG_SQL.lstrip() + _SIG_CLASSES + """
SELECT c.* FROM cand c JOIN sc a ON a.doc_id = c.id1 AND a.class_id = c.id1 JOIN sc b ON b.doc_id = c.id2 AND b.class_id = c.id2""")
def q_lsh_class_candidates(spark, d):
    return G.lsh_class_candidates(signed_docs(spark, d), "group_name")[0]


@query("lsh_class_members", oracle="WITH " + SIG_SQL.lstrip() + _SIG_CLASSES + " SELECT group_name, doc_id AS entity_id, class_id FROM sc")
def q_lsh_class_members(spark, d):
    return G.signature_classes(signed_docs(spark, d), "group_name")


# ---- bands chosen per group from the S-curve and its sampled similarities ----

TUNED_AT, TUNED_RECALL = 0.5, 0.95
_TUNED_SQL = f""",
gn AS (SELECT group_name, count(*)::BIGINT AS n FROM sig GROUP BY ALL),
dr AS (SELECT sig.* FROM sig JOIN gn USING (group_name) WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT < 4294967296.0::DOUBLE * {G.TUNED_SAMPLE} / n),
hi AS (SELECT a.group_name, least(floor(len(list_filter(list_zip(a.sig, b.sig), lambda z: z[1] = z[2])) / {K}.0::DOUBLE * {G.TUNED_BINS}), {G.TUNED_BINS - 1}) AS bin
       FROM dr a JOIN dr b ON a.group_name = b.group_name AND a.doc_id < b.doc_id),
hc AS (SELECT group_name, bin, count(*) AS pairs FROM hi GROUP BY ALL),
cut AS (SELECT r AS rows, ceil(ln(1 - {TUNED_RECALL}::DOUBLE) / ln(1 - pow({TUNED_AT}::DOUBLE, r))) AS bands FROM range(1, {G.TUNED_ROWS + 1}) t(r)),
pc AS (SELECT gn.group_name, n, rows, bands, round(n * bands + n * (n - 1) / 2.0::DOUBLE
         * coalesce(sum((1 - pow(1 - pow((bin + 0.5::DOUBLE) / {G.TUNED_BINS}, rows), bands)) * pairs) / sum(pairs), 0), 3) AS cost
       FROM gn LEFT JOIN hc USING (group_name), cut WHERE bands * rows <= {K} GROUP BY gn.group_name, n, rows, bands),
tuned AS (SELECT group_name, n, bands::INTEGER AS bands, rows::INTEGER AS rows, cost FROM pc QUALIFY row_number() OVER (PARTITION BY group_name ORDER BY cost, rows) = 1)"""


def _tuned(signed):
    return G.tuned_parameters(G.similarity_histogram(signed, "group_name", k=K), TUNED_AT, "group_name", TUNED_RECALL, K)


@query("lsh_tuned", oracle="WITH " + SIG_SQL.lstrip() + _TUNED_SQL + " SELECT * FROM tuned")
def q_lsh_tuned(spark, d):
    return _tuned(signed_docs(spark, d))


@query("lsh_tuned_candidates", oracle="WITH " + SIG_SQL.lstrip() + _TUNED_SQL + """,
tb AS (SELECT group_name, doc_id, b AS band, md5(array_to_string(sig[b * rows + 1 : b * rows + rows], ',')) AS key
       FROM (SELECT sig.*, rows, unnest(range(bands)) AS b FROM sig JOIN tuned USING (group_name)))
SELECT a.group_name, a.doc_id AS id1, b.doc_id AS id2, count(*)::BIGINT AS shared_bands
FROM tb a JOIN tb b ON a.group_name = b.group_name AND a.band = b.band AND a.key = b.key AND a.doc_id < b.doc_id GROUP BY ALL""")
def q_lsh_tuned_candidates(spark, d):
    s = signed_docs(spark, d)
    return G.lsh_candidates(G.tuned_bands(s, _tuned(s), "group_name"), "group_name")


# ---- alignment (NW over LSH survivors, guard, blocks) ----

def lsh_survivors(spark, d):
    """LSH candidate pairs of the same source, and the whole token sequences of all documents."""
    s = signed_docs(spark, d)
    cand = G.lsh_candidates(G.band_table(s, "group_name", "entity_id", packed=True), "group_name")
    return cand, docs(spark, d).select("entity_id", S.tokens("text").alias("t"))


@query("align_nw")
def q_align_nw(spark, d):
    from pairsim.operators.alignment import align_nw_pairs
    a = align_nw_pairs(*lsh_survivors(spark, d))
    return a.select("group_name", "id1", "id2", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
                    "status", "lcs", F.round("score", R).alias("score"))


@query("align_guard", oracle="WITH " + SIG_SQL.lstrip() + """
SELECT c.group_name, c.id1, c.id2,
       CASE WHEN len(a.toks)::BIGINT * len(b.toks)::BIGINT <= 1000000 THEN 'ok' ELSE 'large' END AS status
FROM cand c JOIN docs a ON a.doc_id = c.id1 JOIN docs b ON b.doc_id = c.id2""")
def q_align_guard(spark, d):
    from pairsim.operators.alignment import align_guard
    s = signed_docs(spark, d)
    cand = G.lsh_candidates(G.band_table(s, "group_name", "entity_id", packed=True), "group_name")
    n = docs(spark, d).select("entity_id", F.size(S.tokens("text")).alias("n"))
    p = cand.join(n.select(F.col("entity_id").alias("id1"), F.col("n").alias("n1")), "id1") \
            .join(n.select(F.col("entity_id").alias("id2"), F.col("n").alias("n2")), "id2")
    return align_guard(p, "n1", "n2", 1_000_000).select("group_name", "id1", "id2", "status")


@query("block_nearest", oracle="WITH " + SIG_SQL.lstrip() + """,
bl AS (SELECT doc_id, (u.i - 1)::INTEGER AS block, list_filter(string_split_regex(u.ln, '\\s+'), lambda x: x <> '') AS bt
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
             FROM docs) u),
bs AS (SELECT doc_id, block, len(bt) AS bsize, bt FROM bl),
h AS (SELECT doc_id, block, token, count(*) AS f FROM (SELECT doc_id, block, unnest(bt) AS token FROM bs) GROUP BY ALL),
sh AS (SELECT c.id1, c.id2, l.block AS lblock, r.block AS rblock, sum(least(l.f, r.f)) AS shared
       FROM cand c JOIN h l ON l.doc_id = c.id1 JOIN h r ON r.doc_id = c.id2 AND r.token = l.token GROUP BY ALL),
al AS (SELECT c.id1, c.id2, l.block AS lblock, l.bsize AS lsize, r.block AS rblock, r.bsize AS rsize
       FROM cand c JOIN bs l ON l.doc_id = c.id1 JOIN bs r ON r.doc_id = c.id2),
dd AS (SELECT al.*, lsize + rsize - 2 * coalesce(shared, 0) AS dist FROM al LEFT JOIN sh USING (id1, id2, lblock, rblock)),
rk AS (SELECT *, row_number() OVER (PARTITION BY id1, id2, rblock ORDER BY dist, abs(lsize - rsize), lblock) AS r FROM dd)
SELECT id1, id2, rblock, rsize::INTEGER AS rsize, lblock, lsize::INTEGER AS lsize, dist::BIGINT AS dist FROM rk WHERE r = 1""")
def q_block_nearest(spark, d):
    from pairsim.operators.alignment import block_nearest, block_table
    s = signed_docs(spark, d)
    cand = G.lsh_candidates(G.band_table(s, "group_name", "entity_id", packed=True), "group_name")
    n = block_nearest(cand, block_table(docs(spark, d)))
    return n.select("id1", "id2", "rblock", "rsize", "lblock", "lsize", F.col("dist").cast("long").alias("dist"))


@query("align_blocks")
def q_align_blocks(spark, d):
    from pairsim.operators.alignment import align_blocks, block_table
    s = signed_docs(spark, d)
    cand = G.lsh_candidates(G.band_table(s, "group_name", "entity_id", packed=True), "group_name")
    a = align_blocks(cand, block_table(docs(spark, d)))
    return a.select("id1", "id2", "matches", "entries", F.round("score", R).alias("score"))


# The sequential definition: right blocks in order, each takes the best left block that is still there.
BLOCKS_SQL = """,
bl AS (SELECT doc_id, (u.i - 1)::INTEGER AS block, list_filter(string_split_regex(u.ln, '\\s+'), lambda x: x <> '') AS bt
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
             FROM docs) u),
bs AS (SELECT doc_id, block, len(bt) AS bsize, bt FROM bl),
h AS (SELECT doc_id, block, token, count(*) AS f FROM (SELECT doc_id, block, unnest(bt) AS token FROM bs) GROUP BY ALL),
sh AS (SELECT c.id1, c.id2, l.block AS lblock, r.block AS rblock, sum(least(l.f, r.f)) AS shared
       FROM cand c JOIN h l ON l.doc_id = c.id1 JOIN h r ON r.doc_id = c.id2 AND r.token = l.token GROUP BY ALL),
al AS (SELECT c.id1, c.id2, l.block AS lblock, l.bsize AS lsize, r.block AS rblock, r.bsize AS rsize
       FROM cand c JOIN bs l ON l.doc_id = c.id1 JOIN bs r ON r.doc_id = c.id2),
dd AS (SELECT al.*, lsize + rsize - 2 * coalesce(shared, 0) AS dist, shared IS NOT NULL AS ok FROM al LEFT JOIN sh USING (id1, id2, lblock, rblock)),"""
# LCS of two lists, row by row of the table; the last entry of a row is its largest.
LCS_SQL = """list_reduce(list_transform(range(1, len({a}) + 1), lambda i: [i]), lambda p, z: list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [j]),
  lambda q, x: list_append(q, CASE WHEN {a}[z[1]] = {b}[x[1]] THEN p[x[1]] + 1 ELSE greatest(p[x[1] + 1], q[x[1]]) END), [0::BIGINT]), list_transform(range(len({b}) + 1), lambda j: 0::BIGINT))"""


@query("align_blocks_consuming", oracle="WITH RECURSIVE " + SIG_SQL.lstrip() + BLOCKS_SQL + f"""
od AS (SELECT *, row_number() OVER (PARTITION BY id1, id2, rblock ORDER BY dist, abs(lsize - rsize), lsize < rsize, lblock) AS k FROM dd),
step AS (SELECT id1, id2, -1 AS r, []::INTEGER[] AS used, []::INTEGER[] AS takers FROM cand
  UNION ALL
  SELECT s.id1, s.id2, s.r + 1, CASE WHEN arg_min(o.ok, o.k) THEN list_append(any_value(s.used), arg_min(o.lblock, o.k)) ELSE any_value(s.used) END,
    CASE WHEN arg_min(o.ok, o.k) THEN list_append(any_value(s.takers), s.r + 1) ELSE any_value(s.takers) END
  FROM step s JOIN od o ON o.id1 = s.id1 AND o.id2 = s.id2 AND o.rblock = s.r + 1 AND NOT list_contains(s.used, o.lblock) GROUP BY s.id1, s.id2, s.r),
got AS (SELECT id1, id2, arg_max(used, r) AS used, arg_max(takers, r) AS takers FROM step GROUP BY ALL),
m AS (SELECT id1, id2, unnest(used) AS lblock, unnest(takers) AS rblock FROM got),
bp AS (SELECT DISTINCT l.bt AS lt, r.bt AS rt FROM m JOIN bs l ON l.doc_id = id1 AND l.block = lblock JOIN bs r ON r.doc_id = id2 AND r.block = rblock),
lc AS (SELECT lt, rt, CASE WHEN lt = rt THEN len(lt) ELSE list_max({LCS_SQL.format(a='lt', b='rt')}) END AS l FROM bp),
pm AS (SELECT id1, id2, sum(lc.l)::BIGINT AS matches FROM m JOIN bs l ON l.doc_id = id1 AND l.block = lblock JOIN bs r ON r.doc_id = id2 AND r.block = rblock JOIN lc ON lc.lt = l.bt AND lc.rt = r.bt GROUP BY ALL),
z AS (SELECT doc_id, sum(bsize)::BIGINT AS n FROM bs GROUP BY ALL)
SELECT c.group_name, c.id1, c.id2, coalesce(matches, 0)::BIGINT AS matches, (a.n + b.n - coalesce(matches, 0))::BIGINT AS entries,
  round(CASE WHEN a.n + b.n - coalesce(matches, 0) > 0 THEN coalesce(matches, 0) / (a.n + b.n - coalesce(matches, 0))::DOUBLE END, 6) AS score
FROM cand c JOIN z a ON a.doc_id = c.id1 JOIN z b ON b.doc_id = c.id2 LEFT JOIN pm USING (id1, id2)""")
def q_align_blocks_consuming(spark, d):
    from pairsim.operators.alignment import align_blocks_consuming, block_table
    s = signed_docs(spark, d)
    cand = cut_lineage(G.lsh_candidates(G.band_table(s, "group_name", "entity_id", packed=True), "group_name").select("group_name", "id1", "id2"))
    out = align_blocks_consuming(cand, cut_lineage(block_table(docs(spark, d)))).join(cand, ["id1", "id2"])
    return out.select("group_name", "id1", "id2", "matches", "entries", F.round("score", R).alias("score"))


ADAPT_SQL = """,
sz AS (SELECT group_name, count(*)::BIGINT AS size FROM docs GROUP BY group_name),
pol AS (SELECT * FROM (VALUES (0, 64, 100, 2, 0.0), (64, 1024, 50, 4, 0.2), (1024, 4611686018427387904, 25, 8, 0.4))
        t(lo, hi, bands, rows, threshold)),
par AS (SELECT group_name, threshold FROM sz JOIN pol ON size >= lo AND size < hi)"""


@query("lsh_adaptive_candidates", oracle="WITH " + SIG_SQL.lstrip() + ADAPT_SQL + f""",
ad AS (SELECT c.*, 1.0 - len(list_filter(list_zip(s1.sig, s2.sig), lambda z: z[1] = z[2])) / {K}.0 AS dist, p.threshold
       FROM cand c JOIN sig s1 ON s1.doc_id = c.id1 JOIN sig s2 ON s2.doc_id = c.id2 JOIN par p ON p.group_name = c.group_name)
SELECT group_name, id1, id2, shared_bands, round(dist, 6) AS minhash_distance, dist <= 1.0 - threshold AS within_policy FROM ad""")
def q_lsh_adaptive_candidates(spark, d):
    s = signed_docs(spark, d)
    sizes = docs(spark, d).groupBy("group_name").agg(F.count(F.lit(1)).alias("size"))
    params = G.adaptive_parameters(sizes, "group_name")
    # All candidates whatever the group's size; the policy's threshold only marks them.
    cand = G.lsh_candidates(G.band_table(s, "group_name", "entity_id", packed=True), "group_name")
    j = G.listed_minhash_distance(cand, s, out="d").join(params.select("group_name", "threshold"), "group_name")
    dist = F.col("d")
    return j.select("group_name", "id1", "id2", "shared_bands", F.round(dist, R).alias("minhash_distance"),
                    (dist <= F.lit(1.0) - F.col("threshold")).alias("within_policy"))
