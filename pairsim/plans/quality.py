"""Integrity and set queries: O29, O30, O57, O87, O93-O95, O109, O111."""

from pyspark.sql import functions as F

from pairsim.functions.scores import clean_score
from pairsim.operators import pairs as P
from pairsim.operators.quality import fk_orphans, pk_duplicates, rule_violations
from pairsim.plans.registry import query
from pairsim.sources.tables import read_table, scored_pairs, text_entities, vector_entities


@query("fk_orphans", oracle="""
SELECT 'lineitem->orders' AS check_name, count(*)::BIGINT AS orphans FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL
SELECT 'labels->documents', count(*)::BIGINT FROM labels l
  WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
UNION ALL
SELECT 'lineitem->orders(status F)', count(*)::BIGINT FROM lineitem l
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')""")
def q_fk_orphans(spark, d):
    li = read_table(spark, d, "lineitem", ["l_orderkey"])
    o = read_table(spark, d, "orders", ["o_orderkey", "o_orderstatus"])
    lab = read_table(spark, d, "labels", ["doc_id"])
    docs = read_table(spark, d, "documents", ["doc_id"])
    checks = [
        ("lineitem->orders", fk_orphans(li, o, ["l_orderkey"], ["o_orderkey"])),
        ("labels->documents", fk_orphans(lab, docs, ["doc_id"], ["doc_id"])),
        ("lineitem->orders(status F)", fk_orphans(li, o.filter(F.col("o_orderstatus") == "F"), ["l_orderkey"],
                                                  ["o_orderkey"])),
    ]
    outs = [df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(n).alias("check_name"), "orphans")
            for n, df in checks]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


@query("pk_duplicates", oracle="""
SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def q_pk_duplicates(spark, d):
    return pk_duplicates(read_table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"])


@query("rule_violations", oracle="""
WITH s AS (SELECT CASE WHEN round(l_discount * 100)::INTEGER <= 7 THEN 0.0 WHEN round(l_discount * 100)::INTEGER = 10
                  THEN 1.0 ELSE (round(l_discount * 100)::INTEGER - 7) / 3.0 END AS score,
                  l_orderkey, l_linenumber, l_tax / 0.08 AS raw_pred FROM lineitem)
SELECT 'score_null' AS rule, count(*) FILTER (WHERE score IS NULL OR isnan(score))::BIGINT AS violations FROM s
UNION ALL SELECT 'score_range', count(*) FILTER (WHERE score < 0 OR score > 1)::BIGINT FROM s
UNION ALL SELECT 'id_null', count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL)::BIGINT FROM s
UNION ALL SELECT 'pred_range', count(*) FILTER (WHERE raw_pred < 0 OR raw_pred > 1)::BIGINT FROM s
UNION ALL SELECT 'vector_length', (SELECT count(*) FILTER (WHERE len(embedding) <> 64 OR embedding IS NULL)
                                   FROM embeddings)::BIGINT""")
def q_rule_violations(spark, d):
    sp = scored_pairs(spark, d, extra=["l_orderkey", "l_linenumber", (F.col("l_tax") / 0.08).alias("raw_pred")])
    s = clean_score(F.col("score"))
    r1 = rule_violations(sp, {
        "score_null": s.isNull(),
        "score_range": (s < 0) | (s > 1),
        "id_null": F.col("l_orderkey").isNull() | F.col("l_linenumber").isNull(),
        "pred_range": (F.col("raw_pred") < 0) | (F.col("raw_pred") > 1),
    })
    r2 = rule_violations(vector_entities(spark, d), {
        "vector_length": F.col("encoding").isNull() | (F.size("encoding") != 64)})
    return r1.unionByName(r2)


# "Pairs of a split": vector pairs whose cosine exceeds 0.3.
SPLIT_PAIRS_SQL = """
vp AS (SELECT a.label::BIGINT AS group_id, a.vec_id AS id1, b.vec_id AS id2,
              round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
       FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
sel AS (SELECT * FROM vp WHERE score > 0.3)"""


def split_pairs(spark, d):
    return P.vector_pair_scores(vector_entities(spark, d), decimals=6, above=0.3)


@query("pair_member_ids", oracle="WITH " + SPLIT_PAIRS_SQL + """
SELECT DISTINCT group_id, entity_id FROM (SELECT group_id, id1 AS entity_id FROM sel
                                          UNION ALL SELECT group_id, id2 FROM sel)""")
def q_pair_member_ids(spark, d):
    return P.pair_member_ids(split_pairs(spark, d))


@query("semi_entities", oracle="WITH " + SPLIT_PAIRS_SQL + """
SELECT label::BIGINT AS group_id, vec_id AS entity_id FROM embeddings e
WHERE EXISTS (SELECT 1 FROM sel WHERE sel.group_id = e.label AND (sel.id1 = e.vec_id OR sel.id2 = e.vec_id))""")
def q_semi_entities(spark, d):
    ents = vector_entities(spark, d).select("group_id", "entity_id")
    return P.semi_members(ents, split_pairs(spark, d))


@query("semi_groups", oracle="WITH " + SPLIT_PAIRS_SQL + """
SELECT DISTINCT label::BIGINT AS group_id FROM embeddings WHERE label IN (SELECT group_id FROM sel WHERE score > 0.45)""")
def q_semi_groups(spark, d):
    groups = vector_entities(spark, d).select("group_id").distinct()
    return P.semi_groups(groups, split_pairs(spark, d).filter(F.col("score") > 0.45))


@query("pairs_file_filter", oracle="WITH " + SPLIT_PAIRS_SQL + """,
listed AS (SELECT group_id, id2 AS a, id1 AS b FROM vp WHERE score < -0.3)
SELECT group_id, id1, id2 FROM vp
WHERE EXISTS (SELECT 1 FROM listed l WHERE l.group_id = vp.group_id AND least(l.a, l.b) = vp.id1
              AND greatest(l.a, l.b) = vp.id2)""")
def q_pairs_file_filter(spark, d):
    ents = vector_entities(spark, d)
    # The listed pairs come in reversed order; the operator normalises them.
    listed = P.vector_pair_scores(ents, decimals=6, below=-0.3).select("group_id", F.col("id2").alias("id1"), F.col("id1").alias("id2"))
    return P.listed_pairs(ents, listed)


@query("exact_duplicates", oracle="""
WITH s AS (SELECT 'source' AS scope, doc_id AS entity_id, min(doc_id) OVER (PARTITION BY source, text) AS class_id,
                  count(*) OVER (PARTITION BY source, text) AS members FROM documents WHERE text IS NOT NULL
           UNION ALL
           SELECT 'any', doc_id, min(doc_id) OVER (PARTITION BY text), count(*) OVER (PARTITION BY text)
           FROM documents WHERE text IS NOT NULL)
SELECT scope, entity_id, class_id, members FROM s WHERE members > 1""")
def q_exact_duplicates(spark, d):
    ents = text_entities(spark, d)
    by_source = P.exact_duplicates(ents, "text", group="group_name").select(F.lit("source").alias("scope"), "entity_id", "class_id", "members")
    anywhere = P.exact_duplicates(ents.withColumn("group_name", F.lit("all")), "text", group="group_name").select(
        F.lit("any").alias("scope"), "entity_id", "class_id", "members")
    return by_source.unionByName(anywhere)
