"""Source, sink and ingest queries: O01, O03-O06, O08, O09, O12, O15-O18, O22-O24, O31, O84, O89."""

from pyspark.sql import functions as F

from pairsim.operators import ingest as I
from pairsim.operators.ranking import dense_uid, sorted_positions
from pairsim.plans.registry import query
from pairsim.sources import text as T
from pairsim.sources.sinks import entity_listing
from pairsim.sources.tables import read_table, text_entities

R = 6
STRIP = r"^\s+|\s+$"


def _strip(c):
    return F.regexp_replace(c, STRIP, "")


# ---- embedding text lines rendered from `embeddings` (fixed 6-decimal text), then parsed back ----

def embedding_lines(spark, d, name_expr):
    e = read_table(spark, d, "embeddings")
    floats = F.array_join(F.transform("embedding", lambda x: F.format_string("%.6f", x.cast("double"))), " ")
    line = F.concat(F.lit("@enc:"), F.lpad(F.col("label").cast("string"), 6, "0"), name_expr,
                    F.lit(T.EMBED_SEP), floats)
    return e.select(F.col("label").cast("long").alias("group_id"), F.col("vec_id").alias("line_no"), line.alias("value"))


EMB_LINES_SQL = """
lines AS (
  SELECT label::BIGINT AS group_id, vec_id AS line_no,
         '@enc:' || lpad(label::VARCHAR, 6, '0') || {name} || chr(9) || '=' || chr(9)
         || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ' ') AS value
  FROM embeddings),
parsed AS (
  SELECT group_id, line_no,
         substr(split_part(regexp_replace(value, '^\\s+|\\s+$', '', 'g'), chr(9) || '=' || chr(9), 1), 12) AS name,
         string_split_regex(regexp_replace(split_part(regexp_replace(value, '^\\s+|\\s+$', '', 'g'),
                            chr(9) || '=' || chr(9), 2), '^\\s+|\\s+$', '', 'g'), '\\s+') AS toks
  FROM lines)"""


def _parsed_summary(p):
    vsum = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return p.select("name", F.size("vector").cast("long").alias("dim"), "vector_csv", F.round(vsum, R).alias("vsum"))


@query("embedding_text_parse", oracle="WITH " + EMB_LINES_SQL.format(name="'f' || vec_id") + """
SELECT name, len(toks)::BIGINT AS dim, array_to_string(toks, ',') AS vector_csv,
       round(list_sum(list_transform(toks, lambda t: t::FLOAT::DOUBLE)), 6) AS vsum FROM parsed""")
def q_embedding_text_parse(spark, d):
    lines = embedding_lines(spark, d, F.concat(F.lit("f"), F.col("vec_id").cast("string")))
    lines = lines.withColumn("value", F.concat(F.lit("  "), "value", F.lit(" \t")))  # stray blanks are stripped
    return _parsed_summary(T.parse_embedding_lines(lines))


@query("embedding_last_wins", oracle="WITH " + EMB_LINES_SQL.format(name="'label' || label") + """,
w AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY line_no DESC) AS r FROM parsed)
SELECT name, line_no, array_to_string(toks, ',') AS vector_csv FROM w WHERE r = 1""")
def q_embedding_last_wins(spark, d):
    # Every label's vectors are written under one name; the latest line (highest vec_id) wins.
    lines = embedding_lines(spark, d, F.concat(F.lit("label"), F.col("label").cast("string")))
    return T.last_wins(T.parse_embedding_lines(lines), "line_no").select("name", "line_no", "vector_csv")


# ---- merge logs rendered from `lineitem`, then parsed back ----

def log_lines(spark, d):
    li = read_table(spark, d, "lineitem")
    flags = F.when(F.col("l_returnflag") == "N", F.lit("FLAGS=none")).otherwise(
        F.concat(F.lit("TECHNIQUE="), F.col("l_returnflag"), F.lit(" ROWS=2")))
    fname = F.concat(F.lit("build.bench"), F.col("l_suppkey").cast("string"), F.lit("."), flags, F.lit(".0.1.log"))
    s1 = (F.col("l_quantity").cast("long") * 10)
    s2 = (F.col("l_linenumber") * 7).cast("long")
    m = (F.col("l_extendedprice") / 100).cast("long")
    merge = F.format_string("@f%d + @g%d <= %.2f Valid: %d BinSizes: %d + %d <= %d Cost: %d Profitable: %d",
                            F.col("l_partkey"), F.col("l_suppkey"), F.col("l_discount"),
                            F.when(F.col("l_linestatus") == "F", 1).otherwise(0), s1, s2, m, F.col("l_linenumber"),
                            F.when(m < s1 + s2, 1).otherwise(0))
    base = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 3
    rows = F.array(
        F.struct(base.alias("line_no"), F.when(F.col("l_linenumber") == 1, F.concat(
            F.lit("Number of Functions: "), F.col("l_orderkey").cast("string"))).alias("value")),
        F.struct((base + 1).alias("line_no"), F.when(F.col("l_linenumber") == 2, F.concat(
            F.lit("Skipped @f"), F.col("l_partkey").cast("string"), F.lit(" + @g: not eligible"))).alias("value")),
        F.struct((base + 2).alias("line_no"), merge.alias("value")))
    return li.select(fname.alias("file_name"), F.explode(rows).alias("x")).select("file_name", "x.*") \
             .filter(F.col("value").isNotNull())


LOG_LINES_SQL = """
li AS (
  SELECT *, 'build.bench' || l_suppkey || '.' ||
            CASE WHEN l_returnflag = 'N' THEN 'FLAGS=none' ELSE 'TECHNIQUE=' || l_returnflag || ' ROWS=2' END
            || '.0.1.log' AS file_name,
         l_quantity::BIGINT * 10 AS s1, (l_linenumber * 7)::BIGINT AS s2,
         trunc(l_extendedprice / 100)::BIGINT AS m, l_orderkey * 100 + l_linenumber * 3 AS base
  FROM lineitem),
lines AS (
  SELECT file_name, base AS line_no, 'Number of Functions: ' || l_orderkey AS value FROM li WHERE l_linenumber = 1
  UNION ALL
  SELECT file_name, base + 1, 'Skipped @f' || l_partkey || ' + @g: not eligible' FROM li WHERE l_linenumber = 2
  UNION ALL
  SELECT file_name, base + 2, printf('@f%d + @g%d <= %.2f Valid: %d BinSizes: %d + %d <= %d Cost: %d Profitable: %d',
         l_partkey, l_suppkey, l_discount, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END, s1, s2, m, l_linenumber,
         CASE WHEN m < s1 + s2 THEN 1 ELSE 0 END) FROM li),
parsed AS (
  SELECT file_name, line_no,
         CASE WHEN regexp_matches(value, '{nf}') THEN regexp_extract(value, '{nf}', 1)::BIGINT END AS n_functions,
         regexp_matches(value, '{mg}') AS is_merge,
         CASE WHEN regexp_matches(value, '{mg}') THEN regexp_extract(value, '{mg}', 1)::BIGINT END AS valid,
         CASE WHEN regexp_matches(value, '{mg}') THEN regexp_extract(value, '{mg}', 2)::BIGINT END AS size1,
         CASE WHEN regexp_matches(value, '{mg}') THEN regexp_extract(value, '{mg}', 3)::BIGINT END AS size2,
         CASE WHEN regexp_matches(value, '{mg}') THEN regexp_extract(value, '{mg}', 4)::BIGINT END AS merged_size,
         CASE WHEN regexp_matches(value, '{mg}') THEN regexp_extract(value, '{mg}', 5)::BIGINT END AS profitable
  FROM lines WHERE regexp_matches(value, '{nf}') OR regexp_matches(value, '{mg}')),
files AS (
  SELECT DISTINCT file_name, regexp_extract(file_name, '{fn}', 1) AS benchmark,
         regexp_extract(file_name, '{fn}', 2) AS flags
  FROM lines WHERE regexp_matches(file_name, '{fn}'))""".format(
    nf=T.NUM_FUNCTIONS_RE, mg=T.MERGE_LINE_RE, fn=T.LOG_FILENAME_RE)


@query("merge_log_parse", oracle="WITH " + LOG_LINES_SQL + """
SELECT file_name, line_no, n_functions, is_merge, valid, size1, size2, merged_size, profitable FROM parsed""")
def q_merge_log_parse(spark, d):
    p = T.parse_log_lines(log_lines(spark, d))
    return p.select("file_name", "line_no", "n_functions", "is_merge", "valid", "size1", "size2", "merged_size",
                    "profitable")


@query("log_filename_meta", oracle="WITH " + LOG_LINES_SQL + " SELECT file_name, benchmark, flags FROM files")
def q_log_filename_meta(spark, d):
    return T.log_file_meta(log_lines(spark, d).select("file_name").distinct()).select("file_name", "benchmark", "flags")


@query("merge_log_metrics", oracle="WITH " + LOG_LINES_SQL + """,
agg AS (
  SELECT file_name, arg_max(n_functions, line_no) FILTER (WHERE n_functions IS NOT NULL) AS nf,
         count(*) FILTER (WHERE is_merge) AS att, count(*) FILTER (WHERE profitable = 1) AS prof,
         sum(merged_size - (size1 + size2)) AS diff
  FROM parsed GROUP BY file_name)
SELECT f.file_name, benchmark, flags, coalesce(nf, 0)::BIGINT AS total_functions,
       coalesce(att, 0)::BIGINT AS merge_attempts, coalesce(prof, 0)::BIGINT AS profitable_merges,
       coalesce(diff, 0)::BIGINT AS bin_size_difference
FROM files f LEFT JOIN agg USING (file_name)""")
def q_merge_log_metrics(spark, d):
    return T.merge_log_metrics(log_lines(spark, d), order="line_no")


# ---- paths and names ----

URL_PATH = r"^[a-z]+://[^/]+(/[^?#]*)"


@query("group_from_path", oracle=f"""
SELECT page_id, string_split(regexp_extract(url, '{URL_PATH}', 1), '/')[-2] AS group_name FROM pages""")
def q_group_from_path(spark, d):
    p = read_table(spark, d, "pages", ["page_id", "url"])
    return p.select("page_id", T.group_from_path(F.regexp_extract("url", URL_PATH, 1)).alias("group_name"))


@query("natural_sort", oracle="""
WITH u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE url || repeat(page_id::VARCHAR, 12) END AS url FROM pages),
k AS (SELECT page_id, url, array_to_string(list_transform(regexp_extract_all(url, '([0-9]+|[^0-9]+)', 1),
       lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(length(ltrim(x, '0'))::VARCHAR, 10, '0') || ltrim(x, '0') ELSE x END), '') AS sort_key
      FROM u)
SELECT page_id, url, sort_key, row_number() OVER (ORDER BY sort_key, url, page_id)::BIGINT AS position FROM k""")
def q_natural_sort(spark, d):
    # Every other URL ends in a run of digits far beyond 20 places.
    p = read_table(spark, d, "pages", ["page_id", "url"]).withColumn("url", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(
        F.concat("url", F.repeat(F.col("page_id").cast("string"), F.lit(12)))))
    keyed = p.withColumn("sort_key", T.natural_key(F.col("url")))
    return sorted_positions(keyed, ["sort_key", "url", "page_id"], out="position")


@query("scan_projection", oracle="SELECT doc_id, source, n_chars FROM documents")
def q_scan_projection(spark, d):
    return read_table(spark, d, "documents", ["doc_id", "source", "n_chars"])


# ---- entity listing, appends, updates ----

@query("entity_listing", oracle="""
SELECT n_nationkey::BIGINT AS group_id, c_custkey AS entity_id,
       printf('%d : %s\t%d : %s', n_nationkey, n_name, c_custkey, c_name) AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_entity_listing(spark, d):
    g = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("group_id"),
                                              F.col("n_name").alias("group_name"))
    e = read_table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("group_id"),
                                                F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    return entity_listing(e, g)


GROUPS_SQL = """
g0 AS (SELECT row_number() OVER (ORDER BY md5('g:' || source))::BIGINT AS group_id, source AS group_name
       FROM (SELECT DISTINCT source FROM documents WHERE lang = 'en')),
inc AS (SELECT DISTINCT source AS group_name FROM documents WHERE lang <> 'en'),
new AS (SELECT group_name FROM inc WHERE group_name NOT IN (SELECT group_name FROM g0))"""


def source_groups(docs):
    """Groups of a document set: distinct sources, ids 1..n in md5('g:'||name) order."""
    g = docs.select(F.col("source").alias("group_name")).distinct()
    return dense_uid(g, ["group_name"], out="group_id", seed="g").withColumn("group_id", F.col("group_id") + 1)


@query("insert_if_absent", oracle="WITH " + GROUPS_SQL + """
SELECT group_id, group_name FROM g0
UNION ALL
SELECT ((SELECT coalesce(max(group_id), 0) FROM g0) + row_number() OVER (ORDER BY md5('uid:' || group_name)))::BIGINT,
       group_name FROM new""")
def q_insert_if_absent(spark, d):
    docs = read_table(spark, d, "documents", ["source", "lang"])
    g0 = source_groups(docs.filter(F.col("lang") == "en"))
    inc = docs.filter(F.col("lang") != "en").select(F.col("source").alias("group_name"))
    return I.insert_groups_if_absent(g0, inc)


@query("append_entities", oracle="""
SELECT source AS group_name, doc_id AS entity_id, 'doc' || doc_id AS name, n_chars AS estimated_size,
       true AS no_encoding FROM documents WHERE lang = 'en'
UNION ALL
SELECT source, doc_id, 'doc' || doc_id, NULL, true FROM documents WHERE lang <> 'en'""")
def q_append_entities(spark, d):
    docs = read_table(spark, d, "documents", ["doc_id", "source", "lang", "n_chars"])
    named = docs.select(F.col("source").alias("group_name"), F.col("doc_id").alias("entity_id"),
                        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"),
                        F.col("n_chars").alias("estimated_size"), "lang")
    base = named.filter(F.col("lang") == "en").drop("lang").withColumn(
        "encoding", F.lit(None).cast("array<float>"))
    rows = named.filter(F.col("lang") != "en").select("group_name", "entity_id", "name")
    out = I.append_entities(base, rows)
    return out.select("group_name", "entity_id", "name", "estimated_size", F.col("encoding").isNull().alias("no_encoding"))


FWW_SQL = """
li AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_shipdate,
              md5('42:' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-'
                  || l_quantity::DECIMAL(18,2) || '-' || l_extendedprice::DECIMAL(18,2)) AS pair_key FROM lineitem),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, pair_key) r
                     FROM li WHERE l_linestatus = 'F') WHERE r = 1),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, pair_key) r
                     FROM li WHERE l_linestatus = 'O') WHERE r = 1)"""


@query("first_writer_wins", oracle="WITH " + FWW_SQL + """
SELECT l_orderkey, l_linenumber, pair_key, l_linestatus AS batch FROM f
UNION ALL
SELECT l_orderkey, l_linenumber, pair_key, l_linestatus FROM o
WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.l_orderkey = o.l_orderkey AND f.l_linenumber = o.l_linenumber)""")
def q_first_writer_wins(spark, d):
    from pairsim.sources.tables import pair_order_key
    li = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", pair_order_key().alias("pair_key"), F.col("l_linestatus").alias("batch"),
        "l_shipdate")
    arrival = F.struct("l_shipdate", "pair_key")
    pk = ["l_orderkey", "l_linenumber"]
    empty = li.limit(0).drop("l_shipdate")
    t1 = I.first_writer_wins(empty, li.filter(F.col("batch") == "F"), pk, arrival)
    return I.first_writer_wins(t1, li.filter(F.col("batch") == "O"), pk, arrival)


@query("update_encoding", oracle="""
SELECT label::BIGINT AS group_id, vec_id AS entity_id, embedding[1] > 0 AS updated,
       round((CASE WHEN embedding[1] > 0 THEN list_reverse(embedding) ELSE embedding END)[1]::DOUBLE, 6) AS first_value
FROM embeddings""")
def q_update_encoding(spark, d):
    from pairsim.sources.tables import vector_entities
    ents = vector_entities(spark, d)
    src = ents.filter(F.try_element_at("encoding", F.lit(1)) > 0).select("group_id", "entity_id",
                                                              F.reverse("encoding").alias("encoding"))
    u = I.update_from(ents, src, ["group_id", "entity_id"], "encoding")
    return u.select("group_id", "entity_id", "updated",
                    F.round(F.try_element_at("encoding", F.lit(1)).cast("double"), R).alias("first_value"))


@query("lookup_group", oracle="""
WITH probes AS (SELECT r_name AS group_name FROM region UNION SELECT n_name FROM nation)
SELECT p.group_name, coalesce(max(n_nationkey), -1)::BIGINT AS group_id
FROM probes p LEFT JOIN nation n ON n.n_name = p.group_name GROUP BY p.group_name""")
def q_lookup_group(spark, d):
    nat = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("group_id"),
                                               F.col("n_name").alias("group_name"))
    probes = read_table(spark, d, "region").select(F.col("r_name").alias("group_name")).union(
        nat.select("group_name")).distinct()
    return I.lookup_group(nat, probes)


@query("entities_of_group", oracle="SELECT doc_id AS entity_id, n_chars FROM documents WHERE source = 'src3'")
def q_entities_of_group(spark, d):
    return text_entities(spark, d).filter(F.col("group_name") == "src3").select(
        "entity_id", F.col("estimated_size").alias("n_chars"))


DBNAME_SQL = """CASE WHEN label < 5 THEN '@"f' || vec_id || '"' ELSE '%f' || vec_id END"""


@query("name_normalise", oracle=f"""
SELECT vec_id, {DBNAME_SQL} AS raw_name, trim(substr({DBNAME_SQL}, 2), '"') AS name FROM embeddings""")
def q_name_normalise(spark, d):
    e = read_table(spark, d, "embeddings", ["vec_id", "label"])
    raw = F.when(F.col("label") < 5, F.concat(F.lit('@"f'), F.col("vec_id").cast("string"), F.lit('"'))).otherwise(
        F.concat(F.lit("%f"), F.col("vec_id").cast("string")))
    return e.select("vec_id", raw.alias("raw_name")).withColumn("name", I.db_name(F.col("raw_name")))


@query("join_by_name", oracle="WITH " + EMB_LINES_SQL.format(name="'f' || vec_id") + f""",
db AS (SELECT label::BIGINT AS group_id, vec_id AS entity_id, {DBNAME_SQL} AS raw_name FROM embeddings)
SELECT db.group_id, db.entity_id, len(parsed.toks)::BIGINT AS dim
FROM db JOIN parsed ON trim(substr(db.raw_name, 2), '"') = parsed.name AND db.group_id = parsed.group_id""")
def q_join_by_name(spark, d):
    e = read_table(spark, d, "embeddings", ["vec_id", "label"])
    raw = F.when(F.col("label") < 5, F.concat(F.lit('@"f'), F.col("vec_id").cast("string"), F.lit('"'))).otherwise(
        F.concat(F.lit("%f"), F.col("vec_id").cast("string")))
    db = e.select(F.col("label").cast("long").alias("group_id"), F.col("vec_id").alias("entity_id"), raw.alias("name"))
    lines = embedding_lines(spark, d, F.concat(F.lit("f"), F.col("vec_id").cast("string")))
    parsed = T.parse_embedding_lines(lines).select(F.col("group_id").alias("_fg"), "name", "vector")
    j = I.join_by_name(db, parsed)
    return j.filter(F.col("group_id") == F.col("_fg")).select("group_id", "entity_id",
                                                             F.size("vector").cast("long").alias("dim"))


MERGE_SQL = """
ds AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INTEGER AS src FROM (SELECT DISTINCT lang FROM documents)),
g AS (SELECT src, source AS group_name,
             row_number() OVER (PARTITION BY src ORDER BY md5('g:' || source))::BIGINT AS group_id
      FROM (SELECT DISTINCT ds.src, d.source FROM documents d JOIN ds USING (lang))),
e AS (SELECT ds.src, d.doc_id, g.group_id FROM documents d JOIN ds USING (lang)
      JOIN g ON g.src = ds.src AND g.group_name = d.source),
names AS (SELECT src, list(group_name) AS nm FROM g GROUP BY src),
acc AS (
  SELECT 0 AS k, (SELECT nm FROM names WHERE src = 0) AS seen, [0] AS accepted
  UNION ALL
  SELECT acc.k + 1,
         CASE WHEN len(list_intersect(acc.seen, n.nm)) = 0 THEN list_concat(acc.seen, n.nm) ELSE acc.seen END,
         CASE WHEN len(list_intersect(acc.seen, n.nm)) = 0 THEN list_append(acc.accepted, acc.k + 1) ELSE acc.accepted END
  FROM acc JOIN names n ON n.src = acc.k + 1),
accepted AS (SELECT unnest(accepted) AS src FROM (SELECT accepted FROM acc ORDER BY k DESC LIMIT 1)),
ra AS (SELECT g.* FROM g WHERE src IN (SELECT src FROM accepted)),
rmx AS (SELECT src, max(group_id) AS mx FROM ra GROUP BY src),
roff AS (SELECT src, coalesce(sum(mx) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
         FROM rmx),
rej AS (SELECT 'reject-source' AS policy, (ra.group_id + off)::BIGINT AS group_id, ra.group_name,
               (SELECT count(*) FROM e WHERE e.src = ra.src AND e.group_id = ra.group_id)::BIGINT AS n_entities
        FROM ra JOIN roff USING (src)),
fst AS (SELECT group_name, min(src) AS f FROM g GROUP BY group_name),
intro AS (SELECT g.* FROM g JOIN fst ON g.group_name = fst.group_name AND g.src = fst.f),
umx AS (SELECT src, max(group_id) AS mx FROM intro GROUP BY src),
uoff AS (SELECT src, coalesce(sum(mx) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
         FROM umx),
ids AS (SELECT intro.group_name, (intro.group_id + off)::BIGINT AS gid FROM intro JOIN uoff USING (src)),
uni AS (SELECT 'unify-by-name' AS policy, ids.gid AS group_id, ids.group_name, count(e.doc_id)::BIGINT AS n_entities
        FROM ids JOIN g ON g.group_name = ids.group_name JOIN e ON e.src = g.src AND e.group_id = g.group_id
        GROUP BY ids.gid, ids.group_name)"""


@query("merge_datasets", oracle="WITH RECURSIVE " + MERGE_SQL + " SELECT * FROM rej UNION ALL SELECT * FROM uni")
def q_merge_datasets(spark, d):
    docs = read_table(spark, d, "documents", ["doc_id", "source", "lang"])
    # The data sets are the languages, in name order (a handful of values).
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    sets = []
    for lang in langs:
        part = docs.filter(F.col("lang") == lang)
        g = source_groups(part)
        e = part.join(g, part["source"] == g["group_name"]).select("group_id", "doc_id")
        sets.append({"groups": g, "entities": e})
    outs = []
    for policy in ("reject-source", "unify-by-name"):
        m = I.merge_datasets(sets, policy)
        n = m["entities"].groupBy("group_id").agg(F.count(F.lit(1)).alias("n_entities"))
        outs.append(m["groups"].join(n, "group_id", "left").select(
            F.lit(policy).alias("policy"), "group_id", "group_name",
            F.coalesce("n_entities", F.lit(0)).cast("long").alias("n_entities")))
    return outs[0].unionByName(outs[1])
