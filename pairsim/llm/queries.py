"""Registered queries of the numbered operators, with production parameters, and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsim.llm import bitpack, cotrain, hostgraph, langid, maxscore, merkle, mixing, oph, pii, positional, resample, simhash, toxicity
from pairsim.llm.shared import crc_mod, table

QUERIES: dict = {}
ORACLE: dict = {}

#: Of the test tables: the tokenizer file and the id that ends a document.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f
    return put


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=crc_mod("doc_id", 5) != 0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("matches").alias("n_matches"))


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"), shingle=3, budget=2, seed=42)
    return found.select("doc_id", "fingerprint", "component_id")


_MIX_SQL = """
with d as (
  select doc_id, source, coalesce(md5(text), '') as h, row_number() over (partition by doc_id, source, text) as tie,
    cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size
  from documents),
dw as (select *, cast(length(bin(size)) as double) as dw from d),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, row_number() over (order by source asc nulls last) as no from s0),
s2 as (select *, cast((no - 1) % 3 + 1 as double) as w, 3.0::double * source_size as cap,
  cast(sum(source_size) over () as double) as total from s1),
s3 as (select *, (total - coalesce(sum(cap) over (order by cap / w, w, no rows between unbounded preceding and 1 preceding), 0.0))
  / sum(w) over (order by cap / w, w, no rows between current row and unbounded following) as level from s2),
s4 as (select *, level * w >= cap as is_full from s3),
s5 as (select *, arg_min(case when not is_full then level end, case when not is_full then cap / w end) over () as open_level from s4),
s6 as (select source, source_size, case when is_full then cap else open_level * w end as target from s5),
l0 as (select source, dw, cast(sum(size) as bigint) as words from dw group by all),
l1 as (select l0.*, source_size, target, dw * words as lw, 3.0::double * words as lcap,
  case when words > 0 then 3.0::double * words / (dw * words) else 'inf'::double end as ratio from l0 join s6 on l0.source is not distinct from s6.source),
l2 as (select *, sum(lw) over (partition by source order by ratio, lw, dw rows between current row and unbounded following) as open_lw,
  target - coalesce(sum(lcap) over (partition by source order by ratio, lw, dw rows between unbounded preceding and 1 preceding), 0.0) as open_words from l1),
l3 as (select *, case when open_lw > 0 then open_words / open_lw else 0.0::double end as level from l2),
l4 as (select *, level * lw >= lcap as is_full, row_number() over (partition by source order by ratio, lw, dw) as pos from l3),
l5 as (select *, arg_min(case when not is_full then level end, case when not is_full then pos end) over (partition by source) as open_level from l4),
l6 as (select *, case when words > 0 then least(case when is_full then lcap else open_level * lw end / words, 3.0::double) else 0.0::double end as e from l5),
s8 as (select *, cast(floor(e) as bigint) as base, e - floor(e) as p, target - sum(cast(floor(e) as bigint) * words) over (partition by source) as rest from l6),
u as (select dw.*, s8.source_size, target, base, p, rest,
  (cast(('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || h || ':' || tie), 1, 13)) as bigint) + 0.5) / 4503599627370496.0::double as u
  from dw join s8 on dw.source is not distinct from s8.source and dw.dw = s8.dw),
q as (select *, case when p > 0 then ((u * (1 - p)) / (p * (1 - u))) / (1 + (u * (1 - p)) / (p * (1 - u))) end as v, coalesce(doc_id, -9223372036854775808) as id from u),
g as (select source, v, id, rest, sum(size) as us from q where p > 0 group by all),
r as (select *, sum(us) over (partition by source order by v, id) as upto from g),
c as (select source, max({'v': v, 'id': id}) as cut from r where upto - us / 2.0 <= rest group by source),
m as (select q.*, coalesce(p > 0 and {'v': v, 'id': id} <= cut, false) as taken_in from q left join c on q.source is not distinct from c.source),
x as (select *, rest - sum(case when taken_in then size else 0 end) over (partition by source) as gap from m where p > 0),
y as (select source, min({'off': abs(size - abs(gap)), 'v': v, 'id': id, 'h': h, 'tie': tie}) as best from x
  where taken_in = (gap < 0) and abs(size - abs(gap)) < abs(gap) group by source)
select doc_id, size, source_size, target,
  (base + case when taken_in <> coalesce(p > 0 and v = best.v and id = best.id and h = best.h and tie = best.tie, false) then 1 else 0 end) * size as taken
from m left join y on m.source is not distinct from y.source
"""


@query("op3_pareto_mix", _MIX_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mixing.mix_report(table(spark, sf_dir, "documents"), cycle=(1, 2, 3), share=1.0, max_copies=3, weight=mixing.by_length(F.col("text")))
    return report.select("doc_id", "size", "source_size", "target", "taken")


@query("op4_cotrain")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The number at the end of a page's path is the document that it shows.
    pages = table(spark, sf_dir, "pages").select(F.expr("try_cast(nullif(regexp_extract(url, '://[^/?#]*/(?:[^?#]*/)?([0-9]+)(?:[.]html|/)?(?:[?#]|$)', 1), '') as bigint)").alias("doc_id"), "url", "html")
    model = cotrain.fit(docs, pages, table(spark, sf_dir, "labels"), learn=crc_mod("doc_id", 5) != 0)
    found = cotrain.score(docs, pages, model)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Host/path rules of the contract.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

# No page of the test tables links to another host, so the method's verdict is that of a host without links.
_URL_SQL = """
with r(rule, rule_verdict) as (values ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
p as (select row_number() over () as k, page_id,
  translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) as path from pages),
f as (select k, max({'n': length(rule), 'rule': rule, 'verdict': rule_verdict}) as best from p join r
  on (host = split_part(rule, '/', 1) or ends_with(host, '.' || split_part(rule, '/', 1)))
  and starts_with(path, substr(rule, strpos(rule, '/'))) group by k)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from p left join f using (k)
"""


@query("op5_host_graph", _URL_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return hostgraph.judge(table(spark, sf_dir, "pages"), rules, threshold=1.0).select("page_id", "host", "path", "rule", "verdict")


_TOP_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null
    and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)),
s as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


@query("op6_maxscore", _TOP_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k_rows(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, learn=crc_mod("doc_id", 4) != 2))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op8_bitpack")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.encode_and_read(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


_WORDS_SQL = "list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_DECON_SQL = f"""
with d as (select doc_id, text, row_number() over () as k, {_WORDS_SQL.format('text')} as w from documents),
b as (select distinct cast(item_id as varchar) as item_id, {_WORDS_SQL.format('text')} as w from benchmark),
win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as i from b where len(w) > 0)),
ns as (select distinct n from win),
pos as (select k, n, i, array_to_string(w[i:i + n - 1], ' ') as g
  from (select k, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, ns where len(w) >= n)),
occ as (select k, i, pos.n, item_id from pos join win on pos.n = win.n and pos.g = win.g),
hit as (select k, count(distinct p) as n_hit from (select k, unnest(generate_series(i, i + n - 1)) as p from occ) group by k),
its as (select k, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from occ group by k)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (k) left join its using (k)
"""


@query("op9_positional_index", _DECON_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *n, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


#: CRC32 of a text column's UTF-8 bytes in DuckDB: ``tab`` is the byte table of the reflected polynomial, made by its rule.
_CRC_TABLE_SQL = """select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as tab"""
_CRC_SQL = "xor(list_reduce(list_transform(range(octet_length(encode({0}))), lambda i: cast('0x' || substr(hex({0}), cast(2 * i + 1 as bigint), 2) as bigint)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"
_RESAMPLE_SQL = f"""
with crc as ({_CRC_TABLE_SQL}),
d as (select doc_id, row_number() over () as k, {_WORDS_SQL.format('text')} as w from documents),
b as (select {_WORDS_SQL.format('text')} as w from benchmark),
df as (select k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from d),
bf as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from b),
code as (select f, cast({_CRC_SQL.format('f')} % 10000 as bigint) as bucket from (select f from df union select f from bf), crc),
dn as (select k, bucket, count(*) as n from df join code using (f) group by all),
s as (select bucket, sum(n) as n from dn group by bucket), t as (select bucket, count(*) as n from bf join code using (f) group by bucket),
g as (select s.bucket, cast(floor(1000 * ln(cast((coalesce(t.n, 0) + 1) * ((select coalesce(sum(n), 0) from s) + 10000) as double) / cast((s.n + 1) * ((select coalesce(sum(n), 0) from t) + 10000) as double))) as bigint) as gain
  from s left join t using (bucket)),
m as (select k, cast(sum(dn.n) as bigint) as n_features, cast(sum(dn.n * gain) as bigint) as total from dn join g using (bucket) group by k),
r as (select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features,
    case when n_features is null then 0 else (total - ((total % n_features) + n_features) % n_features) // n_features end as weight,
    cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h from d left join m using (k)),
z as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double))) as bigint) as score from r),
o as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id, n_features) as no from z)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
  case when n_words >= 20 and no <= (select count(*) from z where n_words >= 20) * 25 // 100 then cast(no as bigint) end as rank from o
"""


@query("op11_importance_resampling", _RESAMPLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20, seed=7)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_FIELDS_SQL = " || ".join(f"coalesce(octet_length(encode(cast({f} as varchar))) || ':' || cast({f} as varchar), '-')" for f in ("doc_id", "source", "lang", "n_chars", "{0}"))
_MERKLE_SQL = f"""
with recursive crc as ({_CRC_TABLE_SQL}),
d as (select row_number() over () as k, doc_id, source, sha256({_FIELDS_SQL.format('text')}) as leaf,
    sha256({_FIELDS_SQL.format("(case when " + _CRC_SQL.format("coalesce(cast(doc_id as varchar), '')") + " % 2 = 0 then replace(text, chr(10), '') else text end)")}) as seen
  from documents, crc),
s as (select k, dense_rank() over (order by source nulls first) as g, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as slot, count(*) over (partition by source) as n, doc_id, leaf, seen from d),
nodes as (
  select g, cast(0 as bigint) as lvl, cast(slot as bigint) as i, leaf as h, cast(n as bigint) as n from s
  union all
  select g, lvl + 1, i // 3, sha256(string_agg(h, '' order by i)), (n + 2) // 3 from nodes where n > 1 group by g, lvl, i // 3, n),
subroots as (select g, h from nodes where n = 1),
tops as (
  select cast(0 as bigint) as lvl, cast(g - 1 as bigint) as i, h, cast((select count(*) from subroots) as bigint) as n from subroots
  union all
  select lvl + 1, i // 3, sha256(string_agg(h, '' order by i)), (n + 2) // 3 from tops where n > 1 group by lvl, i // 3, n),
sib as (
  select k, a.lvl, string_agg(case when b.i < a.i then b.h end, '' order by b.i) as l, string_agg(case when b.i > a.i then b.h end, '' order by b.i) as r
  from (select k, g, t.lvl, slot // cast(pow(3, t.lvl) as bigint) as i from s join (select distinct g as tg, lvl from nodes where n > 1) t on s.g = t.tg) a
  join nodes b on a.g = b.g and a.lvl = b.lvl and a.i // 3 = b.i // 3 group by k, a.lvl
  union all
  select k, 1000 + a.lvl, string_agg(case when b.i < a.i then b.h end, '' order by b.i), string_agg(case when b.i > a.i then b.h end, '' order by b.i)
  from (select k, t.lvl, (g - 1) // cast(pow(3, t.lvl) as bigint) as i from s, (select distinct lvl from tops where n > 1) t) a
  join tops b on a.lvl = b.lvl and a.i // 3 = b.i // 3 group by k, a.lvl),
step as (select k, coalesce(l, '') as l, coalesce(r, '') as r, row_number() over (partition by k order by lvl) as no from sib),
proof as (select k, string_agg(l || r, '' order by no) as p from step group by k),
fold as (
  select k, cast(0 as bigint) as no, seen as h from s
  union all
  select fold.k, step.no, sha256(l || h || r) from fold join step on fold.k = step.k and step.no = fold.no + 1),
folded as (select k, arg_max(h, no) as h from fold group by k)
select doc_id, leaf, subroots.h as subroot, (select h from tops where n = 1) as root, sha256(coalesce(p, '')) as proof_sha256, folded.h as folded_root, folded.h = (select h from tops where n = 1) as verified
from s join subroots using (g) left join proof using (k) join folded using (k)
"""


@query("op12_merkle_manifest", _MERKLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Where 2 divides the crc32 of the id, the text under test has lost its line feeds.
    text = F.col("text").cast("string")
    changed = F.when(crc_mod("doc_id", 2) == 0, F.translate(text, "\n", "")).otherwise(text)
    return merkle.manifest(table(spark, sf_dir, "documents"), changed).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op13_document_fingerprints")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = oph.edited_pairs(table(spark, sf_dir, "documents"), shingle=5, bins=512, bits=4, seed=42)
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return found.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")
