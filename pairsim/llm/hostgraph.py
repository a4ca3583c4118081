"""URL filters: allow/block rules, and link-graph trust for the hosts that no rule decides.

Rules ``host/path`` fit a host and its subdomains when the URL's path starts with the rule's; the longest rule wins. For
URLs that no rule fits, host trust decides: personalised PageRank over host links from the hosts whose pages rules allow,
against distrust, the same walk over reversed links from the hosts whose pages rules block (a host that links to blocked
hosts earns distrust). A host is blocked if its distrust, taken relative to the mean over hosts, is at least ``threshold`` and
over its trust.

Everything is DataFrame expressions. Links are summed per host pair first, so a hub's links are rows of its
distinct neighbours; each step joins them with the ranks by host (split by AQE where skewed) and sums per target
with map-side partial sums. Lineage is cut by a stored table per step; steps go on until the ranks settle within a tolerance.

Defined cases: null urls and urls without ``://`` have empty host and path, no rule, and the default verdict of a host
without links (allow); null html has no links; repeated rows and ids get a row each; rules that tie in length are
ordered by text; an empty table gives an empty result; extra columns are ignored by ``judge``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsim.llm.shared import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Summed change of all ranks of a kind (which sum to 1) at which they are settled.
TOLERANCE = 1e-4
#: Absolute and protocol-relative targets of links.
TARGET = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and rule_verdict (null where none fits) to rows with host, path; ``rules``: rule, verdict.

    Hosts are joined with rules by their name and each parent domain; a host's few fitting rules then meet its URLs.
    """
    rules = rules.select("rule", "verdict", F.regexp_extract("rule", r"^([^/]*)", 1).alias("suffix"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("start"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host").where("host <> ''").distinct().select("host", F.explode(parents).alias("suffix"))
    rule = F.struct(F.length("rule").alias("n"), "rule", "verdict", "start")
    fits = store(hosts.join(rules, "suffix").groupBy("host").agg(F.collect_set(rule).alias("_fits")).withColumnRenamed("host", "_fit_host"), "host-rules")
    out = urls.join(fits, F.col("host") == F.col("_fit_host"), "left")
    best = F.array_max(F.filter("_fits", lambda r: F.col("path").startswith(r["start"])))
    return out.withColumn("_best", best).withColumn("rule", F.col("_best")["rule"]).withColumn("rule_verdict", F.col("_best")["verdict"]).drop("_fits", "_fit_host", "_best")


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, w: links between different hosts, w the share of the source's links; pages have host, html."""
    targets = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(TARGET), F.lit(1))
    to = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("url"))
    dst = F.translate(F.regexp_extract("url", r"//([^/?#]*)", 1), UPPER, LOWER)
    pairs = to.select("src", dst.alias("dst")).where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return store(pairs, "host-links")


def propagate(links: DataFrame, seeds: DataFrame, damping: float, tolerance: float = TOLERANCE, steps: int | None = None) -> DataFrame:
    """host, kind, rank: personalised PageRank. ``links``: kind, src, dst, w; ``seeds``: kind, host, mass (sums to 1 per kind).

    Mass that reaches a host without links returns to the seeds, by the share that the step lost. A step shrinks the summed change
    of ranks by the damping at least; steps end when no kind's change exceeds ``tolerance``, or after ``steps`` if that is given.
    """
    rank = seeds.select("kind", "host", F.col("mass").alias("rank"))
    # From a change of at most 2, so many steps reach the tolerance; more would mean that the links' weights don't sum to 1.
    most = steps or math.ceil(math.log(tolerance / 2) / math.log(damping)) + 1
    for _ in range(most):
        sent = links.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("w") * damping).alias("got"))
        got = sent.groupBy("kind").agg(F.sum("got").alias("kept"))
        back = seeds.join(got, "kind", "left").select("kind", "host", (F.col("mass") * (1 - F.coalesce("kept", F.lit(0.0)))).alias("got"))
        now = store(sent.unionByName(back).groupBy("kind", "host").agg(F.sum("got").alias("rank")), "host-rank")
        change = now.unionByName(rank.withColumn("rank", -F.col("rank"))).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("d")).groupBy("kind").agg(F.sum("d").alias("d"))
        rank = now
        if steps is None and (change.agg(F.max("d").alias("d")).first().d or 0.0) <= tolerance:
            return rank
    if steps is None:
        raise RuntimeError(f"ranks still change by more than {tolerance} after {most} steps")
    return rank


def host_trust(pages: DataFrame, damping: float = 0.85, tolerance: float = TOLERANCE, steps: int | None = None) -> DataFrame:
    """host, trust, distrust (relative to the mean host's) of every linked or judged host; pages: host, html, rule_verdict."""
    pairs = host_links(pages)
    if pairs.isEmpty():
        return pages.sparkSession.createDataFrame([], "host string, trust double, distrust double")
    seeds = pages.where("rule_verdict is not null and host <> ''").groupBy(F.col("rule_verdict").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    total = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = store(seeds.join(total, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("mass")), "host-seeds")
    out = pairs.groupBy("src").agg(F.sum("n").alias("all"))
    back = pairs.groupBy("dst").agg(F.sum("n").alias("all"))
    forward = pairs.join(out, "src").select(F.lit("allow").alias("kind"), "src", "dst", (F.col("n") / F.col("all")).alias("w"))
    reverse = pairs.join(back, "dst").select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("w"))
    rank = propagate(store(forward.unionByName(reverse), "host-edges"), seeds, damping, tolerance, steps)
    hosts = pages.select("host").union(pairs.select("dst")).where("host <> ''").distinct().count()
    score = lambda k: (F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)) * float(hosts))
    return store(rank.groupBy("host").agg(score("allow").alias("trust"), score("block").alias("distrust")), "host-trust")


def judge(pages: DataFrame, rules: DataFrame, threshold: float = 1.0, damping: float = 0.85, tolerance: float = TOLERANCE, steps: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages`` (page_id, url, html)."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    judged = with_rules(rows, rules)
    trust = host_trust(judged, damping, tolerance, steps).withColumnRenamed("host", "_trust_host")
    out = judged.drop("html").join(trust, F.col("host") == F.col("_trust_host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when((distrust >= threshold) & (distrust > trust), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
