import numpy as np
from pyspark.sql import functions as F

from pairsim.llm import hostgraph, queries

#: The contract's rules, written out by hand.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def rules(spark):
    return spark.createDataFrame(URL_RULES, "rule string, verdict string")


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = rest[:min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host):]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = ["https://a.EXAMPLE.org/es/1", "http://example.org/en/12?x=/es/", "http://example.org/en/2#a", "http://notexample.org/es/1", "http://org/", "http://org", "http://b.com/fr/", "http://com/de/9", "http://com/De/9",
        "http://x.net/a", "no scheme", "", None, "://h.org/", "a://b://c.org/x", "http://É.ORG/É?q", "http://example.org?es", "http://q.example.org/es/en/1", "https://a.example.org:80/es/", "x://\nh.org/\n?"]


def test_rules_against_plain(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(3, URLS[3], "<a href=/x>")] * 2 + [(None, URLS[0], "")]
    df = pages(spark, rows).withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1)).withColumn("path", F.lit("p"))
    got = sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in hostgraph.judge(df, rules(spark)).collect()], key=str)
    want = sorted([(i, *(f := plain(u))[:3], f[3] or "allow") for i, u, _ in rows], key=str)
    assert got == want


def test_links_decide_hosts_without_rules(spark):
    a = lambda *hosts: "".join(f"<a class=x href='https://{h}/p?q'>t</a>" for h in hosts)
    rows = [(1, "http://good.org/", a("fine.net", "good.org")), (2, "http://bad.com/de/1", "<a href=/rel>"), (3, "http://spam.net/", a("bad.com", "BAD.com", "worse.com")),
            (4, "http://fine.net/", a("good.org")), (5, "http://worse.com/de/2", a("spam.net")), (6, "http://far.net/", a("spam.net")), (7, "http://lone.net/", "<p>")]
    got = {r.page_id: r for r in hostgraph.judge(pages(spark, rows), rules(spark), steps=15).collect()}
    assert {i: got[i].verdict for i in got} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "allow"}
    # The ranks against dense power iteration.
    hosts = ["good.org", "bad.com", "spam.net", "fine.net", "worse.com", "far.net", "lone.net"]
    w = np.zeros((7, 7))
    for _, u, h in rows:
        for t in ("good.org", "bad.com", "BAD.com", "spam.net", "fine.net", "worse.com"):
            if t.lower() != u.split("/")[2]:
                w[hosts.index(u.split("/")[2]), hosts.index(t.lower())] += h.count(f"//{t}/")
    for m, seeds, field in ((w, {"good.org": 1.0}, "trust"), (w.T, {"bad.com": 0.5, "worse.com": 0.5}, "distrust")):
        s = np.array([seeds.get(h, 0.0) for h in hosts])
        p = np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=m.sum(1, keepdims=True) > 0)
        r = s.copy()
        for _ in range(15):
            sent = 0.85 * r @ p
            r = sent + s * (1 - sent.sum())
        for i, (_, u, _) in enumerate(rows, 1):
            assert abs(got[i][field] - 7 * r[hosts.index(u.split("/")[2])]) < 1e-9


def test_empty_table(spark):
    assert hostgraph.judge(pages(spark, []), rules(spark)).collect() == []
    assert hostgraph.judge(pages(spark, [(1, "http://org/", "")]), rules(spark).limit(0)).collect()[0].verdict == "allow"


def test_the_query_has_the_contracts_rules(spark, tmp_path):
    urls = ["https://example.org/en/1", "http://a.example.org/en/12?q", "http://example.org/en/2", "http://x.org/en/1", "http://example.org/es/", "http://b.com/fr/1", "http://b.com/de/1", "http://b.com/it/"]
    pages(spark, [(i, u, "") for i, u in enumerate(urls)]).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.QUERIES["op5_host_graph"](spark, str(tmp_path)).collect()}
    assert got == {0: ("example.org/en/1", "block"), 1: ("example.org/en/1", "block"), 2: ("org/", "allow"), 3: ("org/", "allow"), 4: ("example.org/es/", "block"),
                   5: ("com/fr/", "allow"), 6: ("com/de/", "block"), 7: (None, "allow")}


def test_ranks_settle_on_a_long_chain(spark):
    # Thirty links from the seed: the limit of the ranks, not those after a fixed number of steps.
    n = 30
    rows = [(0, "http://good.org/", "<a href='https://h0.net/'>")] + [(i + 1, f"http://h{i}.net/", f"<a href='https://h{i + 1}.net/'>") for i in range(n)]
    got = {r.host: r.trust for r in hostgraph.judge(pages(spark, rows), rules(spark), tolerance=1e-3).collect()}
    last = got[f"h{n - 1}.net"]
    seed = 1 / sum(0.85**k for k in range(n + 2))  # every host keeps 0.85 of the one before; what the last one loses returns
    assert last > 0 and abs(last - (n + 2) * seed * 0.85**n) < (n + 2) * 1e-2
