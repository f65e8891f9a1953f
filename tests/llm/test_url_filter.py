import re

from plotyard.llm.queries import RULES
from plotyard.llm.url_filter import filter_urls, spread_scores


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/en/12?x=/es/", "https://example.org", "http://x.com/fr/1#a", "http://x.com?/fr/", "ftp://y.com/de/://z", "http://ÄB.org/", "http://norg/", "http://a.net/x\ny?z"]
    pages = spark.createDataFrame([(i, u, None, "t") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, RULES).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
        path = m[2] if m else ""
        fits = [(a, r) for a, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        best = max(fits, key=lambda x: len(x[1]), default=None)
        assert got[i][:3] == (host, path, best and best[1])
        if best:
            assert got[i][3] == best[0]
    assert got[0] == ("", "", None, "allow") and got[10][3] == "allow"


def test_scores_match_a_dense_iteration(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("b", "a", 1.0), ("c", "d", 5.0), ("e", "d", 1.0), ("a", "e", 1.0)]
    seeds = [("a", 3.0, 0.0), ("c", 1.0, 1.0), ("d", 0.0, 2.0)]
    got = {r.host: (r.trust, r.distrust) for r in spread_scores(
        spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    hosts = "abcde"
    for k in (0, 1):
        links = [(s, d, w) if k == 0 else (d, s, w) for s, d, w in edges]
        seed = {h: sum(x[1 + k] for x in seeds if x[0] == h) for h in hosts}
        seed = {h: v / sum(seed.values()) for h, v in seed.items()}
        rank = dict(seed)
        for _ in range(20):
            into = {h: sum(rank[s] * w / sum(x[2] for x in links if x[0] == s) for s, d, w in links if d == h) for h in hosts}
            rank = {h: 0.85 * into[h] + (1 - 0.85 * sum(into.values())) * seed[h] for h in hosts}
        for h in hosts:
            assert abs(got.get(h, (0.0, 0.0))[k] - rank[h]) < 1e-4


def test_links_decide_where_no_rule_does(spark):
    link = '<a HREF="https://{}/p">x</a> <a href=/own>y</a>'
    pages = [
        (1, "http://good.org/", link.format("friend.net")), (2, "http://friend.net/", None), (3, "http://spam.net/", link.format("Bad.com")),
        (4, "http://bad.com/de/1", ""), (5, "http://www.spam.net/", ""), (6, "http://lonely.net/", link.format("friend.net")), (7, "http://friend.net/", ""),
    ]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert {i: got[i].verdict for i in range(1, 8)} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow"}
    assert got[2].trust > 0 and got[3].distrust > 0 and got[6].trust == got[6].distrust == 0


def test_an_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).collect() == []


def test_a_long_chain_to_a_blocked_seed(spark):
    link = '<a href="http://h{}.net/p">x</a>'
    pages = [(i, f"http://h{i}.net/", link.format(i + 1)) for i in range(29)] + [(29, "http://h29.net/", '<a href="http://bad.com/">x</a>'), (30, "http://bad.com/de/1", "")]
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert {r.verdict for r in got.values()} == {"block"}
    # one chain: a rank is the damped one of the next host
    assert all(abs(got[i].distrust - 0.85 * got[i + 1].distrust) < 1e-5 for i in range(30))
    assert abs(sum(r.distrust for r in got.values()) - 1) < 1e-5
