"""URL filter: rules and PageRank against plain Python."""

import numpy as np

from barloom.llm import url_filter
from barloom.llm.queries import RULES

URLS = [("http://a.example.org/es/1", "example.org/es/", "block"), ("http://example.org/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "org/", "allow"), ("http://x.com/fr/", "com/fr/", "allow"), ("https://X.Com/de/?q=/", "com/de/", "block"),
        ("http://x.com", None, None), ("http://x.org", None, None), ("http://x.org?/a", None, None), ("http://notexample.org/es/", "org/", "allow"),
        ("x.org/a", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("a://b.com/fr/x://y.org/", "com/fr/", "allow"), ("://org/", "org/", "allow")]


def test_rules(spark):
    rows = [(i, u, None, "x") for i, (u, _, _) in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    assert len(got) == len(URLS)
    for i, (url, rule, verdict) in enumerate(URLS):
        assert got[i].rule == rule and (verdict is None or got[i].verdict == verdict), (url, got[i])
    assert (got[4].host, got[4].path) == ("x.com", "/de/") and (got[9].host, got[9].path) == ("", "")
    assert (got[12].host, got[12].path) == ("b.com", "/fr/x://y.org/")


def link(*hosts):
    return "".join(f'<p><a class=x href="http://{h}/">t</a><a href=/own>o</a>' for h in hosts)


def test_spread_against_power_iteration(spark):
    rng = np.random.default_rng(4)
    n = 12
    weight = (rng.random((n, n)) < 0.25) * rng.integers(1, 5, (n, n)) * (1 - np.eye(n))
    weight[3] = 0
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", float(weight[i, j])) for i, j in zip(*np.nonzero(weight))], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", "trust", 1.0), ("h1", "trust", 3.0), ("h2", "distrust", 0.5)], "host string, kind string, seed double")
    got = {(r.host, r.kind): r.score for r in url_filter.spread(edges, seeds, 60, 1e-5).collect()}
    for kind, w, s in (("trust", weight, {0: 0.25, 1: 0.75}), ("distrust", weight.T, {2: 1.0})):
        move = w / np.maximum(w.sum(1, keepdims=True), 1)
        start = np.array([s.get(i, 0) for i in range(n)])
        x = start * 0
        for _ in range(300):
            x = 0.15 * start + 0.85 * x @ move
        assert np.allclose([got.get((f"h{i}", kind), 0.0) for i in range(n)], x, atol=2e-4)


def test_hosts_near_seeds(spark):
    pages = [(1, "http://good.net/a", link("friend.net")), (2, "http://friend.net/", ""), (3, "http://bad.biz/x", ""), (4, "http://fan.biz/", link("bad.biz")),
             (5, "http://sub.fan.biz/q", "<a href='//bad.biz/y'>"), (6, "http://lone.net/", ""), (7, "http://www.good.net/b", None)]
    frame = spark.createDataFrame(pages + [(8, "http://fan.biz/2", link("bad.biz", "good.net"))], "page_id long, url string, html string")
    rules = spark.createDataFrame([("good.net", "/a", "allow"), ("bad.biz", "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in url_filter.judge(frame, rules).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "block"}


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/de/", None), (1, "http://a.com/de/", None)], "page_id long, url string, html string")
    assert url_filter.judge(pages.limit(0), rules).collect() == []
    assert [r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()] == ["allow", "allow"]


def test_real_table(spark, sf_dir):
    from barloom.llm.queries import op7_url_filter

    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op7_url_filter(spark, sf_dir).collect()
    assert len(got) == len(pages) and {r.verdict for r in got} == {"allow", "block"}
    for r in got:
        rest = pages[r.page_id].split("://", 1)[1]
        host = rest.replace("?", "/").replace("#", "/").split("/")[0].lower()
        path = rest[len(host):].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert not fits or r.verdict == max(fits)[2]
