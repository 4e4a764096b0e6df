"""URL filters against plain rules and a plain power iteration."""

import pytest

from servertide.llm.hosts import DAMPING, ROUNDS, host_links, judge_urls, propagate
from servertide.llm.queries import RULES

URLS = [
    None, "", "no scheme", "http://", "http:///x", "http://Example.ORG/es/1", "https://a.b.example.org/es", "https://example.org/en/1", "https://example.org/en/2?x#y",
    "ftp://org/", "http://org", "http://xorg/", "http://a.org?/es/", "http://WWW.x.com/fr/ü", "http://x.com/de/", "http://x.com/DE/", "http://x.com/en/", "://x.com/de/a",
    "http://y.net/", "a://b.com/fr/://c.com/de/", "http://É.org/x", "http://.org/", "http://x.com./de/", "http://example.org\n/es/", "http://" + "a" * 50_000 + ".org/" + "p" * 50_000,
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    stop = min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:stop]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits and host else (None, None)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(None, "http://x.com/de/", "<a>"), (5, "http://x.com/de/", "")]
    table = pages(spark, rows).selectExpr("*", "1 AS host", "2 AS path", "3 AS verdict", "4 AS rules")
    found = judge_urls(table, RULES).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r for r in found if r.page_id not in (None, 5)}
    for i, url in enumerate(URLS):
        if i != 5:
            name, verdict = rule(*parts(url))
            r = by_id[i]
            assert (r.host, r.path, r.rule) == (*parts(url), name), url
            assert r.verdict == verdict if name else r.verdict in ("allow", "block")
    assert judge_urls(pages(spark, []), RULES).collect() == []
    assert {r.verdict for r in judge_urls(pages(spark, rows), []).collect()} == {"allow"}


def test_links(spark):
    html = '<a href="http://B.com/x">1</a> <A HREF=\'https://c.org\'>2</a> <a href=http://b.com>3</a> <a href="/own">4</a> <a href="http://a.com/">5</a>'
    table = spark.createDataFrame([("a.com", html), ("a.com", '<a href="http://b.com">'), ("", html), ("m.a.com", "")], "host string, html string")
    assert {tuple(r) for r in host_links(table).collect()} == {
        ("a.com", "b.com", 3), ("a.com", "c.org", 1), ("m.a.com", "a.com", 1), ("a.com", "m.a.com", 1)}


def test_propagation(spark):
    links = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("c", "a", 1), ("d", "c", 3), ("e", "d", 1)]
    seeds = [("trust", "a", 0.75), ("trust", "b", 0.25), ("distrust", "c", 1.0)]
    found = propagate(spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame(seeds, "kind string, host string, share double"))
    got = {(r.kind, r.host): r.score for r in found.collect()}
    for kind, edges in (("trust", links), ("distrust", [(b, a, n) for a, b, n in links])):
        start = {h: s for k, h, s in seeds if k == kind}
        score = {h: (1 - DAMPING) * s for h, s in start.items()}
        for _ in range(ROUNDS):
            new = {h: (1 - DAMPING) * s for h, s in start.items()}
            for a, b, n in edges:
                new[b] = new.get(b, 0) + DAMPING * score.get(a, 0) * n / sum(m for x, _, m in edges if x == a)
            score = new
        for host, value in score.items():
            assert got.get((kind, host), 0) == pytest.approx(value)


def test_small_scores_and_far_hosts_decide(spark):
    def link(host, n=1):
        return f'<a href="http://{host}/">' * n

    rows = [(0, "http://bad.com/de/1", "")]
    # Six links away, each of which carries a thousandth; and a chain of twenty links.
    few = ["bad.com"] + [f"few{i}.net" for i in range(1, 7)]
    far = ["bad.com"] + [f"far{i}.net" for i in range(1, 21)]
    rows += [(100 + i, f"http://{few[i]}/", link(few[i - 1])) for i in range(1, 7)]
    rows += [(200 + i, f"http://{far[i]}/", link(far[i - 1])) for i in range(1, 21)]
    rows += [(1, "http://many.net/", "".join(link(h, 1000) for h in few[:-1])), (2, "http://alone.net/", "")]
    verdicts = {r.page_id: r.verdict for r in judge_urls(pages(spark, rows), RULES).collect()}
    assert {i for i, v in verdicts.items() if v == "allow"} == {2}


def test_method_decides_without_a_rule(spark):
    link = '<a href="http://bad.com/de/">x</a>'
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://friend.net/", link), (3, "http://good.com/fr/1", '<a href="http://liked.net/">'), (4, "http://liked.net/", ""), (5, "http://alone.net/", "")]
    verdicts = {r.page_id: r.verdict for r in judge_urls(pages(spark, rows), RULES).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
