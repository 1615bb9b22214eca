from tessera.llm.common import components
from tessera.llm.urls import RULES, filter_urls, links, with_parts


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]


URLS = [None, "", "nope", "http://", "http://A.Example.COM/en/1?x#y", "https://example.com/en/712", "x://a.net/de/8", "x://www.example.net/de/81", "http://org/es/", "http://borg/es/", "ftp://é.org/es/q", "http://a://b/c", "http://h?q=/en/", "http://com/en/"]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in filter_urls(pages, RULES).collect()}
    for i, u in enumerate(URLS):
        host, path = brute(u)
        fits = [(len(h + p), v, h + p) for v, h, p in RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        rule = max(fits)[2] if fits else None
        assert (got[i].host_, got[i].path_, got[i].rule_) == (host, path, rule), u
        assert got[i].verdict_ == (max(fits)[1] if fits else "allow")


def test_aliases(spark):
    canonical = '<link rel="canonical" href="{}">'
    refresh = '<META HTTP-EQUIV=refresh content="0; url={}">'
    rows = [
        (1, "http://bad.com/en/1", ""),
        (2, "http://copy.io/a", canonical.format("http://bad.com/en/1")),
        (3, "http://copy.io/b/c", refresh.format("/a")),
        (4, "http://www.copy.io/b/c.html?utm_source=x", ""),
        (5, "http://copy.io/d", canonical.format("http://example.com/en/7")),
        (6, "http://example.com/en/7", canonical.format("//bad.io/z")),
        (7, "http://bad.io/z", canonical.format("http://worse.com/en/2")),
        (8, "http://alone.io/", None),
        (9, None, canonical.format("http://bad.com/en/1")),
        (2, "http://copy.io/a", canonical.format("http://bad.com/en/1")),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumnsRenamed({})
    out = filter_urls(pages, RULES).select("page_id", "verdict_").collect()
    assert len(out) == len(rows)
    v = {r.page_id: r.verdict_ for r in out}
    # an explicit allow goes before a block among aliases, but never against a rule of the page itself
    assert v == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}
    assert links(pages).count() == 6
    assert filter_urls(pages.limit(0), RULES).count() == 0
    more = spark.createDataFrame([("http://alone.io", "http://bad.com/en/1"), (None, "x://y")], "src string, dst string")
    v = {r.page_id: r.verdict_ for r in filter_urls(pages, RULES, redirects=more).collect()}
    assert v[8] == "block"


def test_keys(spark):
    urls = ["http://www.a.b/c/", "https://A.b/c.html#x", "https://a.b/c?utm_medium=1&ref=2", "https://a.b/c?z=1&gclid=9"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.key_ for r in with_parts(df, "url").select("key_").collect()] == ["a.b/c", "a.b/c", "a.b/c", "a.b/c?z=1"]


def test_components(spark):
    import random

    rnd = random.Random(4)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(1000, x) for x in range(1001, 1200)] + [(x, x + 1) for x in range(2000, 2060)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges for x in e if None not in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_planted_links_at_size(spark):
    """Chains, cycles, stars and conflicts among 100,000 pages, as html links and as redirects, against union-find."""
    import random

    rnd, n = random.Random(5), 100_000
    url = [f"http://h{i % 977}.{rnd.choice(['com', 'net', 'io', 'io'])}/{rnd.choice(['en', 'de', 'x', 'y', 'z'])}/{i}" for i in range(n)]
    edges = [(i, i + 1) for i in range(0, 3000) if i % 60]
    edges += [(4000 + i, 4000 + (i + 1) % 50) for i in range(50)] + [(5000, x) for x in range(5001, 9000)]
    edges += [(rnd.randrange(10_000, n), rnd.randrange(10_000, n)) for _ in range(30_000)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    html = [""] * n
    plain = []
    for a, b in edges:
        parent[find(a)] = find(b)
        if html[a] == "":
            html[a] = f'<link rel="canonical" href="{url[b]}">'
        else:
            plain.append((url[a], url[b]))
    own = []
    for u in url:
        host, path = brute(u)
        fits = [(len(h + p), v) for v, h, p in RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        own.append(max(fits)[1] if fits else None)
    told = {}
    for i, v in enumerate(own):
        told.setdefault(find(i), set()).add(v)
    want = {i: v or ("allow" if "allow" in told[find(i)] or "block" not in told[find(i)] else "block") for i, v in enumerate(own)}
    import pandas as pd

    pages = spark.createDataFrame(pd.DataFrame({"page_id": range(n), "url": url, "html": html}))
    redirects = spark.createDataFrame(plain, "src string, dst string")
    got = dict(filter_urls(pages, RULES, redirects=redirects).select("page_id", "verdict_").toPandas().itertuples(index=False))
    assert got == want and sum(v == "block" and o is None for v, o in zip((want[i] for i in range(n)), own)) > 1000


def test_query_runs_the_components(spark, tmp_path):
    from tessera.llm.urls import op1_url_filters

    rows = [(1, "http://bad.com/en/1", ""), (2, "http://copy.io/a", '<link rel="canonical" href="http://bad.com/en/1">'), (3, "http://other.io/", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.page_id: r.verdict for r in op1_url_filters(spark, str(tmp_path)).collect()} == {1: "block", 2: "block", 3: "allow"}
