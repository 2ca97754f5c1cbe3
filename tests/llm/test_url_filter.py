import random

import duckdb

from lodestrata.llm import url_filter as u
from lodestrata.llm.url_filter import Rule, RuleTrie, filter_urls, split_url


def brute_force(url, rules):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), len(r.host), r.verdict == "block", r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else "allow"


URLS = [None, "", "example.net/en/", "http://", "http://Example.NET/en/x?y#z", "https://a.b.example.net/de", "https://example.net", "ftp://x.net?/en/", "x://y://z.net/", "http://notexample.net/en/", "http://net/", "http://.net/a", "http://w.org/fr/1", "http://w.org/fr", "http://m.example.com/de/#q", "http://é.net/ü\n/x", "http://ÄB.net/"]


def test_places_and_base_rules(spark):
    df = spark.createDataFrame([(k, url, "x") for k, url in enumerate(URLS)], "page_id long, url string, host string")
    for options in ({}, {"broadcast_bytes": 0}):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, **options).collect()}
        assert got == {k: brute_force(url, u.RULES) for k, url in enumerate(URLS)}


def test_random_rules_by_trie_and_by_join(spark):
    rng = random.Random(3)
    hosts = ["net", "example.net", "a.example.net", "com", "b.com"]
    paths = ["", "/", "/en", "/en/", "/en/a", "/e", "/en/a/b/"]
    rules = list({(h, p): Rule(h, p, rng.choice(["allow", "block"])) for h, p in ((rng.choice(hosts), rng.choice(paths)) for _ in range(20))}.values())
    urls = [f"http://{rng.choice(['', 'w.'])}{rng.choice(hosts)}{rng.choice([*paths, '/en/a/b/c', '/english'])}" for _ in range(300)]
    trie = RuleTrie.build(rules)
    for url in urls:
        best = trie.lookup(*split_url(url))
        assert (best.name if best else None) == brute_force(url, rules)[2]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = {k: brute_force(url, rules) for k, url in enumerate(urls)}
    for options in ({"rules": rules}, {"rules": frame}, {"rules": frame, "broadcast_bytes": 1}):
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, **options).collect()} == want


def test_sql_gives_the_same(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({u.ORACLE_SQL})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in u.query(spark, sf_dir).select(*names).collect())


def test_edges(spark):
    df = spark.createDataFrame([(None, "http://a.net/"), (1, "http://a.net/" + "x" * 200000), (1, "http://a.net/" + "x" * 200000)], "page_id long, url string")
    assert [r.verdict for r in filter_urls(df).collect()] == ["block"] * 3
    assert filter_urls(df.limit(0)).collect() == [] and {r.verdict for r in filter_urls(df, rules=[]).collect()} == {"allow"}
