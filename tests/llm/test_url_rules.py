"""URL rules against a plain reading of every rule for every page."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import url_rules

ODD = [
    None, "", "no scheme", "http://", "https://ORG", "https://ORG/", "http://A.Example.ORG/en/17?x=/es/", "http://xexample.org/es/1", "ftp://example.org/es/#a",
    "http://example.org?/es/", "http://example.org:80/es/", "http://u@example.org/es/", "a://b://example.org/es/", "http://É.COM/fr/", "http://é.com/de/\n/x",
    "http://.org/", "http://org./", "http://com/fr", "http://com/fr/" + "x" * 70000, "http://" + "a." * 4000 + "com/de/x", "://com/de/", "http://example.org/en/1",
]


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        for k, c in enumerate(rest):
            if c in "/?#":
                break
        else:
            k = len(rest)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
        path = rest[k:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


def test_pages_as_by_plain_reading(spark):
    rows = [(k, u, "x", 1) for k, u in enumerate(ODD)] + [(3, ODD[6], "x", 1), (None, ODD[6], None, None), (3, ODD[6], "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, row int")
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, url_rules.given_rules(spark)).collect())
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(((str(k), *plain(u, url_rules.RULES)) for k, u, *_ in rows), key=key)
    assert url_rules.judge_urls(pages.limit(0), url_rules.given_rules(spark)).count() == 0


def test_many_rules_and_a_full_filter(spark):
    random.seed(3)
    hosts = [".".join(random.choice("abc") for _ in range(random.randint(1, 4))) for _ in range(60)]
    path = lambda: "".join(random.choice(["/a", "/b", "/ab", "x"]) for _ in range(random.randint(0, 5)))
    paths = [p for p in (path() for _ in range(60)) if p == "" or p[0] == "/"]
    rules = [(random.choice(hosts), random.choice(paths), random.choice(["allow", "block"])) for _ in range(300)]
    best = {}
    for h, p, v in rules:
        best[h, p] = max(v, best.get((h, p), v))
    urls = [f"http://{random.choice(['', 'A.', 'z.'])}{random.choice(hosts)}{random.choice(paths)}{random.choice(['', '/c', '?q'])}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    odd = [(None, "/", "block"), ("a", None, None), ("a", "x", "block"), ("A", "/Zz", "block")]
    table = spark.createDataFrame(rules + odd, "host string, path string, verdict string")
    want = [plain(u, [(h, p, v) for (h, p), v in best.items()]) for u in urls]
    for blocks in (1, 1 << 10):  # one block alone is nearly full: many false positives, the same rows
        got = {r.page_id: tuple(r)[1:] for r in url_rules.judge_urls(pages, table, max_blocks=blocks).collect()}
        assert got == dict(enumerate(want))
    none = url_rules.judge_urls(pages, table.limit(0), default="block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")} and len(none) == 400


def test_the_filter_holds_every_key_and_few_others(spark):
    keys = [f"host{k}.example/{k}" for k in range(3000)]
    table = url_rules.bloom_filter(spark.createDataFrame([(k,) for k in keys], "key string"), 512)
    assert url_rules.may_hold(table, keys).all()
    assert url_rules.may_hold(table, [f"other{k}/" for k in range(20000)]).mean() < 0.01
    assert not url_rules.may_hold(np.zeros((4, 8), np.uint32), keys).any()


def test_the_two_parts_of_a_url(spark):
    df = spark.createDataFrame([(u,) for u in ODD], "url string")
    for r in df.select("url", *[c.alias(n) for n, c in zip(("h", "p"), url_rules.host_and_path(F.col("url")))]).collect():
        assert (r.h, r.p) == plain(r.url, [])[:2]
