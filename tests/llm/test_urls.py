import random

import pytest
from pyspark.sql import functions as F

from treeline.llm import urls


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://Blog.example.org:443/a?b#c", "org,example,blog,/a?b"), ("http://user:pw@a.b", "b,a,/"), ("http://a.b?x", "b,a,/?x"), ("http://a.b./p", "b,a,/p"),
        ("no scheme", None), ("", None), (None, None), ("http:///p", None),
    ],
)
def test_canonical_key(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(urls.url_key("u")).first()[0] == key


def brute(rows, rules):
    out = []
    for page, url, key in rows:
        hits = [(len(p), i, a) for i, p, a in rules if key is not None and p is not None and key.startswith(p)]
        best = max(hits, default=(0, None, None))
        out.append((page, url, len(hits), best[1], best[2]))
    return sorted(out, key=str)


def check(spark, rows, rules, parts=None):
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'x' AS rule_id", "'y' AS key")
    keys = [(r.page_id, r.url, r.k) for r in pages.select("page_id", "url", urls.url_key("url").alias("k")).collect()]
    found = urls.match_rules(pages, spark.createDataFrame(rules, "rule_id bigint, prefix string, action string"), parts)
    assert sorted(map(tuple, found.collect()), key=str) == brute(keys, rules)


def test_nested_rules_against_brute_force(spark):
    draw = random.Random(4)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.org"]
    rows = [(i, f"http://{draw.choice(hosts)}/{draw.choice('pq')}/{draw.randrange(4)}") for i in range(300)]
    prefixes = ["", "com,", "com,a,", "com,a,/", "com,a,b,", "com,a,b,/p", "com,a,b,/p/1", "org,x,/q", "com,a,b,/p", "net,"]
    rules = [(i, p, draw.choice(["allow", "block"])) for i, p in enumerate(prefixes)]
    check(spark, rows, rules, parts=7)


def test_hot_key_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "http://hot.com/x")] * 500 + [(2, None), (None, "http://a.b/c"), (3, "junk"), (4, "http://a.b/" + "long/" * 20_000)]
    rules = [(1, "com,hot,", "block"), (2, "com,hot,/x", "allow"), (3, None, "block"), (4, "b,a,/long", "block")]
    check(spark, rows, rules, parts=5)
    check(spark, rows, [], parts=3)
    check(spark, [], rules)


def test_a_hot_key_is_spread(spark):
    keys = spark.range(4000).select(F.lit("com,hot,/x").alias("key"))
    bounds = urls._bounds(keys, 8)
    assert bounds.count(b"com,hot,/x") == 7
