"""Operator 3: URL filters, by a sort-merge range join.

A URL's canonical key is its host, labels reversed, then its path and query:
https://Blog.example.org:443/a?b#c becomes org,example,blog,/a?b. A rule is a
prefix of such keys, so it stands for the interval of keys that begin with it:
`org,example,` is the domain with all its subdomains, `org,example,/a` one
site's paths. Two such intervals are nested or apart. Pages and rules are cut
into the same key ranges, sorted together, and swept once with a stack of the
rules that are open: the stack's depth is the number of rules that match, its
top is the most specific one.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.shared import read

#: (rule_id, prefix, action): hosts and sites that a crawl leaves out, with exceptions inside them.
RULES = [
    (1, "org,example,spam-farm,", "block"),
    (2, "com,example,cheap-pills,", "block"),
    (3, "com,example,cheap-pills,/en/4", "allow"),
    (4, "com,example,casino-win,", "block"),
    (5, "net,example,", "allow"),
    (6, "net,example,blog,", "block"),
    (7, "net,example,blog,/en/", "allow"),
    (8, "org,example,/private", "block"),
    (9, "com,example,www,", "allow"),
    (10, "com,example,", "allow"),
    (11, "com,example,m,", "block"),
    (12, "", "allow"),
]

_PATTERN = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^#]*)"


def url_key(url: Column | str) -> Column:
    """The canonical key; null for a null or empty URL and for one without a scheme or host."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_replace(F.regexp_extract(url, _PATTERN, 1), r"\.$", ""))
    rest = F.regexp_extract(url, _PATTERN, 2)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    path = F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.length(host) > 0, F.concat(labels, F.lit(","), path))


def _bounds(keys: DataFrame, parts: int) -> list[bytes]:
    """At most parts - 1 keys that cut a sample of the keys into even ranges; repeats mark hot keys."""
    fraction = min(1.0, 200.0 * parts / max(1, keys.count()))
    # about 200 keys a range, whatever the table's size
    sample = sorted(bytes(r.k) for r in keys.sample(fraction, seed=7).select(F.encode("key", "utf-8").alias("k")).collect())
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []


def match_rules(pages: DataFrame, rules: DataFrame, parts: int | None = None) -> DataFrame:
    """(page_id, url, n_rules, rule_id, action) of every page.

    pages: page_id, url; rules: rule_id BIGINT, prefix, action. The most
    specific rule decides: the longest prefix, of equal prefixes the largest
    rule_id. n_rules counts all that match. A page without a key or without a
    match has n_rules 0 and null rule_id and action; rules with a null prefix
    match nothing, the empty prefix matches every page with a key. Rows repeat
    as they do in pages; further columns are left out. An empty table on either
    side is no case of its own.

    No range is wider than its share: a key that more rows have than a range
    should hold gets several parts, each with all the rules around it.
    """
    spark = pages.sparkSession
    # at least: a few thousand rows a task are too few to be worth one
    keyed = pages.select("page_id", "url", url_key("url").alias("key"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(keyed.where("key IS NOT NULL"), parts)
    cuts = sorted(set(bounds))
    copies = [1] + [bounds.count(c) for c in cuts]  # ranges 0 .. len(cuts); the range from a hot key on gets more parts
    first = [sum(copies[:i]) for i in range(len(copies))]

    at, wide, begins = np.array([c.decode("utf-8", "surrogatepass") for c in cuts], object), np.array(copies), np.array(first)

    @F.arrow_udf("int")
    def place_page(key: pa.Array, salt: pa.Array) -> pa.Array:
        """One part of its range. Strings compare by code points, as their UTF-8 does."""
        lo = np.searchsorted(at, key.to_numpy(zero_copy_only=False), "right") if len(at) else np.zeros(len(key), np.int64)
        return pa.array((begins[lo] + salt.to_numpy() % wide[lo]).astype(np.int32))

    @F.pandas_udf("array<int>")
    def place_rule(prefix: pd.Series) -> pd.Series:
        """All parts of all ranges that its interval meets."""
        out = []
        for k in prefix:
            k = k.encode("utf-8", "surrogatepass")
            lo, hi = bisect.bisect_right(cuts, k), bisect.bisect_left(cuts, k + b"\xff")
            out.append([p for i in range(lo, hi + 1) for p in range(first[i], first[i] + copies[i])])
        return pd.Series(out)

    spec = "page_id {}, url string, key string, rule_id bigint, action string".format(pages.schema["page_id"].dataType.simpleString())
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)).cast("int")
    left = keyed.where("key IS NOT NULL").select("page_id", "url", "key", F.lit(None).cast("bigint").alias("rule_id"), F.lit(None).cast("string").alias("action"), F.lit(1).alias("side"),
                                                place_page(F.col("key"), salt).alias("part"))
    right = rules.where("prefix IS NOT NULL").select(F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("prefix").alias("key"),
                                                    F.col("rule_id").cast("bigint").alias("rule_id"), "action", F.lit(0).alias("side"),
                                                    F.explode(place_rule(F.col("prefix"))).alias("part"))
    # rules come before the pages of their key, shorter prefixes sort before longer ones
    sorted_rows = left.unionByName(right).repartition(max(1, sum(copies)), "part").sortWithinPartitions("part", "key", "side", "rule_id")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Goes from event to event - a rule that opens, a rule that closes, a new range; the pages between two of them have the same stack."""
        stack: list[tuple[str, int, str]] = []
        now = None
        for batch in batches:
            page, url, key, rule, action, side, part = (batch.column(i) for i in range(7))
            keys, parts_of, opens = key.to_numpy(zero_copy_only=False), part.to_numpy(), np.flatnonzero(side.to_numpy() == 0)
            edges = np.append(np.flatnonzero(np.diff(parts_of)) + 1, len(keys))
            depth, top, names = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [(None, None)]
            i = 0
            while i < len(keys):
                if parts_of[i] != now:
                    stack, now = [], parts_of[i]
                while stack and not keys[i].startswith(stack[-1][0]):
                    stack.pop()
                next_open = np.searchsorted(opens, i)
                if next_open < len(opens) and opens[next_open] == i:
                    stack.append((keys[i], rule[i].as_py(), action[i].as_py()))
                    depth[i] = -1
                    i += 1
                    continue
                stop = min(int(edges[np.searchsorted(edges, i, "right")]), int(opens[next_open]) if next_open < len(opens) else len(keys))
                if stack:  # keys that begin with the top stand together: the first that doesn't closes it
                    lo, hi = i, stop
                    while lo < hi:
                        mid = (lo + hi) // 2
                        lo, hi = (mid + 1, hi) if keys[mid].startswith(stack[-1][0]) else (lo, mid)
                    stop = lo
                    names.append(stack[-1][1:])
                    top[i:stop] = len(names) - 1
                depth[i:stop] = len(stack)
                i = stop
            at = pa.array(np.flatnonzero(depth >= 0))
            of = pa.array(top).take(at)
            rules_of, actions = pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.string())
            yield pa.RecordBatch.from_arrays([page.take(at), url.take(at), pa.array(depth).take(at), rules_of.take(of), actions.take(of)], ["page_id", "url", "n_rules", "rule_id", "action"])

    out = spec.replace("key string", "n_rules bigint")
    matched = sorted_rows.mapInArrow(sweep, out)
    rest = keyed.where("key IS NULL").select("page_id", "url", F.lit(0).cast("bigint").alias("n_rules"), F.lit(None).cast("bigint").alias("rule_id"), F.lit(None).cast("string").alias("action"))
    return matched.unionByName(rest)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What RULES say of every page of the table: `match_rules`."""
    return match_rules(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule_id bigint, prefix string, action string"))


_VALUES = ", ".join(f"({i}, '{p}', '{a}')" for i, p, a in RULES)
OP3_SQL = rf"""
WITH rules(rule_id, prefix, action) AS (VALUES {_VALUES}),
parts AS (
  SELECT page_id, url, lower(regexp_replace(regexp_extract(url, '{_PATTERN}', 1), '\.$', '')) AS host,
         regexp_extract(url, '{_PATTERN}', 2) AS rest FROM pages),
keyed AS (
  SELECT page_id, url, CASE WHEN length(host) > 0 THEN
    array_to_string(list_reverse(string_split(host, '.')), ',') || ',' || CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END END AS key
  FROM parts)
SELECT page_id, any_value(url) AS url, count(rule_id) AS n_rules,
       CAST(arg_max(rule_id, length(prefix) * 1000 + rule_id) AS BIGINT) AS rule_id,
       arg_max(action, length(prefix) * 1000 + rule_id) AS action
FROM keyed LEFT JOIN rules ON starts_with(key, prefix)
GROUP BY page_id
"""
