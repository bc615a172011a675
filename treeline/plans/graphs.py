"""Graphs, versions and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.operators import graph, similarity, symbols, versions
from treeline.plans.registry import query
from treeline.sources import trees
from treeline.storage import cut, read

#: The graph's edges by type.
E = """WITH RECURSIVE e AS (
SELECT 'region:' || n_regionkey AS s, 'nation:' || n_nationkey AS t, 'Contains' AS k FROM nation
UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'Contains' FROM customer
UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'Contains' FROM supplier
UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'Contains' FROM orders
UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'Uses' FROM lineitem
UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'DependsOn' FROM lineitem)
"""


def _ids(nodes, kind):
    return nodes.where(F.col("node_type") == kind).select("node_id")


@query("graph_neighbours", E + "SELECT s AS node_id, t AS neighbour_id, k AS edge_type FROM e WHERE s LIKE 'nation:%' UNION ALL SELECT t, s, k FROM e WHERE t LIKE 'nation:%'")
def graph_neighbours(spark, sf_dir):
    nodes, edges = trees.graph(spark, sf_dir)
    return graph.neighbours(edges, _ids(nodes, "nation"), "both")


@query("graph_dependencies_k", E + ", r AS (SELECT s AS start_id, t AS node_id, 1 AS hops FROM e WHERE s LIKE 'region:%' UNION ALL SELECT start_id, t, hops + 1 FROM r JOIN e ON s = node_id WHERE hops < 3 AND k = 'Contains') SELECT start_id, node_id, CAST(min(hops) AS INT) AS hops FROM r GROUP BY 1, 2")
def graph_dependencies_k(spark, sf_dir):
    nodes, edges = trees.graph(spark, sf_dir)
    return graph.dependencies(edges, _ids(nodes, "region"), 3, ["Contains"])


@query("graph_reverse_k", E + ", r AS (SELECT t AS start_id, s AS node_id, 1 AS hops FROM e WHERE t LIKE 'supplier:%' UNION ALL SELECT start_id, s, hops + 1 FROM r JOIN e ON t = node_id WHERE hops < 2 AND k <> 'Uses') SELECT start_id, node_id, CAST(min(hops) AS INT) AS hops FROM r GROUP BY 1, 2")
def graph_reverse_k(spark, sf_dir):
    nodes, edges = trees.graph(spark, sf_dir)
    return graph.reverse_dependencies(edges, _ids(nodes, "supplier"), 2, ["Contains", "DependsOn"])


@query("graph_path_between", "SELECT 'region:' || n_regionkey AS start_id, 'supplier:' || s_suppkey AS target_id, 'region:' || n_regionkey || '>nation:' || n_nationkey || '>supplier:' || s_suppkey AS path FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def graph_path_between(spark, sf_dir):
    nodes, edges = trees.graph(spark, sf_dir)
    found = graph.paths_between(edges.where("edge_type = 'Contains'"), _ids(nodes, "region"), _ids(nodes, "supplier"))
    return found.select("start_id", "target_id", F.array_join("path", ">").alias("path"))


_CLOSURE = ", r AS (SELECT s AS ancestor_id, t AS descendant_id, 1 AS hops FROM e WHERE k = 'Contains' UNION ALL SELECT ancestor_id, t, hops + 1 FROM r JOIN e ON s = descendant_id WHERE k = 'Contains')"


@query("reachability", E + _CLOSURE + " SELECT * FROM r")
def reachability(spark, sf_dir):
    return graph.reachability(trees.graph(spark, sf_dir)[1].where("edge_type = 'Contains'"))


@query("reachability_update", E + _CLOSURE.replace("FROM e", "FROM (SELECT * FROM e WHERE t NOT LIKE 'supplier:%') e").replace("JOIN e ON", "JOIN (SELECT * FROM e WHERE t NOT LIKE 'supplier:%') e ON") + " SELECT * FROM r")
def reachability_update(spark, sf_dir):
    """The closure after all edges to suppliers have gone, brought up to date from the one before."""
    old = trees.graph(spark, sf_dir)[1].where("edge_type = 'Contains'")
    return graph.reachability_update(cut(graph.reachability(old), "closure"), old, old.where("target_id NOT LIKE 'supplier:%'"))


@query("reachable_pairs", "SELECT DISTINCT 'region:' || n_regionkey AS ancestor_id, 'customer:' || c_custkey AS descendant_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = c_custkey % 5")
def reachable_pairs(spark, sf_dir):
    """Of one guess for each customer, the region with its number's remainder, those that hold."""
    closure = graph.reachability(trees.graph(spark, sf_dir)[1].where("edge_type = 'Contains'"))
    pairs = read(spark, sf_dir, "customer").select(F.concat(F.lit("region:"), (F.col("c_custkey") % 5).cast("string")).alias("ancestor_id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("descendant_id"))
    return graph.is_reachable(closure, pairs)


_CALLS = "WITH RECURSIVE e AS (SELECT p.p_partkey AS s, q.p_partkey AS t FROM part p JOIN part q ON q.p_partkey = p.p_size)"


def _call_edges(spark, sf_dir):
    """Calls between the parts' functions, resolved by name."""
    code = trees.part_code(spark, sf_dir)
    found = symbols.extract(code, wanted=frozenset(("def", "call")), last=True)
    found = cut(found.select("file_id", "what", "name", F.col("file_id").cast("bigint").alias("id")), "symbols")
    calls = found.where("what = 'call'").select("file_id", F.col("id").alias("caller_id"), "name")
    defs = found.where("what = 'def'").select("file_id", F.col("id").alias("symbol_id"), "name")
    return cut(graph.resolve_calls(calls, defs), "calls")


@query("calls_resolved", _CALLS + " SELECT s AS source_id, t AS target_id, 'part_' || t AS name FROM e")
def calls_resolved(spark, sf_dir):
    return _call_edges(spark, sf_dir).select("source_id", "target_id", "name")


@query("graph_callers", _CALLS + " SELECT t AS node_id, s AS neighbour_id, 'Calls' AS edge_type FROM e")
def graph_callers(spark, sf_dir):
    edges = _call_edges(spark, sf_dir)
    return graph.callers(edges, edges.select(F.col("target_id").alias("node_id")))


@query("graph_callees", _CALLS + " SELECT s AS node_id, t AS neighbour_id, 'Calls' AS edge_type FROM e")
def graph_callees(spark, sf_dir):
    edges = _call_edges(spark, sf_dir)
    return graph.callees(edges, edges.select(F.col("source_id").alias("node_id")))


@query("cycles", _CALLS + ", r AS (SELECT s AS a, t AS b, 1 AS hops FROM e UNION ALL SELECT a, t, hops + 1 FROM r JOIN e ON s = b WHERE hops < 51) SELECT a AS node_id, CAST(min(hops) AS INT) AS hops FROM r WHERE a = b GROUP BY a")
def cycles(spark, sf_dir):
    """Sizes, and so callees, go up to 50: no shortest cycle is longer."""
    return graph.cycles(_call_edges(spark, sf_dir))


@query("impact_severity", "SELECT 'supplier:' || s_suppkey AS node_id, coalesce(n, 0) AS dependents, CASE WHEN n >= 100 THEN 'critical' WHEN n >= 20 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS severity FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey")
def impact_severity(spark, sf_dir):
    nodes, edges = trees.graph(spark, sf_dir)
    return graph.impact(edges.where("edge_type = 'DependsOn'"), _ids(nodes, "supplier"))


@query("contains_edges", "SELECT 'order:' || o_orderkey AS target_id, 'customer:' || c_custkey AS source_id FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_custkey FROM customer")
def contains_edges(spark, sf_dir):
    """Each order's and customer's nearest enclosing symbol in its tree; a nation is one of its customer's tree."""
    nodes = trees.commerce(spark, sf_dir).where("kind IN ('nation', 'customer', 'order')")
    own = F.concat("kind", F.lit(":"), F.coalesce("orderkey", "custkey").cast("string"))
    return graph.contains_edges(nodes.select("file_id", own.alias("symbol_id"), "pre", "end_pre")).select("source_id", "target_id")


@query("invalid_edges", E + "SELECT s AS source_id, t AS target_id, k AS edge_type, 'no target' AS why FROM e WHERE t LIKE 'supplier:%'")
def invalid_edges(spark, sf_dir):
    """What is wrong with the edges once the suppliers are gone."""
    nodes, edges = trees.graph(spark, sf_dir)
    return graph.invalid_edges(edges, nodes.where("node_type <> 'supplier'"))


# --- versions ---------------------------------------------------------------


@query("content_dedup", "SELECT sha256(text) AS content_hash, min(doc_id) AS file_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_dedup(spark, sf_dir):
    return versions.dedup_content(trees.versions(spark, sf_dir)[0])


_NEW = "WITH n AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' edited' ELSE text END AS text FROM documents WHERE source <> 'src3') "


@query("incremental_changed", _NEW + "SELECT d.doc_id AS file_id, CASE WHEN n.doc_id IS NULL THEN 'removed' WHEN n.text = d.text THEN 'same' ELSE 'changed' END AS change FROM documents d LEFT JOIN n USING (doc_id)")
def incremental_changed(spark, sf_dir):
    hashed = [df.select("file_id", versions.content_hash("content").alias("content_hash")) for df in trees.versions(spark, sf_dir)]
    return versions.changed_files(*hashed)


@query("unseen_sources", _NEW + "SELECT doc_id AS file_id, sha256(text) AS content_hash FROM n WHERE text NOT IN (SELECT text FROM documents)")
def unseen_sources(spark, sf_dir):
    """What of the new version has to be parsed again: contents that the store of the old one doesn't hold."""
    old, new = trees.versions(spark, sf_dir)
    return versions.unseen(new, old.select(versions.content_hash("content").alias("content_hash"))).select("file_id", "content_hash")


_ORDERS = """WITH o AS (SELECT o_orderkey AS name, o_orderpriority AS signature FROM orders WHERE o_orderstatus <> 'O'),
n AS (SELECT o_orderkey AS name, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || '!' ELSE o_orderpriority END AS signature FROM orders WHERE o_orderpriority <> '5-LOW'),
d AS (SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'Addition' WHEN n.name IS NULL THEN 'Deletion' WHEN o.signature <> n.signature THEN 'SignatureChange' END AS change,
  o.signature AS old_signature, n.signature AS new_signature FROM o FULL JOIN n ON o.name = n.name)
"""


@query("symbol_diff", _ORDERS + "SELECT * FROM d WHERE change IS NOT NULL")
def symbol_diff(spark, sf_dir):
    return versions.symbol_diff(*trees.order_versions(spark, sf_dir))


@query("graph_diff", _ORDERS + "SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)")
def graph_diff(spark, sf_dir):
    return versions.table_diff(*trees.order_versions(spark, sf_dir))


@query("overlay_merge", _ORDERS + "SELECT * FROM o WHERE name NOT IN (SELECT name FROM n) AND signature <> '1-URGENT' UNION ALL SELECT * FROM n")
def overlay_merge(spark, sf_dir):
    base, delta = trees.order_versions(spark, sf_dir)
    return versions.overlay(base, delta, base.where("signature = '1-URGENT'"), ["name"])


@query(
    "conflict_tiers",
    _ORDERS + """, x AS (SELECT name, change, CASE WHEN n >= 3 THEN 3 WHEN n > 0 THEN 2 ELSE 1 END AS tier, coalesce(n, 0) AS callers FROM d LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = name WHERE change <> 'Addition')
SELECT name, change, tier, CASE tier WHEN 1 THEN 0.6 WHEN 2 THEN 0.9 ELSE 0.95 END AS confidence, callers, CASE WHEN callers >= 20 THEN 'high' WHEN callers > 0 THEN 'medium' ELSE 'low' END AS severity FROM x""".replace("THEN 0.6", "THEN CAST(0.6 AS DOUBLE)").replace("THEN 0.9 ", "THEN CAST(0.9 AS DOUBLE) ").replace("ELSE 0.95", "ELSE CAST(0.95 AS DOUBLE)"),
)
def conflict_tiers(spark, sf_dir):
    """Changed orders, called by the parts of their lines; from three parts on something depends on them."""
    calls = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller"), F.col("l_orderkey").alias("name"))
    deep = calls.groupBy("name").agg(F.count_distinct("caller").alias("n")).where("n >= 3")
    return versions.conflicts(versions.symbol_diff(*trees.order_versions(spark, sf_dir)), calls, deep)


# --- similarity -------------------------------------------------------------


def _means(vectors):
    """(query_id, embedding): the mean vector of each label, a few rows whatever the table's size."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 4).alias("x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return parts.groupBy(F.col("label").alias("query_id")).agg(listed.alias("embedding"))


_MEANS = """WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT label, i, round(avg(x), 4) AS x FROM p GROUP BY label, i), q AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM m GROUP BY label),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, q)
"""


@query("similarity_topk", _MEANS + "SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10")
def similarity_topk(spark, sf_dir):
    """The ten vectors most like each label's mean."""
    vectors = read(spark, sf_dir, "embeddings")
    return similarity.search_many(vectors, _means(vectors))


@query("similarity_min", _MEANS + "SELECT query_id, vec_id, score FROM s WHERE score >= 0.3")
def similarity_min(spark, sf_dir):
    """All vectors that are like a label's mean to a least degree."""
    vectors = read(spark, sf_dir, "embeddings")
    return similarity.scores(vectors, _means(vectors), 0.3)
