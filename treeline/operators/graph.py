"""Graph queries over edge tables (source_id, target_id, edge_type, weight)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.storage import cut

EDGE_TYPES = ("Calls", "Imports", "Inherits", "Implements", "Uses", "DependsOn", "References", "Contains")
#: From so many dependents on an impact has this severity.
SEVERITY = ((100, "critical"), (20, "high"), (5, "medium"), (0, "low"))


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "out", edge_types: list[str] | None = None) -> DataFrame:
    """(node_id, neighbour_id, edge_type) of nodes (node_id) in one direction, or in both."""
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(edge_types))
    out = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbour_id"), "edge_type")
    back = edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbour_id"), "edge_type")
    way = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return way.join(nodes.select("node_id").distinct(), "node_id", "left_semi").distinct()


def callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return neighbours(edges, nodes, "in", ["Calls"])


def callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return neighbours(edges, nodes, "out", ["Calls"])


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, reverse: bool = False, edge_types: list[str] | None = None) -> DataFrame:
    """(start_id, node_id, hops): what starts (node_id) reach, at the least number of hops; within max_depth where it is given.

    A fix-point: each round joins the newest rows with the edges and keeps what
    wasn't there, so cycles end. A start reaches itself only around a cycle.
    """
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(edge_types))
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    step = edges.select(F.col(a).alias("at"), F.col(b).alias("next")).distinct()
    newest = starts.select(F.col("node_id").alias("start_id"), F.col("node_id")).distinct()
    done = None
    for hops in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        found = newest.join(step, F.col("node_id") == F.col("at")).select("start_id", F.col("next").alias("node_id")).distinct()
        if done is not None:
            found = found.join(done, ["start_id", "node_id"], "left_anti")
        newest = cut(found.select("start_id", "node_id", F.lit(hops).alias("hops")))
        if newest.isEmpty():
            break
        done = newest if done is None else done.unionByName(newest)
    if done is None:
        return newest.select("start_id", "node_id", F.lit(0).alias("hops")).where("false")
    return done


def dependencies(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, edge_types: list[str] | None = None) -> DataFrame:
    return reach(edges, starts, max_depth, False, edge_types)


def reverse_dependencies(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, edge_types: list[str] | None = None) -> DataFrame:
    return reach(edges, starts, max_depth, True, edge_types)


def reachability(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The closure (ancestor_id, descendant_id, hops) from all sources."""
    starts = edges.select(F.col("source_id").alias("node_id")).distinct()
    return reach(edges, starts, max_depth).select(F.col("start_id").alias("ancestor_id"), F.col("node_id").alias("descendant_id"), "hops")


def reachability_update(closure: DataFrame, old_edges: DataFrame, new_edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The closure of new_edges: only ancestors of changed edges' sources are worked out again."""
    both = ["source_id", "target_id"]
    changed = old_edges.select(*both).exceptAll(new_edges.select(*both)).union(new_edges.select(*both).exceptAll(old_edges.select(*both)))
    touched = changed.select(F.col("source_id").alias("node_id")).distinct()
    above = closure.join(touched, F.col("descendant_id") == F.col("node_id")).select(F.col("ancestor_id").alias("node_id"))
    again = cut(touched.union(above).distinct())
    kept = closure.join(again, F.col("ancestor_id") == F.col("node_id"), "left_anti")
    fresh = reach(new_edges, again, max_depth).select(F.col("start_id").alias("ancestor_id"), F.col("node_id").alias("descendant_id"), "hops")
    return kept.unionByName(fresh)


def is_reachable(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (ancestor_id, descendant_id) that the closure holds."""
    return pairs.join(closure.select("ancestor_id", "descendant_id"), ["ancestor_id", "descendant_id"], "left_semi")


def paths_between(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start_id, target_id, path): one shortest path of each pair, the least of several in the order of ids."""
    step = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("next")).distinct()
    goals = targets.select(F.col("node_id").alias("next")).distinct()
    rows = starts.select(F.col("node_id").alias("start_id"), F.col("node_id").alias("at"), F.array("node_id").alias("path")).distinct()
    found, seen = rows.select("start_id", F.col("at").alias("target_id"), "path").where("false"), None
    for _ in itertools.count() if max_depth is None else range(max_depth):
        rows = rows.join(step, "at").where(~F.array_contains("path", F.col("next")))
        rows = rows.select("start_id", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        rows = rows.groupBy("start_id", "at").agg(F.min("path").alias("path"))
        if seen is not None:
            rows = rows.join(seen, ["start_id", "at"], "left_anti")
        rows = cut(rows)
        if rows.isEmpty():
            break
        seen = rows.select("start_id", "at") if seen is None else seen.unionByName(rows.select("start_id", "at"))
        hit = rows.join(goals, F.col("at") == F.col("next"), "left_semi").select("start_id", F.col("at").alias("target_id"), "path")
        found = found.unionByName(hit)
    return found


def cycles(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node_id, hops): nodes on a cycle and the length of the shortest one through them.

    Edges that can't be on a cycle go first, or the closure of all that leads to
    one would be worked out as well.
    """
    return reachability(_inner(edges), max_depth).where("ancestor_id = descendant_id").select(F.col("ancestor_id").alias("node_id"), "hops")


def _inner(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have both an edge that comes in and one that goes out, again and again until all have: no more rounds than the longest path has nodes."""
    left = cut(edges.select("source_id", "target_id").distinct(), "inner")
    n = left.count()
    while n:
        ins, outs = left.select(F.col("target_id").alias("source_id")).distinct(), left.select(F.col("source_id").alias("target_id")).distinct()
        left = cut(left.join(ins, "source_id", "left_semi").join(outs, "target_id", "left_semi").select("source_id", "target_id"), "inner")
        before, n = n, left.count()
        if n == before:
            break
    return left


def impact(edges: DataFrame, nodes: DataFrame, max_depth: int = 3) -> DataFrame:
    """(node_id, dependents, severity) by the number of nodes that depend on each."""
    found = reverse_dependencies(edges, nodes, max_depth).where("start_id <> node_id").groupBy(F.col("start_id").alias("node_id")).agg(F.count_distinct("node_id").alias("dependents"))
    out = nodes.select("node_id").distinct().join(found, "node_id", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)).cast("bigint"))
    level = F.lit("low")
    for least, name in reversed(SEVERITY[:-1]):
        level = F.when(F.col("dependents") >= least, name).otherwise(level)
    return out.withColumn("severity", level)


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Call edges: calls (file_id, caller_id, name) joined with symbols (file_id, symbol_id, name).

    A definition in the caller's file comes first, then one in an imported file
    (imports: file_id, target_file), then any other; of several the least id.
    Definitions come down to the least of a file and of all before they meet
    the calls, so that a name that many files define and call makes no pairs of
    these.
    """
    own = symbols.groupBy("file_id", "name").agg(F.min("symbol_id").alias("id"))
    any_ = symbols.groupBy("name").agg(F.min("symbol_id").alias("any_id"))
    found = calls.select("file_id", "caller_id", "name").distinct().join(own.withColumnRenamed("id", "own_id"), ["file_id", "name"], "left")
    seen = ["own_id", "any_id"]
    if imports is not None:
        i = imports.select("file_id", "target_file").distinct().join(own.withColumnRenamed("file_id", "target_file"), "target_file")
        found = found.join(i.groupBy("file_id", "name").agg(F.min("id").alias("import_id")), ["file_id", "name"], "left")
        seen.insert(1, "import_id")
    found = found.join(any_, "name")
    best = F.coalesce(*map(F.min, seen)).alias("target_id")  # of numbers, which a hash keeps without a sort
    return found.groupBy(F.col("caller_id").alias("source_id"), "name").agg(best).select("source_id", "target_id", F.lit("Calls").alias("edge_type"), "name")


def contains_edges(symbols: DataFrame) -> DataFrame:
    """Contains edges from each symbol's nearest enclosing symbol of its file; symbols: file_id, symbol_id, pre, end_pre."""
    a, b = symbols.alias("a"), symbols.alias("b")
    pairs = b.join(a, (F.col("a.file_id") == F.col("b.file_id")) & (F.col("a.pre") < F.col("b.pre")) & (F.col("b.pre") <= F.col("a.end_pre")))
    best = pairs.groupBy(F.col("b.symbol_id").alias("target_id")).agg(F.max_by("a.symbol_id", "a.pre").alias("source_id"))
    return best.select("source_id", "target_id", F.lit("Contains").alias("edge_type"))


def invalid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that break an invariant: an end that isn't a node, or a weight outside [0, 1]."""
    ids = nodes.select(F.col("node_id").alias("id")).distinct()
    ends = edges.join(ids.alias("s"), F.col("source_id") == F.col("s.id"), "left").join(ids.alias("t"), F.col("target_id") == F.col("t.id"), "left")
    why = F.when(F.col("s.id").isNull(), "no source").when(F.col("t.id").isNull(), "no target").when(~F.col("weight").between(0, 1), "weight")
    return ends.withColumn("why", why).where("why IS NOT NULL").select("source_id", "target_id", "edge_type", "why")
