import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from treeline.operators import graph, similarity, versions

EDGE = "source_id int, target_id int, edge_type string, weight double"
#: Two cycles, a loop, a diamond; 8 stands alone.
CYCLIC = [(1, 2), (2, 3), (3, 1), (4, 4), (5, 6), (6, 5), (1, 7), (2, 7), (1, 5)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, "Calls" if a < 5 else "Uses", 1.0) for a, b in CYCLIC], EDGE)


def brute(pairs, depth):
    out = {}
    for s in {a for a, _ in pairs}:
        todo, seen = deque([(s, 0)]), {}
        while todo:
            n, d = todo.popleft()
            for a, b in pairs:
                if a == n and b not in seen and d < depth:
                    seen[b] = d + 1
                    todo.append((b, d + 1))
        out |= {(s, n): d for n, d in seen.items()}
    return out


@pytest.mark.parametrize("depth", [1, 2, 10])
def test_closure_with_cycles(edges, depth):
    assert {(r.ancestor_id, r.descendant_id): r.hops for r in graph.reachability(edges, depth).collect()} == brute(CYCLIC, depth)


def test_cycles_and_paths(spark, edges):
    assert {(r.node_id, r.hops) for r in graph.cycles(edges).collect()} == {(1, 3), (2, 3), (3, 3), (4, 1), (5, 2), (6, 2)}
    nodes = lambda *x: spark.createDataFrame([(i,) for i in x], "node_id int")
    got = graph.paths_between(edges, nodes(3, 8), nodes(7, 5)).collect()
    assert {(r.start_id, r.target_id): r.path for r in got} == {(3, 7): [3, 1, 7], (3, 5): [3, 1, 5]}
    assert {r.neighbour_id for r in graph.callers(edges, nodes(7)).collect()} == {1, 2}
    assert {r.neighbour_id for r in graph.neighbours(edges, nodes(5), "both").collect()} == {1, 6}
    assert graph.reach(edges, nodes(8)).count() == 0 and graph.reach(edges, nodes(5), edge_types=["Calls"]).count() == 0


def test_long_chains_and_cycles_are_followed_to_the_end(spark):
    chain = spark.createDataFrame([(i, i + 1, "Calls", 1.0) for i in range(14)], EDGE)
    assert graph.reachability(chain).count() == 105 and graph.reachability(chain, 3).count() == 39
    ring = spark.createDataFrame([(i, (i + 1) % 12, "Calls", 1.0) for i in range(12)], EDGE)
    assert {(r.node_id, r.hops) for r in graph.cycles(ring).collect()} == {(i, 12) for i in range(12)}
    nodes = lambda *x: spark.createDataFrame([(i,) for i in x], "node_id int")
    (one,) = graph.paths_between(chain, nodes(0), nodes(14)).collect()
    assert one.path == list(range(15))
    none = graph.paths_between(chain, nodes(99), nodes(14))
    assert none.count() == 0 and none.columns == ["start_id", "target_id", "path"]


def test_update_equals_a_new_closure(spark):
    draw = random.Random(2)
    old = {(draw.randrange(15), draw.randrange(15)) for _ in range(25)}
    new = (old - set(list(old)[:5])) | {(draw.randrange(15), draw.randrange(15)) for _ in range(5)}
    frame = lambda e: spark.createDataFrame([(a, b, "Calls", 1.0) for a, b in sorted(e)], EDGE)
    got = graph.reachability_update(graph.reachability(frame(old)), frame(old), frame(new))
    assert {(r.ancestor_id, r.descendant_id): r.hops for r in got.collect()} == brute(sorted(new), 10)


def test_impact_and_invariants(spark, edges):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node_id int")
    got = {r.node_id: (r.dependents, r.severity) for r in graph.impact(edges, nodes, 10).collect()}
    assert got[7] == (3, "low") and got[4] == (0, "low") and got[5] == (4, "low")
    bad = spark.createDataFrame([(1, 9, "Calls", 1.0), (9, 1, "Calls", 1.0), (1, 2, "Calls", 1.5)], EDGE)
    assert sorted(r.why for r in graph.invalid_edges(bad, nodes).collect()) == ["no source", "no target", "weight"]


def test_calls_prefer_the_own_file_then_imports(spark):
    calls = spark.createDataFrame([("a", 1, "f"), ("a", 1, "g"), ("b", 2, "f"), ("b", 2, "none")], "file_id string, caller_id int, name string")
    symbols = spark.createDataFrame([("a", 10, "f"), ("c", 11, "f"), ("d", 9, "f"), ("c", 12, "g")], "file_id string, symbol_id int, name string")
    imports = spark.createDataFrame([("b", "c")], "file_id string, target_file string")
    assert {(r.source_id, r.name): r.target_id for r in graph.resolve_calls(calls, symbols, imports).collect()} == {(1, "f"): 10, (1, "g"): 12, (2, "f"): 11}
    assert {(r.source_id, r.name): r.target_id for r in graph.resolve_calls(calls, symbols).collect()}[2, "f"] == 9


def test_conflict_tiers(spark):
    changes = spark.createDataFrame([("f", "SignatureChange"), ("g", "Deletion"), ("h", "Addition"), ("i", "Deletion")], "name string, change string")
    calls = spark.createDataFrame([("x", "f"), ("y", "f"), ("x", "g")], "caller string, name string")
    deep = spark.createDataFrame([("f", 30)], "name string, n bigint")
    got = {r.name: (r.tier, r.confidence, r.severity) for r in versions.conflicts(changes, calls, deep).collect()}
    assert got == {"f": (3, 0.95, "high"), "g": (2, 0.9, "medium"), "i": (1, 0.6, "low")}
    assert {r.tier for r in versions.conflicts(changes).collect()} == {1}


def test_top_k(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assert [(r.vec_id, r.score) for r in similarity.search(df, [1.0, 0.0], k=3, least=0.5).collect()] == [(1, 1.0), (4, 1.0), (2, 0.6)]


def test_calls_are_resolved_without_pairs_of_callers_and_definitions(spark):
    n = 3000  # pairs would be 9 million
    calls = spark.range(n).selectExpr("cast(id AS string) AS file_id", "id AS caller_id", "if(id < 0, 'none', 'main') AS name")
    symbols = spark.range(n).selectExpr("cast(id + 1000 AS string) AS file_id", "id + 1000 AS symbol_id", "if(id < 0, 'none', 'main') AS name")
    imports = spark.range(n).selectExpr("cast(id AS string) AS file_id", "cast(id + 1500 AS string) AS target_file").where("target_file < '2000'")
    for given in (None, imports):
        found = graph.resolve_calls(calls, symbols, given)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Aggregate \[name#", plan)  # what meets the calls by name alone has a row for each name
        target = lambda i: i if i >= 1000 else i + 1500 if given is not None and str(i + 1500) < "2000" else 1000
        assert {(r.source_id, r.target_id) for r in found.collect()} == {(i, target(i)) for i in range(n)}


def test_cycles_leave_out_what_only_leads_to_them(spark, monkeypatch):
    edges = [(i, i // 2 + 1) for i in range(3, 400)] + [(1, 2), (2, 1), (2, 3), (-1, 1), (500, 501), (501, 501), (600, 601)]
    table = spark.createDataFrame(edges, "source_id int, target_id int").withColumn("edge_type", F.lit("Calls"))
    sizes, whole = [], graph.reachability
    monkeypatch.setattr(graph, "reachability", lambda e, depth=None: sizes.append(e.count()) or whole(e, depth))
    assert {(r.node_id, r.hops) for r in graph.cycles(table).collect()} == {(r.ancestor_id, r.hops) for r in whole(table).where("ancestor_id = descendant_id").collect()}
    assert sizes == [len(set(edges) & {(1, 2), (2, 1), (2, 3), (3, 2), (501, 501)})]


def test_calls_are_resolved_as_one_by_one_and_without_sorts_of_results(spark):
    from random import Random

    r = Random(3)
    defs = [(f"f{r.randrange(8)}", i, f"n{r.randrange(12)}") for i in r.sample(range(100), 25)]
    calls = [(f"f{r.randrange(8)}", r.randrange(6), f"n{r.randrange(14)}") for _ in range(120)]
    imports = [(f"f{r.randrange(8)}", f"f{r.randrange(8)}") for _ in range(10)]
    tables = [spark.createDataFrame(rows, schema) for rows, schema in ((calls, "file_id string, caller_id long, name string"), (defs, "file_id string, symbol_id long, name string"), (imports, "file_id string, target_file string"))]
    for given in ([], imports):
        wanted = {}
        for file, caller, name in calls:
            for near, files in enumerate(({file}, {t for f, t in given if f == file}, {d[0] for d in defs})):
                ids = [i for f, i, n in defs if n == name and f in files]
                if ids:
                    wanted[caller, name] = min(wanted.get((caller, name), (9, 0)), (near, min(ids)))
                    break
        found = graph.resolve_calls(*tables[: 2 + bool(given)])
        assert len(wanted) > 30 and {(x.source_id, x.name): x.target_id for x in found.collect()} == {k: v[1] for k, v in wanted.items()} and found.count() == len(wanted)
        assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
