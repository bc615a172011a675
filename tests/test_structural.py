"""Rules as plans over the node table give what the interpreter gives over the tree."""

import pathlib
import random
import re

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from treeline import storage
from treeline.model import NODE, Node, Tree
from treeline.operators import labels, scan, structural
from treeline.operators.rules import from_dict
from treeline.plans.catalogue import QUERIES

KINDS = "abc"


def random_tree(seed, n):
    """A tree of one character a leaf, with kinds, fields and unnamed nodes at random."""
    draw = random.Random(seed)
    source, at = "xyz" * (n // 3 + 1), 0

    def grow(left, depth):
        nonlocal at
        node = Node(draw.choice(KINDS), at, at, named=draw.random() < 0.8, field=draw.choice([None, None, "f", "g"]))
        while left and depth < 6 and draw.random() < 0.7:
            child, left = grow(left - 1, depth + 1)
            node.add(child)
        if not node.children:
            at += 1
        node.end = at
        return node, left

    root, _ = grow(n, 0)
    return Tree(source[:at], root, "json")


LEAF = [{"kind": "a"}, {"kind": "b"}, {"regex": "x"}, {"nthChild": "2n+1"}, {"nthChild": {"position": 1, "ofRule": {"kind": "a"}, "reverse": True}}]
STOPS = ["neighbor", "end", {"kind": "c"}]


@st.composite
def specs(draw, depth=2):
    inner = specs(depth=depth - 1) if depth else st.sampled_from(LEAF)
    what = draw(st.sampled_from(["leaf", "all", "any", "not", "inside", "has", "precedes", "follows"]))
    if what == "leaf" or not depth:
        return draw(st.sampled_from(LEAF))
    if what in ("all", "any"):
        return {what: [draw(inner), draw(inner)]}
    if what == "not":
        return {"not": draw(inner)}
    spec = {k: v for k, v in draw(st.sampled_from(LEAF)).items()} | {"stopBy": draw(st.sampled_from(STOPS))}
    if what in ("inside", "has") and draw(st.booleans()):
        spec["field"] = "f"
    return {"all": [{what: spec}, draw(inner)]}


@pytest.fixture(scope="module")
def forest(spark):
    trees = {f"t{i}": random_tree(i, 25) for i in range(12)}
    rows = [r for k, t in trees.items() for r in t.rows(k)]
    return trees, spark.createDataFrame(rows, NODE).cache()


@settings(max_examples=25, deadline=None)
@given(specs())
@example({"any": [{"kind": "a"}, {"not": {"regex": "x"}}]})
@example({"all": [{"has": {"kind": "a", "stopBy": {"kind": "c"}}}, {"kind": "b"}]})
@example({"all": [{"inside": {"kind": "a", "stopBy": "neighbor", "field": "f"}}, {"kind": "a"}]})
@example({"all": [{"inside": {"kind": "a", "stopBy": "end", "field": "f"}}, {"kind": "b"}]})
@example({"all": [{"has": {"kind": "a", "stopBy": {"kind": "b"}, "field": "f"}}, {"kind": "c"}]})
def test_plans_equal_the_interpreter(forest, spec):
    trees, nodes = forest
    rule = from_dict({"id": "t", "language": "json", "rule": {"all": [spec]}}, need_kinds=False)
    want = {(k, n.pre) for k, t in trees.items() for n in t.nodes if rule.match(n) is not None}
    assert {(r.file_id, r.pre) for r in structural.select(nodes, {"all": [spec]}).collect()} == want


BARE = [
    {"has": {"kind": "a"}}, {"has": {"kind": "a", "stopBy": "end"}}, {"has": {"regex": "x", "stopBy": {"kind": "c"}}}, {"has": {"kind": "b", "field": "f"}}, {"has": {"kind": "b", "field": "f", "stopBy": "end"}},
    {"any": [{"has": {"kind": "a"}}, {"kind": "b"}, {"has": {"kind": "c", "stopBy": "end"}}]}, {"matches": "u"},
]


@pytest.mark.parametrize("spec", BARE)
def test_a_rule_that_is_nothing_but_has_gives_what_it_finds(forest, spec):
    trees, nodes = forest
    utils = {"u": {"any": [{"kind": "c"}, {"has": {"kind": "b", "stopBy": "end"}}]}}
    rule = from_dict({"id": "t", "language": "json", "rule": spec, "utils": utils}, need_kinds=False)
    want = sorted((k, found[0].pre) for k, t in trees.items() for n in t.nodes if (found := rule.match(n)) is not None)
    assert sorted((r.file_id, r.pre) for r in structural.select(nodes, spec, utils).collect()) == want


def test_regexes_see_long_nodes(spark):
    """Inner nodes beyond what a row keeps: the node table finds what the interpreter finds."""
    from treeline.operators.rules import load

    long = "<div><p>" + "word " * 2000 + "end</p></div>"
    sources = spark.createDataFrame([("1", "a.html", "html", long), ("2", "b.html", "html", "<div><p>end</p></div>"), ("3", "c.html", "html", "<p>x</p>")], "file_id string, path string, language string, content string")
    nodes = labels.parse_sources(sources)
    assert nodes.where("file_id = '1' AND parent >= 0 AND kind = 'element' AND text IS NULL").count() == 2
    spec = {"kind": "element", "regex": "end</p>"}
    rule = load("id: t\nlanguage: html\nrule: {kind: element, regex: 'end</p>'}\n")
    want = {(r.file_id, r.pre, r.text) for r in scan.scan_sources(sources, rule, report_unused=False).collect()}
    assert {(r.file_id, r.pre, r.text) for r in structural.select(nodes, spec).collect()} == want and len(want) == 4
    assert {(r.file_id, r.pre) for r in scan.scan_nodes(nodes, {"t": spec}).collect()} == {w[:2] for w in want}
    assert {len(r.text) for r in structural.with_text(structural.select(nodes, {"kind": "element"}), nodes).where("file_id = '1'").collect()} == {len(long), len(long) - 11}


def test_labels_of_a_deep_tree(spark):
    rows = [("f", i, i - 1 if i else None, 0) for i in range(100)]
    got = labels.label_tree(spark.createDataFrame(rows, "file_id string, id int, parent_id int, ord int")).collect()
    assert {r.id: (r.pre, r.end_pre, r.depth) for r in got} == {i: (i, 99, i) for i in range(100)}


def test_regions_nest_or_are_apart():
    for seed in range(30):
        t = random_tree(seed, 40)
        for n in t.nodes:
            size = sum(1 for x in t.nodes if n.pre <= x.pre <= n.end_pre)
            assert size == n.end_pre - n.pre + 1 == len(list(n.walk()))
            assert all(n in x.ancestors() for x in list(n.walk())[1:])


def test_traversal_orders(forest):
    trees, nodes = forest
    got = {(r.file_id, r.pre): r.position for r in structural.traversal(nodes, "post").collect()}
    for k, t in trees.items():
        order = []

        def visit(n):
            for c in n.children:
                visit(c)
            order.append(n.pre)

        visit(t.root)
        assert [got[k, p] for p in order] == list(range(len(order)))


def test_outermost(forest):
    trees, nodes = forest
    got = {(r.file_id, r.pre) for r in structural.outermost(structural.select(nodes, {"kind": "a"})).collect()}
    assert got == {(k, n.pre) for k, t in trees.items() for n in t.nodes if n.kind == "a" and not any(a.kind == "a" for a in n.ancestors())}


def test_labels_of_any_depth(spark):
    rows = [("f", 1, None, 0), ("f", 2, 1, 1), ("f", 3, 1, 0), ("f", 4, 3, 0), ("f", 8, 9, 0), ("f", 9, 8, 0), ("g", 1, None, 0)]
    df = spark.createDataFrame(rows, "file_id string, id int, parent_id int, ord int")
    got = {(r.file_id, r.id): (r.pre, r.end_pre, r.parent, r.depth, r.child_idx) for r in labels.label_tree(df).collect()}
    assert got == {("f", 1): (0, 3, -1, 0, 0), ("f", 3): (1, 2, 0, 1, 0), ("f", 4): (2, 2, 1, 2, 0), ("f", 2): (3, 3, 0, 1, 1), ("g", 1): (0, 0, -1, 0, 0)}


@pytest.mark.parametrize(("spec", "code"), [({"pattern": "x"}, "needs_interpreter"), ({}, "no_positive_matcher"), ({"matches": "u"}, "undefined_util"), ({"precedes": {"kind": "a", "field": "f"}}, "field_not_supported")])
def test_errors(forest, spec, code):
    with pytest.raises(structural.RuleError) as e:
        structural.select(forest[1], spec)
    assert e.value.code == code


def test_a_rule_about_the_node_alone_reaches_the_scan(spark, forest, tmp_path):
    forest[1].write.parquet(f"{tmp_path}/n")
    point = {"line": 0, "column": 1}
    df = structural.select(spark.read.parquet(f"{tmp_path}/n"), {"kind": "a", "any": [{"kind": "b"}, {"matches": "u"}]}, {"u": {"kind": "a", "not": {"range": {"start": point, "end": point}}}})
    plan = df.select("file_id", "pre")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,a)" in plan and "Window" not in plan and "Exchange" not in plan
    assert "end_byte" not in plan.split("ReadSchema")[-1]


def test_scan_nodes_has_a_row_for_each_rule(forest):
    trees, nodes = forest
    got = scan.scan_nodes(nodes, {"r1": {"kind": "a"}, "r2": {"regex": "x"}, "off": {"kind": "b"}}, {"off": "off"}, {"r1": "a $KIND"})
    n = lambda f: sum(1 for t in trees.values() for x in t.nodes if f(x))
    counts = {r.rule_id: r["count"] for r in got.groupBy("rule_id").count().collect()}
    assert counts == {"r1": n(lambda x: x.kind == "a"), "r2": n(lambda x: "x" in x.text)}
    assert {r.message for r in got.where("rule_id = 'r1'").collect()} == {"a a"}


def test_labels_of_paths_are_those_of_a_walk(spark):
    rng, rows, wanted = random.Random(7), [], []
    for f in range(60):
        paths = {(0,)} if f % 7 else set()
        for _ in range(rng.randint(0, 40)):
            paths.add(tuple(rng.choice([0, 1, 2, -3]) for _ in range(rng.randint(1, 4))))
        order = sorted(paths)  # a prefix comes first, as null does
        kids = {}
        for pre, p in enumerate(order):
            parent = -1 if len(p) == 1 else order.index(p[:-1]) if p[:-1] in paths else None
            index = kids[parent] = kids.get(parent, -1) + 1
            wanted.append((f"f{f}", pre, pre + sum(q[: len(p)] == p for q in order) - 1, parent, len(p) - 1, index, str(p)))
            rows.append((f"f{f}", *p, *[None] * (4 - len(p)), str(p)))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "file_id string, a int, b int, c int, d int, name string")
    assert sorted(map(tuple, labels.label_paths(table, ["a", "b", "c", "d"], ["name"]).collect()), key=str) == sorted(wanted, key=str)


def test_joins_and_fields_keep_to_small_tasks(spark, sf):
    """No partition is put together with others, and a field on the way up takes no join and no window."""
    for name, joins in (("rule_matches_util", 1), ("has_child", 1), ("rule_not", 1), ("nearest_ancestor_binding", 1), ("inside_field", 0)):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution()
        text, done = plan.optimizedPlan().toString(), plan.executedPlan().toString()
        assert (len(re.findall(r"Join \w+", text)), text.count("Window")) == (joins, 0)
        assert done.count("REPARTITION_BY_NUM") == 2 * joins + (name in ("inside_field", "nearest_ancestor_binding"))


def test_tasks_grow_with_the_tables(spark, sf, monkeypatch):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    size = sum(f.stat().st_size for f in [pathlib.Path(f"{sf}/lineitem.parquet")])
    for bytes_ in (size // 100, size // 50):
        monkeypatch.setattr(storage, "TASK_BYTES", bytes_)
        assert storage.spread(lines.where("l_tax > 0"), "l_orderkey").rdd.getNumPartitions() == size // bytes_
    monkeypatch.undo()
    assert storage.spread(lines, "l_orderkey").rdd.getNumPartitions() == max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
