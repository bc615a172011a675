import json

import pytest
from pyspark.sql import functions as F

from treeline.operators import labels, rewrite, rules, scan, structural, symbols
from treeline.operators.rules import load
from treeline.plans.catalogue import QUERIES
from treeline.sources.parsers import parse, parse_css

RULE = "id: call\nlanguage: javascript\nrule: {pattern: f($A)}\n"


def found(source, rules=RULE, **k):
    return [(r[1], r[6]) for r in scan.scan_tree(parse(source, "javascript"), load(rules), "f", **k)]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("x;\n// lint-ignore\nf(1)\nf(2)", [("call", 3)]), ("x;\nf(1) // lint-ignore\nf(2)", [("call", 2)]), ("x;\n// lint-ignore: call, b\nf(1)", []),
        ("x;\n// lint-ignore: other\nf(1)", [(scan.UNUSED_ID, 1), ("call", 2)]), ("x;\n// lint-ignore call\nf(1)", []), ("// lint-ignore\n\nf(1)\nf(2)", []), ("// lint-ignore\nf(1)\nf(2)", [("call", 2)]),
        ("// lint-ignore: call\n\nf(1)", []), ("x;\n// lint-ignore\ny", [(scan.UNUSED_ID, 1)]), ("f(1)", [("call", 0)]),
    ],
)
def test_suppression(source, want):
    assert found(source) == want


def test_labels_messages_and_diffs():
    rules = load("id: a\nlanguage: javascript\nmessage: call of $A\nrule: {pattern: f($A), inside: {kind: statement_block, stopBy: end}}\nfix: g($A)\nlabels: {A: {style: primary, message: here}}\n---\nid: b\nlanguage: javascript\nrule: {kind: call_expression, inside: {kind: statement_block, stopBy: end}}\n")
    rows = scan.scan_tree(parse("{ f(x) }", "javascript"), rules, "f", separate_fix=True)
    a, b = rows
    assert (a[1], a[9], a[10], a[13]) == ("a", "call of x", True, "g(x)") and json.loads(a[14]) == [{"style": "primary", "message": "here", "start": 4, "end": 5}]
    assert not b[10] and [label["style"] for label in json.loads(b[14])] == ["primary", "secondary"]


def test_rules_for_a_path():
    text = "id: z\nlanguage: javascript\nrule: {kind: call_expression}\n---\nid: a\nlanguage: javascript\nrule: {kind: call_expression}\nfix: x\n---\nid: g\nlanguage: javascript\nrule: {kind: call_expression}\nfiles: ['src/**']\nignores: ['src/gen/**']\n---\nid: o\nlanguage: javascript\nseverity: 'off'\nrule: {kind: call_expression}\n"
    rules = scan.Collection(load(text))
    assert len(rules) == 3
    assert [r.id for r in rules.for_path("src/a.js", "javascript")] == ["g", "z", "a"]  # those with a fix come last
    assert [r.id for r in rules.for_path("src/gen/a.js", "javascript")] == ["z", "a"] and rules.for_path("a.py", "python") == []


@pytest.mark.parametrize(("glob", "path", "ok"), [("src/**", "src/a/b.py", True), ("*.py", "a/b.py", False), ("**/*.py", "b.py", True), ("a?.{py,js}", "ab.js", True), ("[!a].py", "a.py", False), ("[ab].py", "b.py", True)])
def test_globs(spark, glob, path, ok):
    from pyspark.sql import functions as F

    assert scan.applies(path, [glob], []) == ok
    assert spark.createDataFrame([(path,)], "p string").select(scan.applies_col(F.col("p"), [glob], [])).first()[0] == ok


def test_on_a_table(spark):
    rows = [("1", "a.js", "javascript", "f(1); f(2)"), ("2", "b.py", "python", "f(1)"), ("3", "c.js", "javascript", None), ("4", "d.js", "javascript", "")]
    df = spark.createDataFrame(rows, "file_id string, path string, language string, content string")
    assert scan.scan_sources(df, load(RULE)).groupBy("file_id").count().collect()[0].asDict() == {"file_id": "1", "count": 2}
    assert scan.scan_sources(df.limit(0), load(RULE)).count() == 0


def test_suppression_on_tables(spark):
    lines = spark.createDataFrame([("f", 0, "# lint-ignore"), ("f", 2, "# lint-ignore: a, b"), ("f", 4, "# lint-ignore: c")], "file_id string, line int, text string")
    marks = scan.suppression_comments(lines)
    hits = spark.createDataFrame([("f", 1, "x"), ("f", 3, "a"), ("f", 3, "x"), ("f", 9, "c")], "file_id string, line int, rule_id string")
    assert {(r.line, r.rule_id) for r in scan.suppress(hits, marks).collect()} == {(3, "x"), (9, "c")}
    assert {(r.line, r.rule_id) for r in scan.unused(hits, marks).collect()} == {(3, "b"), (5, "c")}


def test_sources_of_one_row_group_are_parsed_by_all_cores(spark, tmp_path):
    spark.createDataFrame([(str(i), "rust", f"fn f{i}() {{ g{i}(1) }}") for i in range(400)], "file_id string, language string, content string").coalesce(1).write.parquet(str(tmp_path / "s"))
    sources = spark.read.parquet(str(tmp_path / "s")).withColumn("path", F.lit("x.rs"))
    assert sources.select(F.spark_partition_id()).distinct().count() == 1
    rule = rules.load("id: c\nlanguage: rust\nrule: {kind: call_expression}\n")
    for found in (labels.parse_sources(sources), symbols.extract(sources), scan.matches(sources, {"c": {"kind": "call_expression"}}), scan.scan_sources(sources, rule), rewrite.rewrite_sources(sources, lambda tree: [])):
        assert found.select(F.spark_partition_id()).distinct().count() >= 2 * spark.sparkContext.defaultParallelism - 1


def test_matches_are_what_rules_select_from_the_node_table(spark):
    texts = ["def f(a, b=1):\n    return g(a, [b])\n\nclass C(D):\n    def h(self): pass\n", "", None, "x = (\n", "def é(): # " + "y" * 300]
    sources = spark.createDataFrame([(str(i), "python", t) for i, t in enumerate(texts)], "file_id string, language string, content string")
    specs = {"name": {"kind": "identifier", "inside": {"kind": "function_definition", "field": "name"}}, "def": {"kind": "function_definition"}, "error": {"kind": "ERROR"}, "bare": {"has": {"kind": "identifier", "stopBy": "end"}}, "deep": {"inside": {"kind": "class_definition", "stopBy": "end"}}}
    nodes, columns = labels.parse_sources(sources), [c.split()[0] for c in scan.MATCH.split(", ")]
    wanted = []
    for k, spec in specs.items():
        wanted += structural.with_text(structural.select(nodes, spec), nodes).select(*(F.lit(k).alias(c) if c == "rule_id" else F.col(c) for c in columns)).collect()
    assert len(wanted) > 20 and sorted(map(str, scan.matches(sources, specs).collect())) == sorted(map(str, wanted))


def test_a_query_over_code_parses_each_source_once(spark, sf):
    for name in ("named_kinds", "css_declarations", "python_functions", "symbols_languages"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") + plan.count("MapInArrow") == 1 and " Join " not in plan


def test_a_query_over_pages_parses_each_page_once_and_stores_nothing(spark, sf):
    for name in ("html_tag_count", "html_embedded_calls"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInPandas") + plan.count("MapInArrow") == 1 and " Join " not in plan


def test_matches_in_embedded_code_are_those_of_the_tables(spark):
    pages = ["<p>a</p><script>f(1); g(h(2))</script><style>a { b: c }</style><script LANG=\"ts\">t(3)</script>", "é<script lang='js'>é(1)</script><script src=x></script><script>k(", "", None, "<script>" + "f(1);" * 100 + "</script>"]
    sources = spark.createDataFrame([(str(i), "html", t) for i, t in enumerate(pages)], "file_id string, language string, content string")
    ranges = labels.embedded_ranges(labels.parse_sources(sources))
    for language, calls in (("javascript", 104), ("typescript", 1), ("css", 0)):
        nodes = labels.parse_embedded(sources, ranges.where(F.col("language") == language))
        wanted = structural.with_text(structural.select(nodes, {"kind": "call_expression"}), nodes)
        wanted = wanted.select(*(F.lit("c").alias(c) if c == "rule_id" else F.col(c) for c in [c.split()[0] for c in scan.MATCH.split(", ")])).collect()
        found = scan.matches(sources, {"c": {"kind": "call_expression"}}, embedded=language).collect()
        assert len(found) == calls and sorted(map(str, found)) == sorted(map(str, wanted))


STYLES = [".a, #b > p { margin: 3px; /* x: y; */ }\n@media print { p { color: #000001 } }\n", "a{b:1 2;c:'x;y' #fff/* d:4 */;e:}", "@import 'a' 7; x: 5", "é: 8", "", None, "/* a: 1", "b {c: url(1) 9em !important; :3; d}", "} e: -1; f: 1.5; {g:2"]


def test_declarations_are_those_of_the_tree(spark, monkeypatch):
    kinds = {"integer_value", "color_value", "string_value", "plain_value"}
    sources = spark.createDataFrame([(str(i), "css", t) for i, t in enumerate(STYLES)] + [("0", "css", STYLES[0]), ("x", "json", "a: 1")], "file_id string, language string, content string")
    wanted = [(str(i), p.text, v.kind, v.text) for i, t in [*enumerate(STYLES), (0, STYLES[0])] if t for n in parse(t, "css").nodes if n.kind == "declaration" for p in n.children[:1] for v in n.children[1:] if v.kind in kinds]
    found = scan.declarations(sources, kinds).collect()
    assert len(wanted) > 12 and sorted(map(tuple, found)) == sorted(wanted)
    own = [list(scan._declared(t)) for t in STYLES if t]
    monkeypatch.setitem(scan.PARSERS, "css", lambda source: parse_css(source))  # another parser is asked for its tree
    assert [sorted(scan._declared(t)) for t in STYLES if t] == [sorted(x) for x in own]


def test_css_declarations_sort_nothing_and_keep_repeated_rows(spark, sf, tmp_path):
    part = spark.read.parquet(f"{sf}/part.parquet")
    part.limit(3).union(part.limit(3)).write.parquet(str(tmp_path / "part.parquet"))
    found = QUERIES["css_declarations"](spark, str(tmp_path))
    assert found.groupBy("p_partkey", "property").count().where("count = 2").count() == 6 and found.count() == 12
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
