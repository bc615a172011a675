import pytest

from treeline.operators import rewrite
from treeline.operators.rules import from_dict
from treeline.operators.scan import scan_tree
from treeline.sources.parsers import parse


def replaced(source, pattern, template, language="javascript", **k):
    tree = parse(source, language)
    return rewrite.apply_edits(source, rewrite.replacements(tree, pattern, template, **k))


def test_replace_all_takes_outermost_matches():
    assert replaced("Some(Some(1)); Some(2)", "Some($A)", "$A") == "Some(1); 2"
    assert replaced("f(1); f(2)", "f($A)", "g($A)", only_first=True) == "g(1); f(2)"
    assert replaced("f(a, b)", "f($$$X)", "g(0, $$$X)") == "g(0, a, b)"
    assert replaced("f(a)", "f($A)", "g($B)") == "g()"


def test_no_edits_is_identity():
    assert rewrite.apply_edits("abc", []) == "abc"


def test_overlapping_edits_are_skipped():
    assert rewrite.apply_edits("abcdef", [(1, 3, "X"), (2, 1, "Y"), (4, 0, "Z")]) == "aXZef"


def test_indentation_follows_template_and_place():
    source = "  f({\n    a\n  })"
    assert replaced(source, "f($A)", "g(\n  $A\n)") == "  g(\n    {\n      a\n    }\n  )"


@pytest.mark.parametrize(("how", "want"), [("remove", "f();"), ("empty", "f(1);"), ("before", "f(X1);"), ("after", "f(1X);"), ("replace", "f(X);")])
def test_node_edits(how, want):
    source = "f(1);"
    n = next(n for n in parse(source, "javascript").nodes if n.kind == "number")
    assert rewrite.apply_edits(source, [rewrite.node_edit(how, n, "X")]) == want


def test_structural_templates():
    from treeline.operators.patterns import Env

    env = Env()
    tree = parse("f(x)", "javascript")
    env.one["A"] = next(n for n in tree.nodes if n.text == "x")
    assert rewrite.structural("g($A, $B, '$A')", "javascript", env) == "g(x, $B, '$A')"


def edits(config, source, language="javascript"):
    rule = from_dict({"id": "t", "language": language, **config}, need_kinds=False)
    found = scan_tree(parse(source, language), [rule], "f", report_unused=False)
    return rewrite.apply_edits(source, [(f[11], f[12], f[13]) for f in found])


def test_expanding_a_fix_takes_in_the_comma():
    rule = {"rule": {"kind": "number", "regex": "^2$"}, "fix": {"template": "", "expandEnd": {"regex": "^,$"}}}
    assert edits(rule, "f(1, 2, 3)") == "f(1,  3)"


def test_transforms_and_rewriters():
    config = {
        "rule": {"pattern": "f($$$A)"}, "fix": "g($B)", "transform": {"B": {"rewrite": {"source": "$$$A", "rewriters": ["n"], "joinBy": "; "}}},
        "rewriters": [{"id": "n", "rule": {"kind": "number", "pattern": "$N"}, "fix": "<$N>"}],
    }
    assert edits(config, "f(1, x, 2)") == "g(<1>; <2>)"
    assert edits({"rule": {"pattern": "f($A)"}, "transform": {"B": "convert($A, toCase=snakeCase)"}, "fix": "f($B)"}, "f(someName)") == "f(some_name)"


def test_on_a_table(spark):
    df = spark.createDataFrame([("a", "javascript", "f(1)"), ("b", "javascript", None), ("c", "javascript", "")], "file_id string, language string, content string")
    got = {r.file_id: (r.content, r.n_edits) for r in rewrite.replace_all(df, "f($A)", "g($A)").collect()}
    assert got == {"a": ("g(1)", 1), "b": (None, 0), "c": ("", 0)}
