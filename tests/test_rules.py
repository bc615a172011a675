import pytest

from treeline.operators.rules import RuleError, from_dict, load, load_globals, nth_holds, parse_nth
from treeline.sources.parsers import parse


def find(rule, source, language="javascript", **config):
    c = from_dict({"id": "t", "language": language, "rule": rule, **config}, need_kinds=False)
    return [n.text for n, _ in c.find_all(parse(source, language))]


CODE = "function f() { g(1); h(x, 2); }\ng(3);"


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ({"kind": "number"}, ["1", "2", "3"]), ({"kind": "number", "regex": "^[13]$"}, ["1", "3"]), ({"kind": "number", "inside": {"kind": "statement_block", "stopBy": "end"}}, ["1", "2"]),
        ({"kind": "number", "inside": {"kind": "statement_block"}}, []), ({"kind": "number", "not": {"inside": {"kind": "statement_block", "stopBy": "end"}}}, ["3"]),
        ({"kind": "call_expression", "has": {"kind": "identifier", "regex": "^h$", "field": "function"}}, ["h(x, 2)"]), ({"kind": "call_expression", "has": {"kind": "number", "stopBy": "end"}}, ["g(1)", "h(x, 2)", "g(3)"]),
        ({"any": [{"kind": "number", "regex": "1"}, {"kind": "identifier", "regex": "^x$"}]}, ["1", "x"]), ({"all": [{"kind": "number"}, {"regex": "2"}]}, ["2"]),
        ({"kind": "number", "follows": {"kind": "identifier", "stopBy": "end"}}, ["2"]), ({"kind": "identifier", "precedes": {"kind": "number", "stopBy": "end"}}, ["x"]),
        ({"kind": "number", "nthChild": 2}, ["2"]), ({"pattern": "g($A)"}, ["g(1)", "g(3)"]), ({"kind": "number", "range": {"start": {"line": 1, "column": 2}, "end": {"line": 1, "column": 3}}}, ["3"]),
    ],
)
def test_found(rule, want):
    assert find(rule, CODE) == want


def test_a_lone_has_gives_the_descendant():
    assert find({"has": {"kind": "number"}}, "g(3)") == ["3"]


def test_stop_rule_is_included_and_ends_the_walk():
    source = "a(b(c(1)))"
    assert find({"kind": "number", "inside": {"pattern": "b($X)", "stopBy": {"pattern": "b($X)"}}}, source) == ["1"]
    assert find({"kind": "number", "inside": {"pattern": "a($X)", "stopBy": {"pattern": "b($X)"}}}, source) == []


@pytest.mark.parametrize(("expr", "want"), [("2n+1", (2, 1)), ("-n+3", (-1, 3)), ("n", (1, 0)), ("+3", (0, 3)), ("2n - 1", (2, -1)), (4, (0, 4))])
def test_nth_expressions(expr, want):
    assert parse_nth(expr) == want


@pytest.mark.parametrize(("expr", "code"), [("odd", "nth_child_illegal_character"), ("3n2", "nth_child_syntax"), ("+", "nth_child_syntax"), ("", "nth_child_syntax")])
def test_nth_errors(expr, code):
    with pytest.raises(RuleError) as e:
        parse_nth(expr)
    assert e.value.code == code


def test_nth_membership():
    assert [nth_holds(-1, 3, i) for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert [i for i in range(1, 8) if nth_holds(2, -1, i)] == [1, 3, 5, 7]


BASE = {"id": "t", "language": "js", "rule": {"pattern": "f($A)"}}


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"rule": {}}, "no_positive_matcher"), ({"rule": {"kind": "call_expression", "odd": 1}}, "unknown_key"), ({"rule": {"kind": None}}, "null_value"), ({"rule": {"kind": "x", "regex": "("}}, "invalid_regex"),
        ({"rule": {"regex": "x"}}, "missing_kinds"), ({"constraints": {"B": {"kind": "number"}}}, "undefined_meta_var"), ({"fix": "g($B)"}, "undefined_meta_var"), ({"fix": [{"template": "x"}]}, "fix_without_title"),
        ({"transform": {"A": "substring($A)"}}, "already_defined"), ({"transform": {"B": "substring($C)", "C": "substring($B)"}}, "cyclic_transform"), ({"transform": {"B": "odd($A)"}}, "parse"),
        ({"labels": {"B": {"style": "primary"}}}, "label_variable"), ({"rewriters": [{"id": "r", "rule": {"kind": "number"}}]}, "rewriter_without_fix"), ({"severity": "loud"}, "invalid_severity"), ({"language": "klingon"}, "unknown_language"),
        ({"rule": {"kind": "call_expression", "follows": {"kind": "x", "field": "f"}}}, "field_not_supported"), ({"rule": {"matches": "none"}}, "undefined_util"),
        ({"utils": {"a": {"matches": "b"}, "b": {"matches": "a"}}, "rule": {"kind": "call_expression", "matches": "a"}}, "cyclic_rule"),
        ({"rule": {"kind": "x", "range": {"start": {"line": 2, "column": 0}, "end": {"line": 1, "column": 0}}}}, "invalid_range"),
    ],
)
def test_errors(change, code):
    with pytest.raises(RuleError) as e:
        from_dict({**BASE, **change})
    assert e.value.code == code


def test_utils_local_and_global():
    shared = load_globals("id: num\nrule: {kind: number}\n", "javascript")
    (rule,) = load("id: t\nlanguage: javascript\nutils: {one: {matches: num, regex: '1'}}\nrule: {matches: one}\n", shared)
    assert [n.text for n, _ in rule.find_all(parse(CODE, "javascript"))] == ["1"]


def test_constraints_see_single_captures():
    assert find({"pattern": "g($A)"}, CODE, constraints={"A": {"regex": "3"}}) == ["g(3)"]


def test_operators():
    from treeline.operators.patterns import Env
    from treeline.operators.rules import Kind, Regex

    tree = parse(CODE, "javascript")
    hit = lambda r: [n.text for n in tree.nodes if r.match(n, Env()) is not None]
    assert hit(Kind("number") & Regex("1")) == ["1"]
    assert hit(Kind("number") & ~Regex("1")) == ["2", "3"]
    assert hit((Kind("number") & Regex("1")) | (Kind("identifier") & Regex("^x$"))) == ["1", "x"]
