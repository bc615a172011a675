"""Named kinds of bracketed languages."""

import pytest

from treeline.operators import labels, symbols
from treeline.operators.patterns import Env, Matcher, compile_pattern
from treeline.sources.parsers import parse

SOURCES = {
    "javascript": "import {a} from 'x';\nexport async function foo(a, b = 1) {\n  const x = (y) => { return y + 1; };\n  if (x) { bar.baz(1); }\n  else { q(); }\n  return x;\n}\nclass A extends B {\n  static f(x) { return 1; }\n  z = 3;\n}\n",
    "rust": "use std::io;\npub struct P { x: i32 }\nimpl P {\n    pub fn new(x: i32) -> Self {\n        let y = x + 1;\n        P { x: y }\n    }\n}\nfn main() { println!(\"hi\"); foo(1, 2); }\n",
    "go": "package main\nimport \"fmt\"\nfunc (p T) Go(a int) int {\n\tx := a\n\tfmt.Println(x)\n\treturn x\n}\nfunc main() { Go(1) }\n",
    "java": "package a.b;\nimport java.util.List;\npublic class A {\n  private int x = 1;\n  public A(int x) { this.x = x; }\n  int f(int a)\n  {\n    String s = g(a);\n    return 1;\n  }\n}\n",
    "css": "@import 'a.css';\n.a, #b > p { color: #fff; margin: 0 1.5em !important }\n@media print { p { display: none; } }\n/* c */",
}
WANT = {
    "javascript": {"import_statement": 1, "function_declaration": 1, "lexical_declaration": 1, "variable_declarator": 1, "arrow_function": 1, "if_statement": 1, "return_statement": 3, "class_declaration": 1, "class_body": 1, "method_definition": 1, "field_definition": 1, "call_expression": 2, "member_expression": 1},
    "rust": {"use_declaration": 1, "struct_item": 1, "impl_item": 1, "function_item": 2, "let_declaration": 1, "macro_invocation": 1, "call_expression": 1, "integer_literal": 3},
    "go": {"package_clause": 1, "import_declaration": 1, "method_declaration": 1, "function_declaration": 1, "short_var_declaration": 1, "call_expression": 2, "selector_expression": 1, "return_statement": 1},
    "java": {"package_declaration": 1, "import_declaration": 1, "class_declaration": 1, "field_declaration": 1, "constructor_declaration": 1, "method_declaration": 1, "local_variable_declaration": 1, "method_invocation": 1, "return_statement": 1},
    "css": {"import_statement": 1, "rule_set": 2, "media_statement": 1, "declaration": 3, "class_selector": 1, "descendant_selector": 1, "color_value": 1, "integer_value": 1, "float_value": 1, "important": 1, "comment": 1},
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_kinds(language):
    kinds = [n.kind for n in parse(SOURCES[language], language).nodes if n.named]
    assert {k: kinds.count(k) for k in WANT[language]} == WANT[language]
    assert not any(n.error for n in parse(SOURCES[language], language).nodes)


@pytest.mark.parametrize(("language", "kind", "name", "params"), [("javascript", "function_declaration", "foo", "(a, b = 1)"), ("rust", "function_item", "new", "(x: i32)"), ("go", "method_declaration", "Go", "(a int)"), ("java", "method_declaration", "f", "(int a)")])
def test_fields_of_a_definition(language, kind, name, params):
    node = next(n for n in parse(SOURCES[language], language).nodes if n.kind == kind)
    assert node.child("name").text == name and node.child("parameters").text == params and node.child("body").text.endswith("}")


def test_a_pattern_is_parsed_as_what_it_matches():
    for language, pattern, source in (("javascript", "function $NAME($$$P) { $$$B }", "x();\nfunction go(a, b) { return a; }"), ("rust", "fn $NAME($$$P) { $$$B }", "fn go(a: i32) { a }"), ("go", "func $NAME($$$P) { $$$B }", "func go(a int) { f(a) }")):
        matcher = Matcher(compile_pattern(pattern, language))
        names = []
        for n in parse(source, language).nodes:
            env = Env()
            if matcher.match(n, env):
                names.append(env.text("NAME"))
        assert names == ["go"], language


def test_statements_that_share_a_line():
    kinds = [n.kind for n in parse("function a(){}function b(){};c(1)", "javascript").nodes]
    assert kinds.count("function_declaration") == 2 and kinds.count("call_expression") == 1


def test_symbols_count_arguments_at_the_top_level(spark):
    rows = [("1", "python", "def f(a=(1, 2), b={'x': [3, 4]}, *c):\n    return g.h(f(1, 2), ',', [3, 4])\n"), ("2", "rust", "fn f<T>(a: Vec<(i32, i32)>) -> i32 { a::b(c!(1), 2) }\n"), ("3", "yaml", "a: 1"), ("4", "go", None)]
    got = symbols.extract(spark.createDataFrame(rows, "file_id string, language string, content string")).collect()
    assert {(r.file_id, r.what, r.name, r.receiver, r.n_args) for r in got} == {("1", "def", "f", None, 3), ("1", "call", "h", "g", 3), ("1", "call", "f", None, 2), ("2", "def", "f", None, 1), ("2", "call", "b", "a", 2)}
    assert {r.signature for r in got if r.what == "def"} == {"def f(a=(1, 2), b={'x': [3, 4]}, *c)", "fn f<T>(a: Vec<(i32, i32)>) -> i32"}


def test_python_symbols_need_no_tree_and_are_those_of_the_tree(monkeypatch):
    plain = [
        "import json\nfrom a.b import c\n\ndef f(a, b=1):\n    return g(a, [b, 2])\n", "@d(1)\nasync def \\\n f(a,\n b: 'x:y' = {1: 2}) -> h(1): await p.q(k(1)(2), *z)\n", "class A:\n  def f(self): f'{c(1)} {d[2](e)}'\n",
        "from . import x\nfrom .a import (b,\n c)\nimport os, sys as s", "(\nf)(1)\na.b.c(1).d(2)[3](4)\n", "\tx", "", "# f()",
    ]
    odd = ["def é(): g('é', h())\n", "f($A)", "f(1)\r\ng(2)\r\n", "x = (\nf(1)", "f(" * 150 + ")" * 150, "x = " + "+".join(["f(1)"] * 3000)]
    for text in plain + odd:
        assert sorted(symbols._extracted("x", text, "python", "partial"), key=repr) == sorted(symbols._of_tree("x", labels.recovered(text, "python", "partial"), "python"), key=repr)
    monkeypatch.setattr(symbols, "recovered", None)
    assert [r[1:3] for r in symbols._extracted("x", plain[0], "python", "partial")] == [("import", "json"), ("import", "a.b"), ("def", "f"), ("call", "g")]
    assert sum(len(list(symbols._extracted("x", text, "python", "partial"))) for text in plain[:5]) == 18


def test_the_last_definition_of_a_name_is_known_where_its_source_is_read(spark, sf):
    from treeline.plans.catalogue import QUERIES

    texts = [("1", "python", "def f(a): g(1)\nclass A:\n    def f(self, b): pass\n    def h(self): pass\ndef f(): import json\n"), ("2", "rust", "fn f(a: i32) {}\nfn f() { g(1) }\n"), ("3", "python", "def é(): pass\ndef é(a): pass\n"), ("4", "python", None), ("5", "go", "")]
    sources = spark.createDataFrame(texts, "file_id string, language string, content string")
    found = symbols.functions(sources)
    assert sorted((r.file_id, r.name, r.n_args) for r in found.collect()) == [("1", "f", 0), ("1", "h", 1), ("2", "f", 0), ("3", "é", 1)]
    assert sorted(map(str, found.collect())) == sorted(map(str, symbols.functions(sources, symbols.extract(sources)).collect()))
    whole = symbols.extract(sources)
    for what in sorted(symbols.WHATS):
        assert sorted(map(str, symbols.extract(sources, wanted=frozenset([what])).collect())) == sorted(map(str, whole.where(f"what = '{what}'").collect()))
    plan = QUERIES["symbols_defs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan


def test_sources_of_one_shape_are_parsed_once(monkeypatch):
    parsed, parse_spots = [], symbols._parsed_spots
    monkeypatch.setattr(symbols, "_shapes", {})
    monkeypatch.setattr(symbols, "_parsed_spots", lambda source: parsed.append(source) or parse_spots(source))
    alike = [f"import m{i}\n\ndef f_{i}(a, b={i}):  # {'x' * i}\n    return g{i}(a, ['{'y' * i}', 2])('')" for i in range(1, 60)]
    for text in alike:
        assert symbols._python_spots(text) == parse_spots(text) and len(parse_spots(text)) == 4
    assert len(parsed) == 1
    # names, numbers and strings that the grammar tells from others
    pairs = [("x = 1.e5", "x = 1.real"), ("f(10)", "f(01)"), ("match(x)", "match (x):\n case y: f(1)"), ("type(x)", "type x = f(1)"), ("r'a'(1)", "q'a'(1)"), ("f'{g(1)}'", "b'{g(1)}'"), ("f(1)", "f(1if x else 2)"), ("x = f(1)", "x = \x01"), ("f('a')", "f('a\n')"), ("'''a'''(1)", "'''b(1)"), ("f(a)", "f(if)"), ("from __future__ import barry_as_FLUFL\nf(1) <> 2", "from __future__ import division\nf(1) <> 2"), ("f('\\'')", "f('\\n')")]
    for a, b in pairs:
        for text in (a, b, a):
            assert symbols._python_spots(text) == parse_spots(text), text
    monkeypatch.setattr(symbols, "_SHAPED", 20)
    for i in range(100):
        symbols._python_spots("f(" + "1," * (i % 9) + ")" + "\n" * (i % 3))
    assert len(symbols._shapes) <= 20
