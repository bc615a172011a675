import json
import time

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from treeline.operators import labels
from treeline.sources import languages
from treeline.sources.parsers import parse, parse_ranges

ANY = st.text(st.sampled_from("<>/=\"'ab {}[]():,;\n$A1é-!"), max_size=60)


@example("{1:,", "json")
@example('{"a":]', "json")
@example('{"a": [1, {"b":}]}', "json")
@settings(max_examples=300, deadline=None)
@given(ANY, st.sampled_from(["html", "json", "yaml", "python", "javascript", "css"]))
def test_any_text_gives_a_tree_whose_spans_nest(source, language):
    tree = parse(source, language)
    for n in tree.nodes:
        assert 0 <= n.start <= n.end <= len(source)
        for c in n.children:
            assert c.parent is n and n.start <= c.start and c.end <= n.end
        for a, b in zip(n.children, n.children[1:]):
            assert a.start <= b.start


def kinds(source, language, *wanted):
    return [n.text for n in parse(source, language).nodes if n.kind in wanted]


def test_html():
    source = '<div CLASS="a b" x=1><p>one<p>two<br>three</div><script>var t="</p>";</script><!-- c --></i>'
    assert kinds(source, "html", "text") == ["one", "two", "three"]
    assert kinds(source, "html", "raw_text") == ['var t="</p>";'] and kinds(source, "html", "comment") == ["<!-- c -->"]
    assert kinds(source, "html", "attribute") == ['CLASS="a b"', "x=1"] and kinds(source, "html", "erroneous_end_tag") == ["</i>"]
    assert [n.depth for n in parse(source, "html").nodes if n.kind == "text"] == [3, 3, 3]


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8))
def test_json_keeps_all_values(value):
    tree = parse(json.dumps(value), "json")
    assert not any(n.error for n in tree.nodes)

    def back(n):
        if n.kind == "object":
            return {back(p.child("key")): back(p.child("value")) for p in n.children if p.kind == "pair"}
        if n.kind == "array":
            return [back(c) for c in n.children if c.named]
        return json.loads(n.text)

    assert back(tree.root.children[0]) == value


def test_json_errors_are_marked():
    assert any(n.error for n in parse('{"a": [1}', "json").nodes)


def test_python_and_yaml():
    source = "import os\n\ndef f(a):\n    # c\n    return g(a)\n"
    assert kinds(source, "python", "function_definition") == [source[11:].rstrip()] and kinds(source, "python", "comment") == ["# c"]
    call = next(n for n in parse(source, "python").nodes if n.kind == "call")
    assert call.child("function").text == "g"
    assert kinds("a: 1\nb: [x, true]\n", "yaml", "integer", "string", "boolean") == ["a", "1", "b", "x", "true"]


def test_brackets():
    source = "a.b(c, [1]); // n\nif (x) { y(); }"
    assert kinds(source, "javascript", "call_expression") == ["a.b(c, [1])", "y()"] or "a.b(c, [1])" in kinds(source, "javascript", "call_expression")
    assert kinds(source, "javascript", "comment") == ["// n"]


def test_ranges_keep_the_hosts_offsets():
    source = "<script>f(1)</script>"
    (tree,) = parse_ranges(source, [(8, 12)], "javascript")
    assert [n.text for n in tree.nodes if n.kind == "call_expression"] == ["f(1)"]


def test_positions_in_bytes_and_characters():
    rows = parse('{"é": "ñ\\n",\n "x": 1}', "json").rows("f")
    number = next(r for r in rows if r[10] == "number")
    assert number[14] == number[16] + 2 and number[18:20] == (1, 6)


@pytest.mark.parametrize(("path", "language"), [("a.TSX", "tsx"), ("b.cpp", "cpp"), ("c.h", "cpp"), ("noext", None), ("x/y.tar.gz", None), ("d.c", "c"), (".bashrc", "bash"), ("a.b/c", None)])
def test_detection(spark, path, language):
    assert languages.detect(path) == language
    df = spark.createDataFrame([(path,)], "path string")
    assert languages.with_language(df).first().language == language


def test_names_and_globs():
    assert languages.canonical("C++") == "cpp" and languages.canonical("golang") == "go" and languages.canonical("x") is None
    assert languages.file_globs("go") == ["*.go"] and len({e for e, _ in languages.pairs()}) == len(languages.pairs())


def test_embedded_languages(spark):
    html = "<script>a()</script><script lang='ts'>b()</script><style lang=scss>c{}</style><style>d{}</style><script></script>"
    df = spark.createDataFrame([("p", "html", html)], "file_id string, language string, content string")
    found = labels.embedded_ranges(labels.parse_sources(df))
    assert sorted((r.language, html[r.start_char : r.end_char]) for r in found.collect()) == [("css", "d{}"), ("javascript", "a()"), ("scss", "c{}"), ("typescript", "b()")]


def test_rejected_sources(spark):
    df = spark.createDataFrame([("a", "json", None), ("b", "json", ""), ("c", "json", "1" * 50), ("d", "json", "1")], "file_id string, language string, content string")
    assert {r.file_id: r.error.message for r in labels.rejected_sources(df, 20).collect()} == {"a": "no content", "b": "empty", "c": "too large"}
    assert {r.file_id for r in labels.parse_sources(df, 20).collect()} == {"d"}


def test_deep_texts_are_total():
    assert parse("[" * 2000 + "]" * 2000, "yaml").nodes
    assert parse("x = " + "[" * 150 + "]" * 150, "python").nodes
    assert parse("(" * 3000 + ")" * 3000, "javascript").nodes
    assert parse("{" * 3000, "json").nodes


def test_a_script_ends_where_it_ends_behind_letters_that_grow_in_lower_case():
    text = "\u0130\u0130\u0130<script>f(1)</SCRIPT><p>x</p>"
    assert [n.text for n in parse(text, "html").nodes if n.kind in ("raw_text", "text")] == ["\u0130\u0130\u0130", "f(1)", "x"]


def test_end_tags_without_a_start_do_not_look_through_all_open_elements():
    n = 20_000
    began = time.process_time()
    tree = parse("<div>" * n + "</span>" * n, "html")
    assert time.process_time() - began < 20 and sum(x.kind == "erroneous_end_tag" for x in tree.nodes) == n
