import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeline.functions import transforms as tf


@pytest.mark.parametrize(("args", "want"), [((1, -1), "bcde"), ((-3, None), "def"), ((4, 2), ""), ((0, 99), "abcdef"), ((None, None), "abcdef"), ((-99, 2), "ab")])
def test_substring(args, want):
    assert tf.substring("abcdef", *args) == want


@pytest.mark.parametrize(("text", "words"), [("orderLineItem", ["order", "Line", "Item"]), ("HTTPServerName", ["HTTP", "Server", "Name"]), ("v2Beta", ["v2", "Beta"]), ("a12b", ["a1", "2b"]), ("a-b.c/d e_f", list("abcdef")), ("", [])])
def test_split(text, words):
    assert tf.split_words(text) == words


@pytest.mark.parametrize(("text", "to", "want"), [("orderLineItem", "snakeCase", "order_line_item"), ("HTTPServer", "kebabCase", "http-server"), ("order_line", "camelCase", "orderLine"), ("order-line", "pascalCase", "OrderLine"), ("aBC", "capitalize", "ABC"), ("aB", "upperCase", "AB"), ("aB", "lowerCase", "ab")])
def test_convert(text, to, want):
    assert tf.convert(text, to) == want


def test_replace_groups():
    assert tf.replace("ab12", "([a-z]+)([0-9]+)", "${2}x$1") == "12xab"
    assert tf.replace("ab", "(", "x") == ""


texts = st.text(st.sampled_from("abzABZ019-_./ é"), max_size=14)


@settings(max_examples=15, deadline=None)
@given(st.lists(texts, min_size=1, max_size=40), st.integers(-8, 8), st.integers(-8, 8))
def test_columns_equal_the_text_functions(spark, values, a, b):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    c = F.col("t")
    cols = [tf.substring_col(c, a, b).alias("s"), tf.split_words_col(c).alias("w"), *(tf.convert_col(c, to).alias(to) for to in tf.CASES)]
    for r in df.select("t", *cols).collect():
        assert r.s == tf.substring(r.t, a, b) and r.w == tf.split_words(r.t)
        for to in tf.CASES:
            assert r[to] == tf.convert(r.t, to)


def test_call_syntax():
    assert tf.parse_call("replace($A, replace='^x', by=\"y\")") == {"func": "replace", "source": "$A", "replace": "^x", "by": "y"}
    assert tf.parse_call("substring($B, startChar=1, endChar=-1)") == {"func": "substring", "source": "$B", "startChar": 1, "endChar": -1}
    assert tf.parse_call("convert($C, toCase=camelCase, separatedBy=[dash, space])")["separatedBy"] == ["dash", "space"]
    with pytest.raises(tf.TransformError):
        tf.parse_call("convert(A)")


def test_template_columns(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(tf.template_col("$A-$$$B-$C", {"A": F.col("a"), "B": F.col("b")})).first()[0] == "x--$C"


def test_indentation():
    assert tf.shift("a\n  b\nc", 0, 2) == "a\n    b\n  c"
    assert tf.shift("a\n    b\n c", 4, 0) == "a\nb\n c"
    assert tf.indent_at("x\n   foo") == 3
