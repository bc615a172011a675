"""SQL functions: `register` makes parsing, matching and string functions callable from spark.sql.

    SELECT e.event_id, m.text, m.captures
    FROM events e, LATERAL ast_match(e.props, 'json', '{"k": $V}', 'smart') m
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from treeline.functions import transforms
from treeline.model import NODE
from treeline.operators.patterns import Env, Matcher, compile_pattern
from treeline.sources.parsers import parse

_NODE = NODE.partition(", ")[2]  # all but file_id


@lru_cache(maxsize=64)
def _matcher(pattern: str, language: str, strictness: str) -> Matcher:
    return Matcher(compile_pattern(pattern, language, strictness=strictness))


@F.udtf(returnType=_NODE)
class AstParse:
    """ast_parse(content, language): the node table of a text; none for a null one."""

    def eval(self, content: str, language: str) -> Iterator[tuple]:
        if content is not None and language is not None:
            for row in parse(content, language).rows(""):
                yield row[1:]


@F.udtf(returnType="pre int, kind string, start_char int, end_char int, text string, captures string")
class AstMatch:
    """ast_match(content, language, pattern, strictness): the nodes that match a pattern, with their captures as JSON."""

    def eval(self, content: str, language: str, pattern: str, strictness: str) -> Iterator[tuple]:
        if content is None or language is None or pattern is None:
            return
        matcher = _matcher(pattern, language, strictness or "smart")
        for n in parse(content, language).nodes:
            env = Env()
            if matcher.match(n, env):
                yield n.pre, n.kind, n.start, n.end, n.text, json.dumps(dict(sorted(env.strings().items())), ensure_ascii=False)


def _each(function):
    return lambda *columns: pd.Series([None if any(v is None for v in row) else function(*row) for row in zip(*columns)], dtype=object)


def register(spark: SparkSession) -> None:
    """ast_parse, ast_match; ast_substring(text, start, end), ast_replace(text, regex, by), ast_convert(text, case), ast_words(text)."""
    spark.udtf.register("ast_parse", AstParse)
    spark.udtf.register("ast_match", AstMatch)

    @F.pandas_udf("string")
    def substring(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else transforms.substring(t, None if pd.isna(a) else int(a), None if pd.isna(b) else int(b)) for t, a, b in zip(text, start, end)], dtype=object)

    @F.pandas_udf("string")
    def replace(text: pd.Series, pattern: pd.Series, by: pd.Series) -> pd.Series:
        return _each(transforms.replace)(text, pattern, by)

    @F.pandas_udf("string")
    def convert(text: pd.Series, to: pd.Series) -> pd.Series:
        return _each(transforms.convert)(text, to)

    @F.pandas_udf("array<string>")
    def words(text: pd.Series) -> pd.Series:
        return _each(transforms.split_words)(text)

    for name, f in (("ast_substring", substring), ("ast_replace", replace), ("ast_convert", convert), ("ast_words", words)):
        spark.udf.register(name, f)
