import datetime as dt
import random

import pytest

from treeline.functions import sql
from treeline.operators import labels, rules, service, store
from treeline.sources import parsers
from treeline.streaming import streams

START = dt.datetime(2024, 1, 1)


def test_limits(spark):
    paths = ["a/x.py", "node_modules/y.js", "a/node_modules/z.js", "target/t.rs", "b.py", None]
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(paths)], "file_id string, path string")
    assert {r.path for r in service.limited(df).collect()} == {"a/x.py", "b.py"}
    assert [r.path for r in service.limited(df, max_files=1).collect()] == ["a/x.py"]
    hits = spark.createDataFrame([(f"r{i % 2}", "f", i) for i in range(50)], "rule_id string, file_id string, pre int").repartition(5)
    got = service.capped(hits, most=3).collect()
    assert sorted((r.rule_id, r.pre) for r in got) == [("r0", 0), ("r0", 2), ("r0", 4), ("r1", 1), ("r1", 3), ("r1", 5)]


def test_progress_by_share_and_time(spark):
    rows = [("s", f"f{i}", START + dt.timedelta(seconds=i / 10)) for i in range(100)] + [("t", "f", START), ("t", "g", START + dt.timedelta(seconds=7)), ("t", "h", START + dt.timedelta(seconds=8))]
    got = service.progress(spark.createDataFrame(rows, "session_id string, file_id string, timestamp timestamp")).collect()
    assert sorted(r.files_processed for r in got if r.session_id == "s") == sorted({*range(10, 101, 10), 51})
    assert sorted(r.files_processed for r in got if r.session_id == "t") == [1, 2, 3] and {r.total_files for r in got} == {100, 3}


def test_analysis_of_nested_functions(spark):
    code = "import os\n\n\ndef outer(a):\n    def inner(b):\n        return helper(b)\n    return inner(a)\n\n\ndef helper(x):\n    return x\n\n\nouter(1)\n"
    df = spark.createDataFrame([("f", "f.py", "python", code)], "file_id string, path string, language string, content string")
    nodes, edges = service.analyze(df)
    assert {(r.node_type, r.name) for r in nodes.collect()} == {("file", "f.py"), ("function", "outer"), ("function", "inner"), ("function", "helper")}
    assert {tuple(r) for r in edges.collect()} == {
        ("f", "f::outer", "Contains"), ("f::outer", "f::inner", "Contains"), ("f", "f::helper", "Contains"), ("f::inner", "f::helper", "Calls"), ("f::outer", "f::inner", "Calls"), ("f", "f::outer", "Calls"), ("f", "os", "Imports"),
    }


def test_a_parser_that_raises_doesnt_fail_the_job(spark, monkeypatch):
    good = parsers.PARSERS["json"]

    def fussy(source):
        if "!" in source:
            raise ValueError("no way")
        return good(source)

    monkeypatch.setitem(parsers.PARSERS, "json", fussy)
    assert labels.recovered("[1]", "json", "abort").root.kind == "document"
    for how, kind in (("partial", "ERROR"), ("fallback", "program")):
        assert labels.recovered("[1!]", "json", how).root.kind == kind
    assert labels.recovered("[1!]", "json", "skip") is None
    for how in ("abort", "retry"):
        with pytest.raises(ValueError):
            labels.recovered("[1!]", "json", how)


def test_envelope_and_descriptors(spark):
    good = spark.createDataFrame([("a", 1)], "file_id string, n int")
    bad = spark.createDataFrame([("b",)], "file_id string").selectExpr("file_id").withColumn("_error", service.error("parse", service.F.lit("x"), service.F.col("file_id")))
    got = {r.file_id: r for r in service.envelope(good, bad).collect()}
    assert got["a"]._error is None and got["b"].n is None and got["b"]._error.code == "parse"
    assert service.suggested("timeout") == "retry" and service.suggested("?") == "abort"
    told = service.Capabilities().as_dict()
    assert {"python", "rust", "typescript"} <= set(told["languages"]) and told["most_matches"] == 1000
    assert labels.parse_errors(spark.createDataFrame([("a", "json", "[")], "file_id string, language string, content string")).count() == 0


def test_schema_knows_what_the_loader_takes():
    schema = service.rule_schema()
    keys = set(schema["$defs"]["rule"]["properties"])
    assert keys == set(rules.ORDER)
    rule = rules.load("id: a\nlanguage: json\nseverity: hint\nrule: {kind: pair}\n")[0]
    assert {"id", "language", "rule"} <= set(schema["properties"]) and rule.language in schema["properties"]["language"]["enum"]


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT ast_substring('abcdef', 1, -1) AS a, ast_substring('abcdef', -3, NULL) AS b, ast_replace('a1b2', '([a-z])([0-9])', '$2$1') AS c, ast_convert('orderLine', 'snakeCase') AS d, ast_words('HTTPServerName') AS e, ast_convert(NULL, 'snakeCase') AS f").first()
    assert tuple(row) == ("bcde", "def", "1a2b", "order_line", ["HTTP", "Server", "Name"], None)
    assert spark.sql("SELECT * FROM ast_match('f(1, 2)', 'javascript', 'f($$$ARGS)', 'smart')").count() == 1
    assert spark.sql("SELECT * FROM ast_parse(NULL, 'json')").count() == 0
    assert spark.sql("SELECT kind FROM ast_parse('[1]', 'json') WHERE kind = 'number'").count() == 1


def test_files_written_are_files_read(spark, tmp_path):
    rows = [("a.txt", "é\n"), ("d/e/b.py", "x"), ("c", None), ("./.git/x", "no")]
    df = spark.createDataFrame(rows, "path string, content string")
    assert {(r.path, r.bytes) for r in store.write_text_files(df, f"file://{tmp_path}/r").collect()} == {("a.txt", 3), ("d/e/b.py", 1), ("./.git/x", 2)}
    got = {r.path: (r.file_id, r.content) for r in store.repository(spark, "git", f"file://{tmp_path}/r").collect()}
    assert got == {"a.txt": (f"file://{tmp_path}/r/a.txt", "é\n"), "d/e/b.py": (f"file://{tmp_path}/r/d/e/b.py", "x")}
    with pytest.raises(ValueError):
        store.repository(spark, "svn", "x")


def brute_breaker(events, most, window, pause):
    """All failures kept, counted anew for each event."""
    state, opened, fails, out = "CLOSED", None, [], []
    for at, ok in events:
        if state == "OPEN" and at - opened < pause:
            continue
        if state == "OPEN":
            state, fails = ("CLOSED", []) if ok else ("OPEN", [])
            opened = at
            out.append((at, state))
            continue
        fails += [] if ok else [at]
        if sum(at - window <= t for t in fails) > most:
            state, opened, fails = "OPEN", at, []
            out.append((at, "OPEN"))
    return out


def test_breaker_opens_is_half_open_and_closes(spark, tmp_path):
    draw = random.Random(5)
    rows, at = [], 0.0
    for _ in range(400):
        at += draw.choice([1, 2, 5, 20])
        rows.append(("op", START + dt.timedelta(seconds=at), draw.random() > 0.7))
    kind = "operation_type string, timestamp timestamp, success boolean"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    held = []
    out = streams.breaker_states(streams.change_feed(spark, f"{tmp_path}/in", kind), most=3)
    streams.run_once(out.writeStream.outputMode("append").foreachBatch(lambda b, i: held.extend(b.collect())), f"{tmp_path}/c")
    want = brute_breaker([((t - START).total_seconds(), ok) for _, t, ok in rows], 3, 30, 60)
    assert [((r["at"] - START).total_seconds(), r.state) for r in sorted(held, key=lambda r: r["at"])] == want
    assert {s for _, s in want} == {"OPEN", "CLOSED"}


def test_three_tiers_and_progress(spark, tmp_path):
    kind = "name string, change string, old_signature string, new_signature string"
    spark.createDataFrame([("f", "Deletion", "a", None), ("g", "SignatureChange", "a", "b")], kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    calls = spark.createDataFrame([("x", "f")], "caller string, name string")
    deep = spark.createDataFrame([("f", 30)], "name string, n bigint")
    held = []
    streams.conflict_updates(streams.change_feed(spark, f"{tmp_path}/in", kind), calls, lambda df, tier: held.append((tier, {r.name: (r.tier, r.severity) for r in df.collect()})), f"{tmp_path}/c", deep).awaitTermination()
    assert held == [(1, {"f": (1, "low"), "g": (1, "low")}), (2, {"f": (2, "medium"), "g": (1, "low")}), (3, {"f": (3, "high"), "g": (1, "low")})]
    done = "session_id string, file_id string"
    for k in range(2):
        spark.createDataFrame([("s", f"f{k}"), ("s", "f0")], done).coalesce(1).write.mode("append").parquet(f"{tmp_path}/done")
    totals = spark.createDataFrame([("s", 5)], "session_id string, total_files int")
    told = []
    streams.session_progress(streams.change_feed(spark, f"{tmp_path}/done", done, 1), totals, lambda df: told.extend(df.collect()), f"{tmp_path}/c2", f"{tmp_path}/state").awaitTermination()
    assert [(r.files_processed, r.total_files) for r in told][-1] == (2, 5) and len(told) == 2
