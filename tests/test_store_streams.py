import datetime as dt

import pytest
from pyspark.sql import functions as F

from treeline.operators import analytics
from treeline.operators.store import Store, from_memory, read_text_files
from treeline.streaming import streams


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.save("t", spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), "parse", version="1")
    s.save("t", spark.createDataFrame([("c", 3)], "k string, v int"), "scan", config_hash="h", version="2")
    return s


def keys(df):
    return sorted(r.k for r in df.collect())


def test_save_load_and_stats(store):
    assert keys(store.load("t")) == ["a", "b", "c"] and keys(store.load("t", "parse")) == ["a", "b"] and keys(store.load("t", config_hash="h")) == ["c"] and keys(store.load("t", version="1")) == ["a", "b"]
    assert {r.operation: r.n for r in store.stats("t").collect()} == {"parse": 2, "scan": 1}
    assert store.healthy("t") and not store.healthy("none")


def test_invalidate_expiry_backup_and_restore(spark, store, tmp_path):
    store.backup("t", f"file://{tmp_path}/copy")
    assert store.invalidate("t", "k", "^[ab]$") == 2 and keys(store.load("t")) == ["c"] and store.invalidate("t", "k", "zzz") == 0
    store.restore("t", f"file://{tmp_path}/copy")
    assert keys(store.load("t")) == ["a", "b", "c"]
    store.save("t", spark.createDataFrame([("old", 0)], "k string, v int"), "parse", ttl_s=-5)
    assert keys(store.load("t")) == ["a", "b", "c"] and store.cleanup("t", 3600) == 1
    store.optimize("t", 1)
    assert keys(store.load("t")) == ["a", "b", "c"]


def test_files_and_memory(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.js").write_text("é")
    assert [r.content for r in read_text_files(spark, str(tmp_path), "*.py").collect()] == ["x = 1\n"]
    assert {r.path: r.content for r in from_memory(spark, {"m": "y"}).collect()} == {"m": "y"}


T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(k, float(ms), ok, u, T0 + dt.timedelta(seconds=s)) for k, ms, ok, u, s in rows], "operation_type string, duration_ms double, success boolean, user_id int, timestamp timestamp")


def test_sessions_break_at_the_gap(spark):
    rows = [("a", 1, True, 1, s) for s in (0, 30, 90, 149, 300)]
    got = sorted((r.started, r.n) for r in analytics.session_gaps(log(spark, rows)).collect())
    assert got == [(T0, 2), (T0 + dt.timedelta(seconds=90), 2), (T0 + dt.timedelta(seconds=300), 1)]


def test_breaker_opens_after_the_sixth_failure(spark):
    rows = [("a", 1, False, 1, s) for s in range(7)] + [("b", 1, False, 1, 10 * s) for s in range(7)] + [("a", 1, True, 1, 3)]
    got = sorted((r.operation_type, r.opened, r.half_open) for r in analytics.circuit_breaker(log(spark, rows)).collect())
    assert got == [("a", T0 + dt.timedelta(seconds=s), T0 + dt.timedelta(seconds=s + 60)) for s in (5, 6)]


def test_empty_logs(spark):
    empty = log(spark, []).limit(0)
    assert analytics.by_period(empty, "daily").count() == 0 and analytics.performance(empty).count() == 0 and analytics.session_gaps(empty).count() == 0


def stream(spark, tmp_path, rows, build, mode="append"):
    """What a stream over the rows, and then one much later row, gives."""
    folder = f"{tmp_path}/in"
    log(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    feed = streams.change_feed(spark, folder, log(spark, rows).schema, 1)
    name = "s" + str(abs(hash(str(tmp_path))))
    query = build(feed).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/check").start()
    query.processAllAvailable()
    log(spark, [("late", 1, False, 0, 10_000_000)]).coalesce(1).write.mode("append").parquet(folder)
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_period_stream(spark, tmp_path):
    rows = [("a", 10, True, 1, 5), ("a", 20, False, 1, 50), ("b", 5, True, 1, 70)]
    got = {(r.started, r.operation_type): (r.n, r.failures, r.avg_ms) for r in stream(spark, tmp_path, rows, lambda d: streams.periods(d, "1 minute"))}
    assert got == {(T0, "a"): (2, 1, 15.0), (T0 + dt.timedelta(minutes=1), "b"): (1, 0, 5.0)}


def test_heartbeat_stream(spark, tmp_path):
    got = stream(spark, tmp_path, [("p", 1, True, 7, s) for s in (0, 30, 200)], streams.heartbeats)
    assert sorted((r.user_id, r.started, r.n) for r in got) == [(7, T0, 2), (7, T0 + dt.timedelta(seconds=200), 1)]


def test_breaker_stream(spark, tmp_path):
    got = stream(spark, tmp_path, [("a", 1, False, 1, s) for s in range(6)] + [("b", 1, False, 1, 1)], streams.breaker)
    assert {r.operation_type for r in got} == {"a"} and {r.failures for r in got} == {6}


def test_graph_updates(spark, tmp_path):
    folder = f"{tmp_path}/versions"
    schema = "file_id string, content_hash string, version int"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: streams.graph_updates(streams.change_feed(spark, folder, schema), f"{tmp_path}/state", f"{tmp_path}/sink", f"{tmp_path}/check").awaitTermination()
    put([("a", "1", 1), ("b", "1", 1)])
    run()
    put([("a", "2", 2), ("b", "1", 2), ("c", "1", 1)])
    run()
    got = {(r.file_id, r.change, r.batch) for r in spark.read.parquet(f"{tmp_path}/sink").collect()}
    assert got == {("a", "added", 0), ("b", "added", 0), ("a", "changed", 1), ("c", "added", 1)}


def test_conflict_updates_come_in_tiers(spark, tmp_path):
    changes = spark.createDataFrame([("f", "Deletion")], "name string, change string")
    changes.write.parquet(f"{tmp_path}/in")
    calls = spark.createDataFrame([("x", "f")], "caller string, name string")
    seen = []
    streams.conflict_updates(streams.change_feed(spark, f"{tmp_path}/in", changes.schema), calls, lambda df, tier: seen.append((tier, [r.tier for r in df.collect()])), f"{tmp_path}/check").awaitTermination()
    assert seen == [(1, [1]), (2, [2])]


def test_batches(spark):
    assert [len(b) for b in streams.in_batches(spark.range(250).coalesce(1), 100)] == [100, 100, 50]
