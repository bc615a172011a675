"""Operation logs: periods, latencies, sessions, lineage, and the same as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from treeline.operators import analytics
from treeline.plans.registry import query
from treeline.sources import trees
from treeline.storage import read, shared_dir
from treeline.streaming import streams


def _period(name: str, period: str, unit: str) -> None:
    sql = f"SELECT date_trunc('{unit}', ts)::TIMESTAMP AS period, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') / count(*) AS success_rate, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / count(value) AS avg_ms, count(DISTINCT user_id) AS users FROM events GROUP BY 1"

    @query(name, sql)
    def run(spark, sf_dir):
        return analytics.by_period(trees.operations(spark, sf_dir), period)


for _name, _unit in analytics.PERIODS.items():
    _period(f"ops_{_name}", _name, _unit)


@query(
    "ops_summary",
    "WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events GROUP BY 1), k AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)"
    " SELECT count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') / count(*) AS success_rate, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / count(value) AS avg_ms,"
    " (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) AS peak_hour, (SELECT event_type FROM k ORDER BY n DESC, event_type LIMIT 1) AS most_common FROM events",
)
def ops_summary(spark, sf_dir):
    return analytics.summary(trees.operations(spark, sf_dir))


_SPAN = "count(*) / greatest(1, epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))"
_PERF = f"SELECT event_type AS operation_type, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, count(*) FILTER (WHERE event_type = 'error') / count(*) AS error_rate, {_SPAN} AS per_second FROM events GROUP BY 1"


@query("latency_percentiles", _PERF)
def latency_percentiles(spark, sf_dir):
    return analytics.performance(trees.operations(spark, sf_dir))


@query("latency_approx")
def latency_approx(spark, sf_dir):
    """The same with mergeable sketches; SQL has other ones, so the tests compare it with exact ranks."""
    return analytics.performance_approx(trees.operations(spark, sf_dir))


@query("error_rates", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'error') / count(*) AS error_rate FROM events GROUP BY 1")
def error_rates(spark, sf_dir):
    failed = (~F.col("success")).cast("bigint")
    return trees.operations(spark, sf_dir).groupBy(F.date_trunc("day", "timestamp").alias("day")).agg(F.count("*").alias("n"), F.sum(failed).alias("failures"), (F.sum(failed) / F.count("*")).alias("error_rate"))


@query("top_operations", "SELECT event_type AS operation_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, operation_type LIMIT 3")
def top_operations(spark, sf_dir):
    return analytics.top_operations(trees.operations(spark, sf_dir))


@query("ops_insights", f"WITH p AS ({_PERF}) SELECT operation_type, 'Performance' AS insight, CASE WHEN p95 > 200 THEN 'critical' ELSE 'warning' END AS severity, 1 - 1 / sqrt(n) AS confidence FROM p WHERE p95 > 100 UNION ALL SELECT operation_type, 'Reliability', 'warning', 1 - 1 / sqrt(n) FROM p WHERE error_rate > 0.1")
def ops_insights(spark, sf_dir):
    return analytics.insights(trees.operations(spark, sf_dir))


@query(
    "session_gaps",
    "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),"
    " s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session",
)
def session_gaps(spark, sf_dir):
    return analytics.session_gaps(trees.operations(spark, sf_dir), 3600)


@query(
    "circuit_breaker",
    "SELECT DISTINCT event_type AS operation_type, ts AS opened, ts + INTERVAL 60 SECOND AS half_open FROM (SELECT event_type, ts, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error') WHERE recent > 3",
)
def circuit_breaker(spark, sf_dir):
    return analytics.circuit_breaker(trees.operations(spark, sf_dir), most=3, window_s=3600)


@query("cache_hit_rate", "SELECT user_id AS node_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS hits, count(*) FILTER (WHERE event_type <> 'view') AS misses, count(*) FILTER (WHERE event_type = 'view') / count(*) AS hit_rate FROM events GROUP BY 1")
def cache_hit_rate(spark, sf_dir):
    return analytics.cache_stats(trees.lineage(spark, sf_dir), "node_id")


@query("stale_nodes", "SELECT user_id AS node_id, max(ts) AS last_access FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00'")
def stale_nodes(spark, sf_dir):
    return analytics.stale(trees.lineage(spark, sf_dir), "2024-01-31 00:00:00", 12 * 3600)


@query("lineage_timeline", "SELECT user_id AS node_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS steps, count(*) AS n FROM events GROUP BY 1")
def lineage_timeline(spark, sf_dir):
    return analytics.timeline(trees.lineage(spark, sf_dir))


@query("lineage_by_operation", "SELECT user_id AS node_id, event_id AS operation_id, sha256(props) AS input_hash, sha256(props || event_type) AS output_hash FROM events WHERE event_type = 'purchase'")
def lineage_by_operation(spark, sf_dir):
    return analytics.lineage_of(trees.lineage(spark, sf_dir), "purchase").select("node_id", "operation_id", "input_hash", "output_hash")


@query("lineage_affected", "SELECT a.user_id AS node_id, count(*) AS n FROM events a WHERE sha256(props) IN (SELECT sha256(props) FROM events WHERE event_type = 'error') GROUP BY 1")
def lineage_affected(spark, sf_dir):
    """Nodes whose operations read a version that some operation failed on."""
    log = trees.lineage(spark, sf_dir)
    bad = log.where(~F.col("success")).select("input_hash").distinct()
    return log.join(bad, "input_hash", "left_semi").groupBy("node_id").agg(F.count("*").alias("n"))


@query("stream_periods", "SELECT date_trunc('hour', ts)::TIMESTAMP AS started, event_type AS operation_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / count(value) AS avg_ms FROM events GROUP BY 1, 2")
def stream_periods(spark, sf_dir):
    """The hourly report as a stream that runs over all there is and then ends."""
    path = f"{shared_dir(spark)}/treeline/stream-{uuid.uuid4().hex}"
    log = read(spark, sf_dir, "events")
    # a pattern, as the table may be one file as well as a folder
    feed = streams.change_feed(spark, f"{sf_dir}/event[s].parquet", log.schema).select(F.col("event_type").alias("operation_type"), F.col("value").alias("duration_ms"), (F.col("event_type") != "error").alias("success"), F.col("ts").cast("timestamp").alias("timestamp"))
    out = streams.periods(feed, lateness="365 days")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out")

    streams.run_once(out.writeStream.outputMode("complete").foreachBatch(write), f"{path}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{path}/out")
