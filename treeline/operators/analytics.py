"""Operation analytics over a log (operation_type, duration_ms, success, user_id, timestamp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DURATION = "decimal(28,6)"
PERIODS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}


def mean_ms() -> Column:
    """The mean duration over a sum in decimals: the same whatever order the rows come in."""
    return F.sum(F.col("duration_ms").cast(DURATION)).cast("double") / F.count("duration_ms")


def by_period(ops: DataFrame, period: str) -> DataFrame:
    """(period, n, success_rate, avg_ms, users) of each period."""
    return ops.groupBy(F.date_trunc(PERIODS[period], "timestamp").alias("period")).agg(
        F.count("*").alias("n"), (F.sum(F.col("success").cast("bigint")) / F.count("*")).alias("success_rate"), mean_ms().alias("avg_ms"), F.count_distinct("user_id").alias("users")
    )


def summary(ops: DataFrame) -> DataFrame:
    """One row: n, success_rate, avg_ms, peak_hour (the first of the busiest), most_common."""
    # one row an hour and type: a small table whatever the log's size
    small = ops.groupBy(F.date_trunc("hour", "timestamp").alias("hour"), "operation_type").agg(F.count("*").alias("n"), F.sum(F.col("success").cast("bigint")).alias("good"), F.sum(F.col("duration_ms").cast(DURATION)).alias("ms"), F.count("duration_ms").alias("timed"))
    hours = small.groupBy("hour").agg(F.sum("n").alias("n")).agg(F.max(F.struct("n", (-F.unix_timestamp("hour")).alias("t"), "hour"))["hour"].alias("peak_hour"))
    kinds = small.groupBy("operation_type").agg(F.sum("n").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "operation_type"))["operation_type"].alias("most_common"))
    total = small.agg(F.sum("n").alias("n"), (F.sum("good") / F.sum("n")).alias("success_rate"), (F.sum("ms").cast("double") / F.sum("timed")).alias("avg_ms"))
    return total.crossJoin(hours).crossJoin(kinds)


def performance(ops: DataFrame) -> DataFrame:
    """(operation_type, n, p50, p95, p99, error_rate, per_second) with exact percentiles."""
    span = F.greatest(F.lit(1), F.unix_timestamp(F.max("timestamp")) - F.unix_timestamp(F.min("timestamp")))
    p = F.percentile("duration_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = ops.groupBy("operation_type").agg(F.count("*").alias("n"), p.alias("p"), (F.sum((~F.col("success")).cast("bigint")) / F.count("*")).alias("error_rate"), (F.count("*") / span).alias("per_second"))
    return out.select("operation_type", "n", F.round(F.col("p")[0], 4).alias("p50"), F.round(F.col("p")[1], 4).alias("p95"), F.round(F.col("p")[2], 4).alias("p99"), "error_rate", "per_second")


def performance_approx(ops: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """The same with mergeable sketches, for logs where sorting durations would be too much."""
    p = F.percentile_approx("duration_ms", [0.5, 0.95, 0.99], accuracy)
    return ops.groupBy("operation_type").agg(F.count("*").alias("n"), p.alias("p"))


def top_operations(ops: DataFrame, k: int = 3) -> DataFrame:
    return ops.groupBy("operation_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "operation_type").limit(k)


def cache_stats(log: DataFrame, by: str) -> DataFrame:
    """(by, n, hits, misses, hit_rate) of a log with cache_hit."""
    hit = F.col("cache_hit").cast("bigint")
    return log.groupBy(by).agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.sum(1 - hit).alias("misses"), (F.sum(hit) / F.count("*")).alias("hit_rate"))


def insights(ops: DataFrame, slow_ms: float = 100.0, most_errors: float = 0.1) -> DataFrame:
    """(operation_type, insight, severity, confidence): types that are slow or fail often."""
    perf = performance(ops)
    kinds = F.array(
        F.when(F.col("p95") > slow_ms, F.struct(F.lit("Performance").alias("insight"), F.when(F.col("p95") > 2 * slow_ms, "critical").otherwise("warning").alias("severity"))),
        F.when(F.col("error_rate") > most_errors, F.struct(F.lit("Reliability").alias("insight"), F.lit("warning").alias("severity"))),
    )
    sure = 1 - 1 / F.sqrt(F.col("n"))
    found = perf.select("operation_type", sure.alias("confidence"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("i"))
    return found.select("operation_type", "i.insight", "i.severity", "confidence")


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def session_gaps(events: DataFrame, gap_s: int = 60, key: str = "user_id") -> DataFrame:
    """(key, started, ended, n): runs of events of a key without a gap of gap_s seconds or more."""
    order = Window.partitionBy(key).orderBy("timestamp")
    far = _micros("timestamp") - F.lag(_micros("timestamp")).over(order) >= gap_s * 1_000_000
    rows = events.withColumn("opens", F.coalesce(far, F.lit(True)).cast("int"))
    rows = rows.withColumn("session", F.sum("opens").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"), F.count("*").alias("n")).drop("session")


def circuit_breaker(ops: DataFrame, most: int = 5, window_s: int = 30, pause_s: int = 60) -> DataFrame:
    """(operation_type, opened, half_open): failures after which more than `most` lie in the last window_s seconds.

    Time is cut into buckets of that length, and each failure stands in its own
    and the next one: so few types of operations make many small windows.
    """
    size = window_s * 1_000_000
    failures = ops.where(~F.col("success")).withColumn("at", _micros("timestamp"))
    mine = F.floor(F.col("at") / size)
    failures = failures.withColumn("bucket", F.explode(F.array(mine, mine + 1))).withColumn("own", F.col("bucket") == mine)
    order = Window.partitionBy("operation_type", "bucket").orderBy("at").rangeBetween(-size, 0)
    failures = failures.withColumn("recent", F.count("*").over(order)).where("own")
    return failures.where(F.col("recent") > most).select("operation_type", F.col("timestamp").alias("opened"), (F.col("timestamp") + F.make_dt_interval(secs=F.lit(pause_s))).alias("half_open")).distinct()


def stale(log: DataFrame, now: str, max_age_s: int) -> DataFrame:
    """(node_id, last_access): nodes not touched for longer than max_age_s before now."""
    last = log.groupBy("node_id").agg(F.max("executed_at").alias("last_access"))
    return last.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_access") > max_age_s)


def timeline(log: DataFrame) -> DataFrame:
    """(node_id, steps, n): each node's operations in order of time, then id."""
    ordered = F.array_sort(F.collect_list(F.struct("executed_at", "operation_id", "operation_type")))
    return log.groupBy("node_id").agg(F.array_join(F.transform(ordered, lambda x: x["operation_type"]), ">").alias("steps"), F.count("*").alias("n"))


def lineage_of(log: DataFrame, operation_type: str | None = None, source_hash: str | None = None) -> DataFrame:
    """Operations of a type, or from a version of the source."""
    out = log
    if operation_type is not None:
        out = out.where(F.col("operation_type") == operation_type)
    return out if source_hash is None else out.where(F.col("input_hash") == source_hash)
