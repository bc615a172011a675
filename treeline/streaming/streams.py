"""Streams: change feeds, graph updates, period analytics, heartbeats and a circuit breaker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from treeline.operators.analytics import mean_ms
from treeline.storage import exists

LATENESS = "10 minutes"


def change_feed(spark: SparkSession, folder: str, schema: str | StructType, max_files: int = 100) -> DataFrame:
    """New Parquet files of a folder, or of all that a pattern of paths fits, as a stream, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def run_once(writer: DataStreamWriter, checkpoint: str) -> None:
    """Runs a stream over all that is there, then ends; errors are raised here."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def periods(ops: DataFrame, length: str = "1 hour", slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """(started, operation_type, n, failures, avg_ms) in tumbling windows, or sliding ones."""
    w = F.window("timestamp", length, slide) if slide else F.window("timestamp", length)
    out = ops.withWatermark("timestamp", lateness).groupBy(w.alias("w"), "operation_type").agg(
        F.count("*").alias("n"), F.sum((~F.col("success")).cast("bigint")).alias("failures"), mean_ms().alias("avg_ms")
    )
    return out.select(F.col("w.start").alias("started"), "operation_type", "n", "failures", "avg_ms")


def heartbeats(pings: DataFrame, timeout: str = "60 seconds", lateness: str = LATENESS) -> DataFrame:
    """(user_id, started, ended, n): sessions that end where no ping came for the timeout."""
    out = pings.withWatermark("timestamp", lateness).groupBy(F.session_window("timestamp", timeout).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def breaker(ops: DataFrame, most: int = 5, window: str = "30 seconds", slide: str = "10 seconds", lateness: str = LATENESS) -> DataFrame:
    """(operation_type, opened, failures): windows with more than `most` failures."""
    failed = ops.where(~F.col("success")).withWatermark("timestamp", lateness)
    out = failed.groupBy(F.window("timestamp", window, slide).alias("w"), "operation_type").agg(F.count("*").alias("failures"))
    return out.where(F.col("failures") > most).select("operation_type", F.col("w.end").alias("opened"), "failures")


def graph_updates(versions: DataFrame, state: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Writes what each micro-batch of versions (file_id, content_hash) changes against the last known hashes.

    state holds a folder of hashes for each batch; sink gets (file_id, change,
    batch). A batch that runs again writes the same files, so nothing doubles.
    """
    from treeline.operators.versions import changed_files

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("file_id").agg(F.max_by("content_hash", "version").alias("content_hash"))
        before = f"{state}/{batch_id - 1}"
        # only the first batch has no state before it; a state that can't be read is an error
        old = spark.read.parquet(before) if exists(spark, before) else newest.where("false")
        changes = changed_files(old.join(newest.select("file_id"), "file_id", "left_semi"), newest).where("change <> 'same'")
        changes.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        old.join(newest.select("file_id"), "file_id", "left_anti").unionByName(newest).write.mode("overwrite").parquet(f"{state}/{batch_id}")

    return versions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def conflict_updates(changes: DataFrame, calls: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str, dependents: DataFrame | None = None) -> StreamingQuery:
    """For each micro-batch of symbol changes emits tier 1 at once, then tier 2 with callers, then tier 3 with all that depends on them (dependents: name, n)."""
    from treeline.operators.versions import conflicts

    def step(batch: DataFrame, batch_id: int) -> None:
        emit(conflicts(batch), 1)
        emit(conflicts(batch, calls), 2)
        if dependents is not None:
            emit(conflicts(batch, calls, dependents), 3)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_progress(done: DataFrame, totals: DataFrame, emit: Callable[[DataFrame], None], checkpoint: str, state: str) -> StreamingQuery:
    """After each micro-batch of processed files (session_id, file_id) emits (session_id, files_processed, total_files).

    totals: session_id, total_files. A file counts once a session, however often
    it is processed; a batch that runs again counts the same.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{state}/{batch_id - 1}"
        new = batch.select("session_id", "file_id").distinct()
        known = spark.read.parquet(before).unionByName(new).distinct() if exists(spark, before) else new
        known.write.mode("overwrite").parquet(f"{state}/{batch_id}")
        counts = spark.read.parquet(f"{state}/{batch_id}").groupBy("session_id").agg(F.count("*").alias("files_processed"))
        emit(counts.join(totals, "session_id").join(new.select("session_id").distinct(), "session_id", "left_semi").select("session_id", "files_processed", "total_files"))

    return done.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF-OPEN"


def advance(state: tuple, at: float, success: bool, most: int = 5, window_s: float = 30, pause_s: float = 60) -> tuple[tuple, str | None]:
    """One step of a breaker. state: (name, when it opened, times of recent failures). Returns the next state, and its name where it changed.

    More than `most` failures within window_s seconds open it; after pause_s
    seconds it is half open, and the next operation closes it or opens it again.
    """
    name, since, recent = state
    if name == OPEN:
        if at - since < pause_s:
            return state, None
        name = HALF_OPEN
    if name == HALF_OPEN:
        return ((CLOSED, 0.0, []), CLOSED) if success else ((OPEN, at, []), OPEN)
    recent = [t for t in recent if at - t <= window_s] + ([] if success else [at])
    if len(recent) > most:
        return (OPEN, at, []), OPEN
    return (CLOSED, 0.0, recent), None


def breaker_states(ops: DataFrame, most: int = 5, window_s: float = 30, pause_s: float = 60) -> DataFrame:
    """(operation_type, at, state): each change of each operation's breaker, over a stream (operation_type, timestamp, success).

    State is a few numbers an operation: the failures within the window, `most` at most.
    """
    out = "operation_type string, at timestamp, state string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else (CLOSED, 0.0, [])
        state = (state[0], state[1], list(state[2]))
        rows = []
        events = sorted((t, s) for f in frames for t, s in zip(f["timestamp"], f["success"]))
        for at, success in events:
            state, changed = advance(state, at.timestamp(), bool(success), most, window_s, pause_s)
            if changed:
                rows.append((key[0], at, changed))
        held.update(state)
        yield pd.DataFrame(rows, columns=["operation_type", "at", "state"])

    kept = "name string, since double, recent array<double>"
    return ops.select("operation_type", "timestamp", "success").groupBy("operation_type").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def in_batches(df: DataFrame, size: int = 100):
    """Rows in lists of `size`, partition by partition; the driver holds one partition at a time."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
