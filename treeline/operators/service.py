"""What a code service offers around the operators: limits, errors and recovery, sessions, progress, descriptors."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.operators import graph, symbols
from treeline.operators.patterns import STRICTNESS
from treeline.operators.rules import ORDER
from treeline.operators.scan import applies_col
from treeline.sources.languages import pairs
from treeline.sources.parsers import PARSERS
from treeline.storage import cut

#: Paths that an analysis takes in, and those it leaves out, unless it is told otherwise.
INCLUDE, EXCLUDE = ("**/*", "*"), ("**/node_modules/**", "node_modules/**", "**/target/**", "target/**")
LANGUAGES = tuple(sorted({language for _, language in pairs()}))
#: What one request may ask for.
MOST_PATTERNS, MOST_MATCHES = 50, 1000
STRATEGIES = ("retry", "skip", "fallback", "abort", "partial")


def limited(sources: DataFrame, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, max_files: int | None = None) -> DataFrame:
    """sources (path, ...) that the globs let in; with max_files the first so many by path."""
    kept = sources.where(F.col("path").isNotNull() & applies_col(F.col("path"), list(include), list(exclude)))
    return kept if max_files is None else kept.orderBy("path", *(c for c in sources.columns if c == "file_id")).limit(max_files)


def capped(matches: DataFrame, key: str = "rule_id", most: int = MOST_MATCHES, order: tuple[str, ...] = ("file_id", "pre")) -> DataFrame:
    """The first `most` matches of each pattern, in order.

    No pattern's matches meet in one task: each partition keeps its own first
    ones, and only these are ranked.
    """
    mine = Window.partitionBy(key, "__p").orderBy(*order)
    some = matches.withColumn("__p", F.spark_partition_id()).withColumn("__n", F.row_number().over(mine)).where(F.col("__n") <= most)
    return some.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= most).drop("__n", "__p")


def analyze(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, node_type, name, file_id, start_char, end_char) and edges (source_id, target_id, edge_type) of parsed sources.

    A file is a node; its functions are nodes that it contains, by the nearest
    one around them; calls are resolved by name, imports name their target.
    """
    found = cut(symbols.extract(sources), "symbols")  # each source is parsed once
    defs, calls, imports = (f(sources, found) for f in (symbols.functions, symbols.calls, symbols.imports))
    own = defs.withColumn("node_id", F.concat_ws("::", "file_id", "name"))
    files = sources.select(F.col("file_id").alias("node_id"), F.lit("file").alias("node_type"), F.col("path").alias("name"), "file_id", F.lit(0).alias("start_char"), F.length("content").alias("end_char"))
    nodes = files.unionByName(own.select("node_id", F.lit("function").alias("node_type"), "name", "file_id", "start_char", "end_char"))
    inner = own.select("file_id", F.col("node_id").alias("symbol_id"), F.col("start_char").alias("pre"), (F.col("end_char") - 1).alias("end_pre"))
    around = graph.contains_edges(inner)
    contains = own.select(F.col("node_id").alias("target_id"), "file_id").join(around, "target_id", "left")
    contains = contains.select(F.coalesce("source_id", "file_id").alias("source_id"), "target_id", F.lit("Contains").alias("edge_type"))
    # a call belongs to the innermost function that it stands in, or to its file
    spots = calls.select("file_id", "name", "start_char").join(own.select("file_id", "node_id", F.col("start_char").alias("a"), F.col("end_char").alias("b")), "file_id", "left")
    spots = spots.groupBy("file_id", "name", "start_char").agg(F.max(F.when((F.col("a") <= F.col("start_char")) & (F.col("start_char") < F.col("b")), F.struct("a", "node_id")))["node_id"].alias("by"))
    callers = spots.select("file_id", F.coalesce("by", "file_id").alias("caller_id"), "name")
    resolved = graph.resolve_calls(callers, own.select("file_id", F.col("node_id").alias("symbol_id"), "name")).select("source_id", "target_id", "edge_type")
    imported = imports.select(F.col("file_id").alias("source_id"), F.col("target").alias("target_id"), F.lit("Imports").alias("edge_type"))
    return nodes, contains.unionByName(resolved).unionByName(imported)


# --- sessions ---------------------------------------------------------------


def session_metrics(log: DataFrame) -> DataFrame:
    """One row a session of a log (session_id, file_id, stage, duration_ms, nodes, edges, conflicts, cache_hit, success)."""
    ms = lambda stage: F.coalesce(F.sum(F.when(F.col("stage") == stage, F.col("duration_ms").cast("decimal(28,6)"))).cast("double"), F.lit(0.0))
    hit = F.col("cache_hit").cast("bigint")
    return log.groupBy("session_id").agg(
        F.count_distinct("file_id").alias("files_analyzed"), F.sum("nodes").alias("nodes_created"), F.sum("edges").alias("edges_created"), F.sum("conflicts").alias("conflicts_detected"),
        (F.sum(hit) / F.count("cache_hit")).alias("cache_hit_rate"), F.sum((~F.col("success")).cast("bigint")).alias("errors"),
        *(ms(s).alias(f"{s}_ms") for s in ("parsing", "indexing", "storage")),
    )


def progress(done: DataFrame, step: int = 10, every_s: int = 5) -> DataFrame:
    """(session_id, files_processed, total_files, timestamp): what a watcher of each session is told.

    done: session_id, timestamp - a row for each processed file. A file is told
    of if it is the first of another `step` per cent, or of another `every_s`
    seconds since the session's first, and the last one always.
    """
    order = Window.partitionBy("session_id").orderBy("timestamp", *(c for c in ("file_id",) if c in done.columns))
    whole = Window.partitionBy("session_id")
    rows = done.withColumns({"files_processed": F.row_number().over(order).cast("bigint"), "total_files": F.count("*").over(whole)})
    share = F.floor(F.col("files_processed") * (100 // step) / F.col("total_files"))
    since = F.floor((F.unix_micros(F.col("timestamp").cast("timestamp")) - F.min(F.unix_micros(F.col("timestamp").cast("timestamp"))).over(whole)) / (every_s * 1_000_000))
    rows = rows.withColumns({"__share": share, "__since": since})
    new = (F.col("__share") > F.coalesce(F.lag("__share").over(order), F.lit(0))) | (F.col("__since") > F.coalesce(F.lag("__since").over(order), F.lit(0)))
    return rows.withColumn("__new", new).where(F.col("__new") | (F.col("files_processed") == F.col("total_files"))).select("session_id", "files_processed", "total_files", "timestamp")


# --- errors -----------------------------------------------------------------


def error(code: str, message: Column, file: Column, line: Column | None = None, operation: str = "parse") -> Column:
    """An error with its context, as the column `_error` of partial results."""
    return F.struct(F.lit(code).alias("code"), message.alias("message"), file.alias("file"), (F.lit(None) if line is None else line).cast("int").alias("line"), F.lit(operation).alias("op"))


def envelope(good: DataFrame, failed: DataFrame, key: str = "file_id") -> DataFrame:
    """Partial results: the rows of good with a null `_error`, and one row for each of failed (key, _error)."""
    kind = failed.schema["_error"].dataType
    return good.withColumn("_error", F.lit(None).cast(kind)).unionByName(failed.select(key, "_error"), allowMissingColumns=True)


def suggested(code: str) -> str:
    """The way to go on after an error of a kind."""
    return {"storage": "retry", "timeout": "retry", "concurrency": "retry", "parse": "partial", "unsupported_language": "fallback", "too_large": "skip", "analysis": "skip", "pattern": "abort", "rule": "abort"}.get(code, "abort")


# --- descriptors ------------------------------------------------------------


@dataclass(frozen=True)
class Capabilities:
    """What this engine can do, for callers that ask before they send work."""

    languages: tuple[str, ...] = LANGUAGES
    own_parsers: tuple[str, ...] = field(default_factory=lambda: tuple(sorted(PARSERS)))
    strictness: tuple[str, ...] = tuple(STRICTNESS)
    rule_keys: tuple[str, ...] = tuple(ORDER)
    edge_types: tuple[str, ...] = graph.EDGE_TYPES
    recovery: tuple[str, ...] = STRATEGIES
    most_patterns: int = MOST_PATTERNS
    most_matches: int = MOST_MATCHES
    most_bytes: int = 10 << 20
    incremental: str = "file"
    transactions: bool = False

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


def rule_schema() -> dict[str, Any]:
    """A JSON Schema of rule documents."""
    text = {"type": "string"}
    rule = {"$ref": "#/$defs/rule"}
    stop = {"anyOf": [{"enum": ["neighbor", "end"]}, rule]}
    relation = {"allOf": [rule, {"properties": {"stopBy": stop, "field": text}}]}
    point = {"type": "object", "properties": {"line": {"type": "integer", "minimum": 0}, "column": {"type": "integer", "minimum": 0}}, "required": ["line", "column"]}
    keys: dict[str, Any] = {
        "pattern": {"anyOf": [text, {"type": "object", "properties": {"context": text, "selector": text, "strictness": {"enum": list(STRICTNESS)}}, "required": ["context"]}]},
        "kind": text, "regex": text, "matches": text, "not": rule, "all": {"type": "array", "items": rule}, "any": {"type": "array", "items": rule},
        "range": {"type": "object", "properties": {"start": point, "end": point}, "required": ["start", "end"]},
        "nthChild": {"anyOf": [{"type": ["integer", "string"]}, {"type": "object", "properties": {"position": {"type": ["integer", "string"]}, "ofRule": rule, "reverse": {"type": "boolean"}}, "required": ["position"]}]},
        **dict.fromkeys(("inside", "has", "precedes", "follows"), relation),
    }
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["id", "language", "rule"],
        "properties": {
            "id": text, "language": {"enum": list(LANGUAGES)}, "rule": rule, "message": text, "note": text, "url": text, "severity": {"enum": ["hint", "info", "warning", "error", "off"]},
            "constraints": {"type": "object", "additionalProperties": rule}, "utils": {"type": "object", "additionalProperties": rule}, "transform": {"type": "object"}, "fix": {}, "rewriters": {"type": "array"},
            "labels": {"type": "object"}, "files": {"type": "array", "items": text}, "ignores": {"type": "array", "items": text}, "metadata": {"type": "object"},
        },
        "$defs": {"rule": {"type": "object", "minProperties": 1, "properties": keys}},
    }
