"""What surrounds the operators: limits, analysis results, sessions, progress, SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.functions import sql
from treeline.operators import service
from treeline.plans.registry import query
from treeline.plans.structure import _LINES, _findings
from treeline.sources import trees
from treeline.storage import read


@query(
    "limited_paths",
    "SELECT page_id, path FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"
    " WHERE regexp_matches(path, '^(?:.*/)?en/[^/]*$') AND NOT starts_with(path, 'www.') ORDER BY path, CAST(page_id AS VARCHAR) LIMIT 25",
)
def limited_paths(spark, sf_dir):
    """An analysis that takes in some paths, leaves out others, and reads 25 files: the limit is the feature."""
    found = service.limited(trees.page_sources(spark, sf_dir), ("**/en/*",), ("www.**",), 25)
    return found.select(F.col("file_id").cast("bigint").alias("page_id"), "path")


@query("capped_matches", _LINES + "SELECT doc_id, line, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY CAST(doc_id AS VARCHAR), line) AS n FROM f) WHERE n <= 1000")
def capped_matches(spark, sf_dir):
    """At most a thousand matches of each rule, as a request may have."""
    return service.capped(_findings(spark, sf_dir), order=("file_id", "line")).select("doc_id", "line", "rule_id")


@query("analyze_nodes", "SELECT p_partkey, 'file' AS node_type, 'parts/part_' || p_partkey || '.py' AS name FROM part UNION ALL SELECT p_partkey, 'function', 'part_' || p_partkey FROM part")
def analyze_nodes(spark, sf_dir):
    nodes, _ = service.analyze(trees.part_code(spark, sf_dir))
    return nodes.select(F.col("file_id").cast("bigint").alias("p_partkey"), "node_type", "name")


@query(
    "analyze_edges",
    "SELECT p_partkey::VARCHAR AS source_id, p_partkey || '::part_' || p_partkey AS target_id, 'Contains' AS edge_type FROM part"
    " UNION ALL SELECT p.p_partkey || '::part_' || p.p_partkey, q.p_partkey || '::part_' || q.p_partkey, 'Calls' FROM part p JOIN part q ON q.p_partkey = p.p_size"
    " UNION ALL SELECT p_partkey::VARCHAR, 'json', 'Imports' FROM part UNION ALL SELECT p_partkey::VARCHAR, 'parts.part_' || p_size, 'Imports' FROM part",
)
def analyze_edges(spark, sf_dir):
    return service.analyze(trees.part_code(spark, sf_dir))[1]


def _log(spark, sf_dir):
    """The events as a log of sessions: a user is a session, its props a file."""
    stage = F.when(F.col("event_type") == "view", "parsing").when(F.col("event_type") == "click", "indexing").otherwise("storage")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("props").alias("file_id"), stage.alias("stage"), F.col("value").alias("duration_ms"), F.lit(2).alias("nodes"), F.lit(1).alias("edges"),
        (F.col("event_type") == "signup").cast("bigint").alias("conflicts"), F.when(F.col("event_type") != "purchase", F.col("event_type") == "view").alias("cache_hit"), (F.col("event_type") != "error").alias("success"), F.col("ts").alias("timestamp"),
    )


_MS = "coalesce(CAST(sum(CAST(value AS DECIMAL(28,6))) FILTER (WHERE {}) AS DOUBLE), 0)"


@query(
    "session_metrics",
    "SELECT user_id AS session_id, count(DISTINCT props) AS files_analyzed, 2 * count(*) AS nodes_created, count(*) AS edges_created, count(*) FILTER (WHERE event_type = 'signup') AS conflicts_detected,"
    " CASE WHEN count(*) FILTER (WHERE event_type <> 'purchase') > 0 THEN count(*) FILTER (WHERE event_type = 'view') / count(*) FILTER (WHERE event_type <> 'purchase') END AS cache_hit_rate, count(*) FILTER (WHERE event_type = 'error') AS errors,"
    f" {_MS.format("event_type = 'view'")} AS parsing_ms, {_MS.format("event_type = 'click'")} AS indexing_ms, {_MS.format("event_type NOT IN ('view', 'click')")} AS storage_ms FROM events GROUP BY user_id",
)
def session_metrics(spark, sf_dir):
    return service.session_metrics(_log(spark, sf_dir))


@query(
    "session_progress",
    "WITH r AS (SELECT user_id AS session_id, ts AS timestamp, row_number() OVER w AS files_processed, count(*) OVER (PARTITION BY user_id) AS total_files, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 86400000000 AS since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, props)),"
    " s AS (SELECT *, files_processed * 10 // total_files AS share FROM r), t AS (SELECT *, lag(share, 1, 0) OVER w AS share0, lag(since, 1, 0) OVER w AS since0 FROM s WINDOW w AS (PARTITION BY session_id ORDER BY files_processed))"
    " SELECT session_id, files_processed, total_files, timestamp FROM t WHERE share > share0 OR since > since0 OR files_processed = total_files",
)
def session_progress(spark, sf_dir):
    """Each tenth and each day of a session, as its watcher is told."""
    return service.progress(_log(spark, sf_dir), 10, 86_400)


@query("sql_match", """SELECT event_id, regexp_extract(props, '^\\{"k": ([^,{}]+)\\}$', 1) AS v FROM events WHERE regexp_matches(props, '^\\{"k": [^,{}]+\\}$')""")
def sql_match(spark, sf_dir):
    """A pattern from SQL, as a table function."""
    sql.register(spark)
    read(spark, sf_dir, "events").createOrReplaceTempView("sql_match_events")
    return spark.sql("""SELECT event_id, get_json_object(m.captures, '$.V') AS v FROM sql_match_events, LATERAL ast_match(props, 'json', '{"k": $V}', 'smart') m""")


@query("sql_parse", """SELECT event_id, 'pair' AS kind, CAST(1 AS BIGINT) AS n FROM events WHERE props LIKE '{"k": %'""")
def sql_parse(spark, sf_dir):
    """Nodes from SQL, as a table function."""
    sql.register(spark)
    read(spark, sf_dir, "events").createOrReplaceTempView("sql_parse_events")
    return spark.sql("SELECT event_id, kind, count(*) AS n FROM sql_parse_events, LATERAL ast_parse(props, 'json') WHERE kind = 'pair' GROUP BY event_id, kind")
