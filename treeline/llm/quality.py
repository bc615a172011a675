"""Operator 7: quality rules, by the frequency of lines across documents.

Lines are normalised and hashed; for each host the distinct documents with a
line are counted. A line that too large a share of its host's documents have
is boilerplate: it is removed from all of them. A document that loses most of
its text by this is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.shared import identity, read, written

#: A line is removed if more than this share of its host's documents have it, and more than MOST_DOCS.
MOST_SHARE = 0.01
MOST_DOCS = 10
#: A document is rejected if less than this share of its characters in lines stays.
LEAST_KEPT = 0.5


def normalised(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(line, "[ \t\r]+", " "), "[0-9]+", "0")))


def line_rules(docs: DataFrame, host: str = "source", most_share: float = MOST_SHARE, most_docs: int = MOST_DOCS, least_kept: float = LEAST_KEPT) -> DataFrame:
    """The documents that stay: doc_id, host, text without removed lines, n_lines, n_removed.

    Lines end with a line feed and are compared without regard to case, numbers
    and repeated blanks; blank lines are never counted nor removed. A null host
    is a host of its own. Rows alike in id and text are one document: they are
    counted once and stay or go together. A null or empty text has no line that
    could be removed and stays as it is, with 0 lines. Ties can't arise: a line
    is over the limits or it isn't. Other columns are left out.
    """
    i, t = identity()
    base = docs.select("doc_id", F.col(f"`{host}`").alias("host"), "text", i.alias("i"), t.alias("t"))
    lines = F.split("text", "\n", -1)
    full = F.coalesce(F.col("text") != "", F.lit(False))
    # of each document's lines only hashes travel; they are normalised once
    rows = base.where(full).select("i", "t", "host", F.posexplode(lines).alias("at", "line"))
    rows = written(rows.withColumn("norm", normalised(F.col("line"))).where("norm <> ''").select("i", "t", "host", "at", F.xxhash64("norm").alias("h")), "lines")
    hosts = base.select("host", "i", "t").groupBy("host").agg(F.count_distinct("i", "t").alias("docs"))
    counts = rows.groupBy("host", "h").agg(F.count_distinct("i", "t").alias("n")).where(F.col("n") > most_docs)
    common = counts.alias("c").join(hosts.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    common = written(common.where(F.col("n") > F.col("docs") * F.lit(float(most_share))).select(F.col("c.host").alias("c_host"), F.col("h").alias("c_h")), "common")
    marked = rows.join(common, F.col("host").eqNullSafe(F.col("c_host")) & (F.col("h") == F.col("c_h")), "left")
    # rows that are there twice have each of their lines twice
    told = marked.groupBy("i", "t").agg(F.count_distinct("at").alias("n_lines"), F.collect_set(F.when(F.col("c_h").isNotNull(), F.col("at"))).alias("removed"))
    joined = base.where(full).join(told, ["i", "t"], "left").withColumn("removed", F.when(F.size("removed") > 0, F.col("removed"))).withColumn("lines", lines)
    kept = F.filter("lines", lambda x, i: ~F.array_contains(F.col("removed"), i))
    joined = joined.withColumn("kept", F.when(F.col("removed").isNull(), F.col("lines")).otherwise(kept))

    def chars(column: str) -> Column:
        return F.aggregate(F.transform(column, F.length), F.lit(0).cast("bigint"), lambda a, x: a + x)

    stays = F.col("removed").isNull() | (chars("kept") >= chars("lines") * F.lit(float(least_kept)))
    told = joined.where(stays).select(
        "doc_id",
        "host",
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
    # those without any line are all of one text: they take no part in the join
    none = F.lit(0).cast("bigint")
    return told.unionByName(base.where(~full).select("doc_id", "host", "text", none.alias("n_lines"), none.alias("n_removed")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that `line_rules` keep of the whole table, a source being a host."""
    return line_rules(read(spark, sf_dir, "documents"))


_NORM = "trim(lower(regexp_replace(regexp_replace(line, '[ \\t\\r]+', ' ', 'g'), '[0-9]+', '0', 'g')))"
OP7_SQL = f"""
WITH l AS (
  SELECT doc_id, source, pos, line, {_NORM} AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)),
hosts AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
common AS (
  SELECT l.source, norm FROM l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE norm <> ''
  GROUP BY l.source, norm, docs HAVING count(DISTINCT doc_id) > {MOST_DOCS} AND count(DISTINCT doc_id) > docs * {MOST_SHARE}),
marked AS (SELECT l.*, c.norm IS NOT NULL AS gone FROM l LEFT JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.norm = c.norm),
back AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text, count(*) FILTER (WHERE norm <> '') AS n_lines,
    count(*) FILTER (WHERE gone) AS n_removed, coalesce(sum(length(line)) FILTER (WHERE NOT gone), 0) AS kept, sum(length(line)) AS total
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source AS host, CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text ELSE coalesce(b.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN back b ON d.doc_id = b.doc_id
WHERE coalesce(n_removed, 0) = 0 OR kept >= total * {LEAST_KEPT}
"""
