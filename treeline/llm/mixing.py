"""Operator 5: mixing sources to target weights, by Pareto order sampling.

A source's target is shared among its documents by size: document i expects
e_i = target * x_i / X copies, x_i being 1 + the root of its characters. The
whole part of e_i is certain. The fractions p_i of a source add up to a whole
number k, and k documents get one copy more: those with the least
u/(1 - u) / (p_i / (1 - p_i)), u being uniform from a digest of the id. So
every sample has exactly the target's size, whatever is drawn.

The k least of a source are found without bringing the source into one task: a
histogram of the ranks per source tells the bin in which the k-th lies, all
bins below are in, and only that bin's rows are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.shared import read, written

#: Relative weights of sources; one that isn't named has DEFAULT_WEIGHT.
WEIGHTS: dict[str, int] = {"src0": 5, "src1": 3, "src2": 2}
DEFAULT_WEIGHT = 1
SEED = "mix-1"
_BINS = 1 << 16
_C = "__mix_"


def mix(docs: DataFrame, weights: dict[str, int] | None = None, total: int | None = None, default_weight: int = DEFAULT_WEIGHT, seed: str = SEED) -> DataFrame:
    """docs with the column copies BIGINT >= 1; rows with none are left out. A column of that name is replaced.

    total: the size of the mix in documents, as many as docs by default; the
    sources' targets add up to it exactly. A null source is a source of its own
    with the default weight; a null or negative n_chars counts as 0; rows with
    a null id share one u. Repeated rows are documents of their own; ties go by
    doc_id, then n_chars. An empty table, or sources that all weigh 0, give no
    rows. Columns of docs may have any names but those that begin with __mix_.
    """
    found = _mixed(docs, weights, total, default_weight, seed)
    return found.select(*(F.col(f"`{c}`") for c in docs.columns if c != "copies"), F.col(_C + "copies").alias("copies"))


def _mixed(docs: DataFrame, weights: dict[str, int] | None = None, total: int | None = None, default_weight: int = DEFAULT_WEIGHT, seed: str = SEED) -> DataFrame:
    """docs with the column __mix_copies, of which `mix` tells."""
    weights = WEIGHTS if weights is None else weights
    w = F.lit(default_weight).cast("bigint")
    for name, value in weights.items():
        w = F.when(F.col("source") == name, F.lit(int(value)).cast("bigint")).otherwise(w)
    size = F.lit(1).cast("bigint") + F.floor(F.sqrt(F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0)).cast("double")))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))

    sources = docs.groupBy("source").agg(F.count("*").alias(_C + "n"), F.sum(size).alias(_C + "all")).withColumn(_C + "w", w)
    # one row a source: the running weight over them orders sources, not documents
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    docs_n = F.lit(int(total)).cast("bigint") if total is not None else F.sum(_C + "n").over(whole)
    cum, weight = F.sum(_C + "w").over(order), F.sum(_C + "w").over(whole)
    share = F.expr(f"({_C}total * {_C}cum) div {_C}weight - ({_C}total * ({_C}cum - {_C}w)) div {_C}weight")
    sums = sources.withColumn(_C + "total", docs_n).withColumn(_C + "cum", cum).withColumn(_C + "weight", weight)
    split = sums.where(F.col(_C + "weight") > 0).select(F.col("source").alias(_C + "source"), _C + "all", share.alias(_C + "target"))
    targets = written(split, "mix-targets")

    def ranked(df: DataFrame) -> DataFrame:
        df = df.withColumn(_C + "x", size).withColumn(_C + "u", u)
        df = df.join(targets, F.col("source").eqNullSafe(F.col(_C + "source")))
        df = df.withColumn(_C + "whole", F.expr(f"({_C}target * {_C}x) div {_C}all")).withColumn(_C + "rem", F.expr(f"({_C}target * {_C}x) % {_C}all"))
        odds = F.col(_C + "u") / (F.lit(1.0) - F.col(_C + "u"))
        against = (F.col(_C + "all") - F.col(_C + "rem")).cast("double") / F.col(_C + "rem").cast("double")
        df = df.withColumn(_C + "q", F.when(F.col(_C + "rem") > 0, odds * against))
        return df.withColumn(_C + "bin", F.floor(F.col(_C + "q") / (F.lit(1.0) + F.col(_C + "q")) * F.lit(float(_BINS))))

    narrow = ranked(docs.select("doc_id", "source", "n_chars"))
    bins = narrow.where(F.col(_C + "q").isNotNull()).groupBy(_C + "source", _C + "bin").agg(F.count("*").alias(_C + "n"), F.sum(_C + "rem").alias(_C + "sum"), F.max(_C + "all").alias(_C + "all"))
    by_source = Window.partitionBy(_C + "source")
    below = F.coalesce(F.sum(_C + "n").over(by_source.orderBy(_C + "bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn(_C + "k", F.expr(f"sum({_C}sum) over (partition by {_C}source) div {_C}all")).withColumn(_C + "left", F.col(_C + "k") - below)
    # the bin in which the k-th rank lies, and how many of it are in
    edge = written(bins.where((F.col(_C + "left") > 0) & (F.col(_C + "left") <= F.col(_C + "n"))).select(F.col(_C + "source").alias(_C + "s2"), F.col(_C + "bin").alias(_C + "edge"), _C + "left"), "mix-edges")

    full = ranked(docs).join(edge, F.col(_C + "source").eqNullSafe(F.col(_C + "s2")), "left")
    at_edge = F.col(_C + "bin") == F.col(_C + "edge")
    inside = F.coalesce(F.col(_C + "bin") < F.col(_C + "edge"), F.lit(False))
    rest = full.where(~F.coalesce(at_edge, F.lit(False))).withColumn(_C + "copies", F.col(_C + "whole") + inside.cast("bigint"))
    rank = F.row_number().over(Window.partitionBy(_C + "source").orderBy(_C + "q", F.col("doc_id").asc_nulls_last(), F.col("n_chars").asc_nulls_last()))
    border = full.where(at_edge).withColumn(_C + "copies", F.col(_C + "whole") + (rank <= F.col(_C + "left")).cast("bigint"))
    names = [*(F.col(f"`{c}`") for c in docs.columns), _C + "copies"]
    some = F.col(_C + "copies") > 0
    return rest.where(some).select(*names).unionByName(border.where(some).select(*names))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus mixed to the WEIGHTS of its sources: how many copies each document gets, by `mix`."""
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))


_CASES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())
OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, source, n_chars, 1 + CAST(floor(sqrt(CAST(greatest(coalesce(n_chars, 0), 0) AS DOUBLE))) AS BIGINT) AS x,
    (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, count(*) AS n, CAST(sum(x) AS BIGINT) AS all_x, CASE source {_CASES} ELSE {DEFAULT_WEIGHT} END AS w FROM d GROUP BY source),
c AS (SELECT source, all_x, w, sum(n) OVER () AS total, sum(w) OVER (ORDER BY source NULLS LAST) AS cum, sum(w) OVER () AS weight FROM s),
t AS (SELECT source, all_x, CAST((total * cum) // weight - (total * (cum - w)) // weight AS BIGINT) AS target FROM c),
e AS (SELECT doc_id, d.source, n_chars, u, all_x, (target * x) // all_x AS whole, (target * x) % all_x AS rem
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT source, CAST(sum(rem) AS BIGINT) // any_value(all_x) AS k FROM e GROUP BY source),
r AS (SELECT e.*, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN rem > 0 THEN (u / (1.0 - u)) * (CAST(all_x - rem AS DOUBLE) / CAST(rem AS DOUBLE)) END NULLS LAST, doc_id NULLS LAST, n_chars NULLS LAST) AS rank FROM e)
SELECT doc_id, r.source, n_chars, CAST(whole + CASE WHEN rem > 0 AND rank <= k THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source
WHERE whole + CASE WHEN rem > 0 AND rank <= k THEN 1 ELSE 0 END > 0
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: every document as many times as it has copies, with the columns of docs, on the terms of `mix`."""
    mixed = _mixed(docs).withColumn(_C + "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(_C + "copies"))))
    return mixed.select(*(F.col(f"`{c}`") for c in docs.columns))
