"""Similarity search by cosine, exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Queries of one pass over the vectors.
MOST_QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(vectors: DataFrame, query: list[float], k: int = 10, least: float = -1.0) -> DataFrame:
    """(vec_id, score): the k most similar with a score of at least `least`; ties by id. One pass, k rows a task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select("vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "vec_id").limit(k)


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = -1.0) -> DataFrame:
    """(query_id, vec_id, score, rank) for a table of queries (query_id, embedding).

    The k best of each query: every batch of vectors keeps its own k, so that
    only these are ranked.
    """
    scored = scores(vectors, queries, least, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def scores(vectors: DataFrame, queries: DataFrame, least: float = -1.0, k: int | None = None) -> DataFrame:
    """(query_id, vec_id, score) of all vectors and queries with a score of at least `least`, rounded to 6 places; with k the best k of each batch.

    A stated set of queries against all vectors: queries come to the driver in
    blocks of at most MOST_QUERIES, one pass over the vectors and one matrix
    product a batch for each block. Nulls and vectors of other lengths or of
    zeros have no score.
    """
    spark = vectors.sparkSession
    keyed = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).where("q IS NOT NULL").orderBy("query_id")
    out, kind = None, f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"
    id_type, held = to_arrow_type(queries.schema["query_id"].dataType), []

    def block(rows: list) -> DataFrame:
        width = max(len(r.q) for r in rows)
        rows = [r for r in rows if len(r.q) == width]
        q = np.array([r.q for r in rows], np.float64).reshape(len(rows), width)
        unit = spark.sparkContext.broadcast((q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), [r.query_id for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, ids = unit.value
            own = pa.array(ids, id_type)
            for batch in batches:
                lists = batch.column(1)
                good = np.flatnonzero((pc.fill_null(pc.list_value_length(lists), 0).to_numpy() == width) & pc.is_valid(lists).to_numpy(zero_copy_only=False))
                if not len(good) or not width:
                    continue
                x = lists.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), width)
                norm = np.linalg.norm(x, axis=1)
                s = np.round((x @ q.T) / np.where(norm > 0, norm, np.nan)[:, None], 6)
                i, j = np.nonzero(s >= least)
                if k is not None and len(i):
                    vec = batch.column(0).take(pa.array(good[i])).to_numpy()
                    order = np.lexsort((vec, -s[i, j], j))
                    i, j = i[order], j[order]
                    begin = np.searchsorted(j, j)  # j is sorted: where its query begins
                    first = np.arange(len(j)) - begin < k
                    i, j = i[first], j[first]
                yield pa.RecordBatch.from_arrays([own.take(pa.array(j)), batch.column(0).take(pa.array(good[i])), pa.array(s[i, j])], ["query_id", "vec_id", "score"])

        return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).mapInArrow(run, kind)

    for row in keyed.toLocalIterator():
        held.append(row)
        if len(held) == MOST_QUERIES:
            out, held = block(held) if out is None else out.unionByName(block(held)), []
    if held:
        out = block(held) if out is None else out.unionByName(block(held))
    return spark.createDataFrame([], kind) if out is None else out
