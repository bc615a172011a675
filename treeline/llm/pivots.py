"""Operator 9: embedding near-dedup, by a pivot-permutation index.

A vector is described by its NEAREST pivots in the order of their distance.
Near vectors see the pivots in nearly the same order, so they stand together in
the inverted lists of several pivots. Inside a list, two vectors that share at
least SHARED pivots are candidates - in the list of the least pivot they share,
so that each pair comes up once - and candidates are verified by their cosine.

The number of pivots grows with the root of the number of vectors, up to
MOST_PIVOTS, as do the lists: placing vectors and comparing lists both cost
about n^1.5. Long lists are cut into blocks, and blocks are compared two by two,
each pair of them a task's unit. No two pivots are close to one another: a dense
group of vectors holds one, not many whose order among its members would be left
to chance.

Equal vectors are one to begin with, a class by its hashes. What a pair of
blocks tells leaves its task as one row a vector - how many near ones it has
there, and the least of its component - so that a group of k near copies sends k
rows, not k^2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.shared import components, least_rows, read, settled, written

COSINE = 0.95
NEAREST = 8
SHARED = 3
#: So many pivots for each root of the number of vectors.
DENSITY = 4
#: So many vectors are drawn for each pivot, as those too close to another one are dropped.
SPARE = 2
#: The index is fitted on this many pivots at most, drawn from SPARE times as many vectors: the bound of what the driver and the workers hold. All vectors are indexed.
MOST_PIVOTS = 1 << 15
#: Vectors in a block of a list.
BLOCK = 8192
SEED = 3


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width) if len(vectors) else np.zeros((0, width), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _apart(drawn: np.ndarray, most: int, limit: float) -> np.ndarray:
    """Up to `most` of the unit vectors, in their order, without those whose cosine with one kept before is over `limit`."""
    kept = np.zeros((0, drawn.shape[1]), drawn.dtype)
    for s in range(0, len(drawn), 1024):
        part = drawn[s : s + 1024]
        free = np.ones(len(part), bool)
        for k in range(0, len(kept), 8192):
            free &= (part @ kept[k : k + 8192].T <= limit).all(1)
        part = part[free]
        close = part @ part.T > limit
        free = np.ones(len(part), bool)
        for i in range(len(part)):
            if free[i]:
                free[i + 1 :] &= ~close[i, i + 1 :]
        kept = np.concatenate([kept, part[free]])[:most]
        if len(kept) == most:
            break
    return kept


def pairs(vectors: DataFrame, cosine: float = COSINE, density: float = DENSITY, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine): ids a < b of different vectors whose cosine is at least `cosine`, rounded to 6 places.

    vectors: vec_id (an integer), embedding ARRAY<FLOAT>. Of equal vectors the
    one with the least id stands for all. The vectors of each length are a
    space of their own. Left out are rows with a null id or embedding,
    embeddings that are empty, have a null or a nan in them or are all zero. Of
    rows with the same id and embedding one counts; the same id with other
    embeddings pairs as each of them, but not with itself. Approximate: see
    README for the recall. Few vectors make one list, which is exact. An empty
    table gives no rows; further columns are left out, whatever their names.
    """
    one = written(_classes(_good(vectors)), "vectors")
    found = _near_of_all(one, cosine, density, block, True)
    return found.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cosine").alias("cosine"))


def groups(vectors: DataFrame, cosine: float = COSINE, density: float = DENSITY, block: int = BLOCK) -> DataFrame:
    """(vec_id, class_id, n_links) of every vector that counts, on the terms of `pairs`.

    n_links: how many other rows, copies among them, are within `cosine`.
    class_id: the least id that links lead to, its own where there are none. A
    row is an id with an embedding; an id with several embeddings has the links
    of all of them and the least class of theirs.
    """
    good = _good(vectors)
    one = written(_classes(good), "vectors")
    near = written(_near_of_all(one, cosine, density, block, False), "near")
    links = near.groupBy("k", "k2").agg(F.sum("links").alias("links"))
    nodes = one.select("node", "id", "k", "k2", "copies")
    roots = components(near.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = nodes.join(links, ["k", "k2"], "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = written(nodes.withColumn("links", F.col("copies") - 1 + F.coalesce("links", F.lit(0))), "nodes")
    least = nodes.groupBy("root").agg(F.min("id").alias("class_id"))
    nodes = nodes.join(least, "root").select("k", "k2", "class_id", "links")
    # a class may hold a third of all rows: of this join the side of the rows is the one that can be split
    rows = good.select("id", "k", "k2").distinct().join(nodes, ["k", "k2"])
    return rows.groupBy(F.col("id").alias("vec_id")).agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links"))


def _good(vectors: DataFrame) -> DataFrame:
    """(id, v, k, k2) of the rows that count: k and k2 are two hashes of v, which name it."""
    good = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    return good.where(fine).withColumns({"k": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), "v")})


def _classes(good: DataFrame) -> DataFrame:
    """(node, id, v, k, k2, copies): each different vector with a number of its own, the least id that has it, and how many ids do."""
    once = good.groupBy("k", "k2", "id").agg(F.any_value("v").alias("v"))
    one = once.groupBy("k", "k2").agg(F.min("id").alias("id"), F.any_value("v").alias("v"), F.count("*").alias("copies"))
    return one.withColumn("node", F.monotonically_increasing_id()).select("node", "id", "v", "k", "k2", "copies")


def _near_of_all(one: DataFrame, cosine: float, density: float, block: int, as_pairs: bool) -> DataFrame:
    """What the blocks of the vectors of each length tell."""
    out = None
    sizes = {r.w: r.n for r in one.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect()}  # one row a length
    for width, n in sorted(sizes.items()):
        if n > 1:
            found = _near(one.where(F.size("v") == width), width, n, cosine, density, block, as_pairs)
            out = found if out is None else out.unionByName(found)
    return one.sparkSession.createDataFrame([], _PAIRS if as_pairs else _LINKS) if out is None else out


_PAIRS = "a bigint, b bigint, cosine double"
_LINKS = "node bigint, k bigint, k2 bigint, links bigint, root bigint"


def _near(one: DataFrame, width: int, n: int, cosine: float, density: float, block: int, as_pairs: bool) -> DataFrame:
    spark = one.sparkSession
    many = min(n, MOST_PIVOTS, math.ceil(density * math.sqrt(n)))
    # pivots are vectors drawn by hash; they come as Arrow buffers, SPARE * MOST_PIVOTS at most
    drawn = one.orderBy(F.xxhash64(F.lit(SEED), "v"), "node").limit(SPARE * many).select("v").toArrow().column(0).combine_chunks()
    # no two pivots within root 2 of the distance that a pair may have
    chosen = _apart(_unit(_matrix(drawn, width)), many, 2 * cosine - 1)
    pivots, many = spark.sparkContext.broadcast(chosen), len(chosen)
    near = min(NEAREST, many)
    shared = min(SHARED, near) if many > NEAREST else 1

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for batch in batches:
            x = _unit(_matrix(batch.column(1), width))
            for s in range(0, len(x), 4096):
                sims = x[s : s + 4096] @ p.T
                top = np.argpartition(-sims, near - 1, axis=1)[:, :near]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)
                m = len(top)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m * near + 1, near, dtype=np.int32)), pa.array(top.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*(c.slice(s, m) for c in batch.columns), lists], [*fields, "order"])

    fields = ["node", "v", "id", "k", "k2", "copies"]
    placed = written(one.select(*fields).mapInArrow(describe, "node bigint, v array<float>, id bigint, k bigint, k2 bigint, copies bigint, order array<int>"), "orders")
    rows = placed.withColumn("pivot", F.explode("order"))
    lists = written(rows.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")), "lists")
    blocks = rows.join(lists, "pivot").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a vector meets every block of its list, as the lower or the higher one of the two
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("pivot", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") <= F.col("other")).alias("low"), "v", "order", "node", "id", "k", "k2", "copies")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if tuple(key[i]) != now and parts:
                    yield from compare(now, parts)
                    parts = []
                now = tuple(key[i])
                part = batch.slice(i, j - i)
                parts.append((part.column(3).to_numpy(zero_copy_only=False), _matrix(part.column(4), width), part.column(5).flatten().to_numpy().reshape(-1, near), *(part.column(k).to_numpy() for k in range(6, 11))))
        if parts:
            yield from compare(now, parts)

    def compare(key: tuple, parts: list) -> Iterator[pa.RecordBatch]:
        low, x, order, node, ids, k, k2, copies = (np.concatenate(c) for c in zip(*parts))
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        x, pivot = _unit(x.astype(np.float64)), key[0]
        own = key[1] == key[2]
        left, right = (np.arange(len(node)),) * 2 if own else (np.flatnonzero(low), np.flatnonzero(~low))
        single = x.astype(np.float32)
        for s in range(0, len(left), 512):
            rows = left[s : s + 512]
            i, j = np.nonzero(single[rows] @ single[right].T >= cosine - 1e-3)
            i, j = rows[i], right[j]
            if own:
                i, j = i[i < j], j[i < j]
            same = order[i][:, :, None] == order[j][:, None, :]
            common = np.where(same.any(2), order[i], np.iinfo(np.int32).max)
            keep = (same.any(2).sum(1) >= shared) & (common.min(1) == pivot) if len(i) else np.zeros(0, bool)
            i, j = i[keep], j[keep]
            c = np.einsum("ij,ij->i", x[i], x[j])
            i, j, c = i[c >= cosine], j[c >= cosine], c[c >= cosine]
            if not as_pairs:
                for one, other in ((i, j), (j, i)):
                    links += np.bincount(one, copies[other], len(links)).astype(np.int64)
                least_rows(root, i, j)
                continue
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(np.round(np.minimum(c, 1.0), 6))], ["a", "b", "cosine"])
        if not as_pairs:
            at = np.flatnonzero(links)
            root = settled(root)[at]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[at], k[at], k2[at], links[at], node[root])], [c.split()[0] for c in _LINKS.split(", ")])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = blocks.repartition(parts, "pivot", "lo", "hi").sortWithinPartitions("pivot", "lo", "hi")
    return ordered.mapInArrow(verify, _PAIRS if as_pairs else _LINKS)


def op9_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding of the table with its class and its number of near ones, copies among them: `groups` of the whole table."""
    return groups(read(spark, sf_dir, "embeddings"))


OP9_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= {COSINE}),
r(vec_id, seen) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.seen = p.a),
c AS (SELECT vec_id, min(seen) AS class_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM c LEFT JOIN n ON vec_id = a
"""
