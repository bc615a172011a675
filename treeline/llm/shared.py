"""What several operators need: tables that outlive lost executors, and groups from links."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a session with a local master may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again.

    This cuts the lineage in a way that survives the loss of any executor, and
    the planner knows the size of what it reads: a small table is then
    broadcast by its measured size, a large one is joined by sort and merge.
    """
    path = f"{shared_dir(df.sparkSession)}/treeline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_NONE = (1 << 63) - 1


def identity(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """What names a document: its id, null being the greatest, and a hash of its text, whose last bit tells that the id is null. Rows alike in id and text are one document."""
    mark = F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(F.col(doc_id).isNull().cast("bigint"))
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_NONE)), mark


def least_rows(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of the rows a[k] and b[k]; root[i] leads, in one step or more, to the least row of i's component."""
    while len(a):
        ra, rb = root[a], root[b]
        while True:
            ga, gb = root[ra], root[rb]
            if np.array_equal(ga, ra) and np.array_equal(gb, rb):
                break
            ra, rb = ga, gb
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))


def settled(root: np.ndarray) -> np.ndarray:
    """For each row the least row of its component."""
    while not np.array_equal(root[root], root):
        root = root[root]
    return root


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """Connected components: (node, root), root the least node of its component.

    edges has two BIGINT columns, (a, b), in any order; loops and repeats are
    allowed and nodes without an edge do not come back. Alternates large-star
    and small-star steps, so the number of rounds grows with the logarithm of
    the longest chain, and no step gathers more than one node's neighbours'
    minimum. Every round is written to the shared folder. No edges, no rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = written(edges, "links")

    def tally(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = tally(state)
    for _ in range(most_rounds):
        both = state.select("a", "b").union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        large = large.distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        small = small.union(down.select("a", F.col("m").alias("b"))).distinct()
        state = written(small, "links")
        after = tally(state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components: no fixed point; raise most_rounds")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
