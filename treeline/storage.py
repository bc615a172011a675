"""Tables in the shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a session with a local master may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="treeline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, tag: str = "table") -> DataFrame:
    """df written to the shared folder and read again, so that plans of loops don't grow and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/treeline/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the tables behind a plan for which `spread` makes a task, at least.
TASK_BYTES = 8 << 20


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by columns, file_id by default, to at least two tasks a core and one for TASK_BYTES of what it reads.

    A scan makes a task of a row group at least, so that a table of a few MB
    would be parsed by one core. Adaptive execution would go by compressed
    bytes, and node rows are ten times as large when they are sorted: with the
    number given, it leaves the partitions as they are.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    read = sum(s for s in sizes if s < 1 << 50)  # what isn't a file has no size
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, read // TASK_BYTES), *by or ["file_id"])


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def listing(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of change of what a folder holds."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
