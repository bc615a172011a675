"""A store of results, keyed by what they were made from, in partitioned Parquet."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables under a root folder; each save is a file set of its own under its key and never overwritten in place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, table: str, df: DataFrame, operation: str, config_hash: str = "", version: str = "1", ttl_s: int | None = None) -> None:
        """Adds rows under (operation, config_hash, version), stamped; ttl_s: seconds after which they don't count."""
        now = F.current_timestamp()
        expires = F.lit(None).cast("timestamp") if ttl_s is None else now + F.make_dt_interval(secs=F.lit(ttl_s))
        rows = df.withColumns({"operation": F.lit(operation), "config_hash": F.lit(config_hash), "version": F.lit(version), "stored_at": now, "expires_at": expires})
        rows.write.mode("append").partitionBy("operation", "version").parquet(f"{self.root}/{table}")

    def load(self, table: str, operation: str | None = None, config_hash: str | None = None, version: str | None = None) -> DataFrame:
        """Rows that haven't expired; the key's parts prune partitions."""
        df = self.spark.read.parquet(f"{self.root}/{table}")
        for name, value in (("operation", operation), ("config_hash", config_hash), ("version", version)):
            if value is not None:
                df = df.where(F.col(name).cast("string") == value)
        return df.where("expires_at IS NULL OR expires_at > current_timestamp()")

    def invalidate(self, table: str, column: str, pattern: str) -> int:
        """Drops rows whose column matches a regex; returns how many. The table is written anew, then swapped."""
        df = self.spark.read.parquet(f"{self.root}/{table}")
        gone = df.where(F.col(column).rlike(pattern)).count()
        if gone:
            self._replace(table, df.where(~F.coalesce(F.col(column).rlike(pattern), F.lit(False))))
        return gone

    def cleanup(self, table: str, older_than_s: int) -> int:
        """Drops rows stored longer ago than that, and expired ones; returns how many."""
        df = self.spark.read.parquet(f"{self.root}/{table}")
        keep = (F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("stored_at") <= older_than_s) & F.coalesce(F.col("expires_at") > F.current_timestamp(), F.lit(True))
        gone = df.where(~keep).count()
        if gone:
            self._replace(table, df.where(keep))
        return gone

    def optimize(self, table: str, files: int) -> None:
        self._replace(table, self.spark.read.parquet(f"{self.root}/{table}").coalesce(files))

    def backup(self, table: str, target: str) -> None:
        self.spark.read.parquet(f"{self.root}/{table}").write.mode("overwrite").partitionBy("operation", "version").parquet(target)

    def restore(self, table: str, source: str) -> None:
        self._replace(table, self.spark.read.parquet(source))

    def stats(self, table: str) -> DataFrame:
        """(operation, version, n, oldest, newest)."""
        return self.spark.read.parquet(f"{self.root}/{table}").groupBy("operation", "version").agg(F.count("*").alias("n"), F.min("stored_at").alias("oldest"), F.max("stored_at").alias("newest"))

    def healthy(self, table: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.root}/{table}").limit(1).count()
        except Exception:  # whatever the file system says, the answer is no
            return False
        return True

    def _replace(self, table: str, df: DataFrame) -> None:
        path, tmp, old = (f"{self.root}/{table}", f"{self.root}/_{table}-{uuid.uuid4().hex}", f"{self.root}/_old-{uuid.uuid4().hex}")
        df.write.partitionBy("operation", "version").parquet(tmp)
        jvm = self.spark.sparkContext._jvm
        make = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = make(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not (fs.rename(make(path), make(old)) and fs.rename(make(tmp), make(path))):
            raise OSError(f"{path} could not be replaced")
        fs.delete(make(old), True)
        self.spark.catalog.refreshByPath(path)


def read_text_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(file_id, path, content) of the files in a folder, one row a file; an empty file has none."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return df.select(F.col("path").alias("file_id"), "path", F.col("content").cast("string").alias("content"))


def from_memory(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(file_id, path, content) of a mapping from names to contents."""
    return spark.createDataFrame([(k, k, v) for k, v in files.items()], "file_id string, path string, content string")


def write_text_files(sources: DataFrame, folder: str) -> DataFrame:
    """Writes sources (path, content) as files under a folder, directories made as needed; (path, bytes) of what was written.

    Each file is written beside its place and then moved there, so that a task
    that runs again leaves the same. Null contents are not written; a path that
    leaves the folder is an error.
    """
    import pyarrow.fs as pafs

    def run(frames):
        system, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                if content is None:
                    continue
                parts = [p for p in path.split("/") if p not in ("", ".")]
                if ".." in parts or not parts:
                    raise ValueError(f"{path} is outside the folder")
                place, data = "/".join([root.rstrip("/"), *parts]), content.encode("utf-8", "surrogatepass")
                system.create_dir(place.rpartition("/")[0], recursive=True)
                tmp = f"{place}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(tmp) as out:
                    out.write(data)
                system.move(tmp, place)
                rows.append((path, len(data)))
            yield pd.DataFrame(rows, columns=["path", "bytes"])

    return sources.select("path", "content").mapInPandas(run, "path string, bytes bigint")


def save_jdbc(df: DataFrame, url: str, table: str, batch: int = 10_000, **options: str) -> None:
    """Appends df to a table of a SQL database, `batch` rows a statement, by as many connections as df has partitions."""
    df.write.mode("append").format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).save()


def load_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 1, **options: str) -> DataFrame:
    """A table of a SQL database; with a numeric column its range is read by `parts` connections."""
    split = {} if column is None else {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **split, **options).load()


REPOSITORIES = ("local", "git", "s3")


def repository(spark: SparkSession, kind: str, location: str, glob: str = "*") -> DataFrame:
    """(file_id, path, content) of a repository's files; path is relative to it, file_id the repository's location and path.

    local: a folder; git: a working tree, without its own .git; s3: a bucket and
    prefix through the Hadoop file system. Hosted services have to be cloned first.
    """
    if kind not in REPOSITORIES:
        raise ValueError(f"{kind}: one of {', '.join(REPOSITORIES)}; clone others first")
    root = location.rstrip("/") if kind != "s3" or "://" in location else f"s3a://{location.strip('/')}"
    files = read_text_files(spark, root, glob, recursive=True)
    plain = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    bare = F.regexp_replace(F.lit(root), "^[a-z0-9]+:/+", "/")
    files = files.withColumn("path", F.substring(plain, F.length(bare) + 2, 1 << 30))
    if kind == "git":
        files = files.where("path NOT LIKE '.git/%'")
    return files.withColumn("file_id", F.concat(F.lit(root + "/"), "path"))
