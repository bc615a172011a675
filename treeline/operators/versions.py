"""Versions of tables: content addressing, differences, overlays and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How sure each tier of conflict detection is.
TIERS = {1: 0.6, 2: 0.9, 3: 0.95}


def content_hash(content: Column | str) -> Column:
    """SHA-256 in hexadecimal: the id of a content."""
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def fast_hash(content: Column | str, seed: int | None = None) -> Column:
    """A 64-bit hash for joins, not an id."""
    c = F.col(content) if isinstance(content, str) else content
    return F.xxhash64(c) if seed is None else F.xxhash64(F.lit(seed), c)


def dedup_content(sources: DataFrame) -> DataFrame:
    """(content_hash, file_id, copies): one file for each content, the one with the least id."""
    return sources.groupBy(content_hash("content").alias("content_hash")).agg(F.min("file_id").alias("file_id"), F.count("*").alias("copies"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, change): added, removed, changed or same, by (file_id, content_hash)."""
    o, n = old.select("file_id", F.col("content_hash").alias("old_hash")), new.select("file_id", F.col("content_hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") == F.col("new_hash"), "same").otherwise("changed")
    return o.join(n, "file_id", "full_outer").select("file_id", change.alias("change"))


def unseen(sources: DataFrame, store: DataFrame) -> DataFrame:
    """Sources whose content isn't in a content-addressed store (content_hash): all that has to be parsed again."""
    return sources.withColumn("content_hash", content_hash("content")).join(store.select("content_hash").distinct(), "content_hash", "left_anti")


def table_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that were added or removed, with multiplicity, and a column change."""
    added = new.exceptAll(old).withColumn("change", F.lit("added"))
    return added.unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))


def overlay(base: DataFrame, upserts: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """base with a delta on top: rows of deletes and upserts leave, upserts enter."""
    gone = deletes.select(*keys).unionByName(upserts.select(*keys)).distinct()
    return base.join(gone, keys, "left_anti").unionByName(upserts.select(*base.columns))


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change, old_signature, new_signature) of symbols (name, signature): Addition, Deletion or SignatureChange."""
    o, n = old.select("name", F.col("signature").alias("old_signature")), new.select("name", F.col("signature").alias("new_signature"))
    change = F.when(F.col("o.name").isNull(), "Addition").when(F.col("n.name").isNull(), "Deletion").when(~F.col("old_signature").eqNullSafe(F.col("new_signature")), "SignatureChange")
    both = o.alias("o").join(n.alias("n"), F.col("o.name") == F.col("n.name"), "full_outer")
    return both.select(F.coalesce("o.name", "n.name").alias("name"), change.alias("change"), "old_signature", "new_signature").where("change IS NOT NULL")


def conflicts(changes: DataFrame, calls: DataFrame | None = None, dependents: DataFrame | None = None) -> DataFrame:
    """(name, change, tier, confidence, callers, severity) of changed symbols.

    Tier 1 sees the change alone; tier 2 that someone calls it (calls: caller,
    name); tier 3 how much depends on it (dependents: name, n).
    """
    out = changes.where("change <> 'Addition'").withColumn("tier", F.lit(1)).withColumn("callers", F.lit(0).cast("bigint"))
    if calls is not None:
        n = calls.groupBy("name").agg(F.count_distinct("caller").alias("found"))
        out = out.drop("callers").join(n, "name", "left").withColumn("callers", F.coalesce("found", F.lit(0)).cast("bigint")).drop("found")
        out = out.withColumn("tier", F.when(F.col("callers") > 0, 2).otherwise(F.col("tier")))
    if dependents is not None:
        out = out.join(dependents.select("name", F.col("n").alias("deep")), "name", "left").withColumn("tier", F.when(F.col("deep") > 0, 3).otherwise(F.col("tier")))
        out = out.withColumn("callers", F.greatest("callers", F.coalesce("deep", F.lit(0)))).drop("deep")
    sure = F.lit(TIERS[1])
    for tier in (2, 3):
        sure = F.when(F.col("tier") == tier, TIERS[tier]).otherwise(sure)
    severity = F.when(F.col("callers") >= 20, "high").when(F.col("callers") > 0, "medium").otherwise("low")
    return out.select("name", "change", "tier", sure.alias("confidence"), "callers", severity.alias("severity"))
