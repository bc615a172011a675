"""Region labels for any parent-child data: pre, end_pre, depth, child_idx."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from treeline.model import COLUMNS, NODE, Node, Tree
from treeline.sources.languages import ALIASES
from treeline.sources.parsers import parse, parse_brackets, parse_ranges
from treeline.storage import cut, spread

#: Further tries of a parser that raised, under the recovery "retry".
ATTEMPTS = 2


def label_paths(rows: DataFrame, levels: list[str], keep: list[str]) -> DataFrame:
    """Labels rows that carry the sort keys of all their ancestors.

    levels: columns outermost first; a node at depth d has the first d + 1 of
    them set and null below. The pairs of a file's paths must differ. One
    shuffle by file_id and one sort by the path; the labels of whole files are
    worked out in Arrow batches.
    """
    kept = {f.name: f for f in rows.select(*keep).schema.fields}
    schema = StructType([StructField("file_id", StringType()), *(StructField(c, IntegerType()) for c in _LABELS), *kept.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_files(batches):
            found = _path_labels(table.column("file_id"), [table.column(c) for c in levels])
            out = [table.column("file_id"), *(pa.array(x.astype(np.int32), mask=x < -1) for x in found), *(table.column(c) for c in keep)]
            yield from pa.table(out, names=["file_id", *_LABELS, *keep]).to_batches()

    columns = dict.fromkeys(["file_id", *levels, *keep])
    return spread(rows.select(*columns)).sortWithinPartitions("file_id", *(F.col(c).asc_nulls_first() for c in levels)).mapInArrow(run, schema)


_LABELS = ["pre", "end_pre", "parent", "depth", "child_idx"]


def _differs(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value is another than the one before it; null is a value."""
    a, b = column.slice(1), column.slice(0, max(0, len(column) - 1))
    other = pc.if_else(pc.and_(pc.is_null(a), pc.is_null(b)), False, pc.fill_null(pc.not_equal(a, b), True))
    return np.concatenate([np.ones(min(1, len(column)), bool), other.to_numpy()])


def _path_labels(files: pa.ChunkedArray, levels: list[pa.ChunkedArray]) -> list[np.ndarray]:
    """_LABELS of rows of whole files in the order of their paths; -2 is null."""
    n = len(files)
    at = np.arange(n)
    depth = sum(c.is_valid().to_numpy().astype(np.int64) for c in levels) - 1
    new = _differs(files)
    file = np.maximum.accumulate(np.where(new, at, 0))
    pre, end, parent = at - file, np.full(n, -2), np.full(n, -2)
    up = n + file  # where the parent stands: all roots of a file are children of one place, and so are all nodes without their parent
    parent[depth == 0] = -1
    for d, column in enumerate(levels):
        first = np.maximum.accumulate(np.where(new, at, 0))  # of the rows with the same d outer keys
        if d:
            here = depth == d
            there = here & (depth[first] == d - 1)
            parent[there] = pre[first[there]]
            up[here] = np.where(there, first, 2 * n + file)[here]
        new = new | _differs(column)
        here = depth == d
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, n))[np.cumsum(new) - 1]
        end[here] = (pre + sizes - 1)[here]
    order = np.argsort(up, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = up[order][1:] != up[order][:-1]
    index = np.empty(n, np.int64)
    index[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return [pre, end, parent, depth, index]


def whole_files(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Batches in the order of file_id as tables of whole files, of `least` rows at least."""

    def table(parts: list[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(parts).combine_chunks()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= least:
            ids = batch.column("file_id")
            whole = pc.index(ids, ids[-1]).as_py() if ids[-1].is_valid else 0  # the last file may go on
            if whole > 0:
                yield table([*held[:-1], batch.slice(0, whole)])
                held = [batch.slice(whole)]
    if held:
        yield table(held)


def label_tree(edges: DataFrame) -> DataFrame:
    """Labels (file_id, id, parent_id, ord) rows of any depth: file_id, id, pre, end_pre, parent, depth, child_idx.

    Siblings go by ord, then id. Paths grow by one join a level, each round
    reduced to the deepest nodes; a subtree's size is a count over the paths
    that run through its node. Rows that no root leads to - in a cycle, or with
    a parent that isn't there - are left out.
    """
    step = F.array(F.struct(F.col("ord"), F.col("id")))
    level = cut(edges.where("parent_id IS NULL").select("file_id", "id", step.alias("path")), "level")
    done = level
    while True:  # rows in a cycle are never reached, so the levels end
        level = edges.where("parent_id IS NOT NULL").alias("c").join(level.alias("p"), (F.col("c.file_id") == F.col("p.file_id")) & (F.col("c.parent_id") == F.col("p.id")))
        level = level.select("c.file_id", "c.id", F.concat("p.path", F.array(F.struct(F.col("c.ord").alias("ord"), F.col("c.id").alias("id")))).alias("path"))
        level = cut(level, "level")
        if level.isEmpty():
            break
        done = done.unionByName(level)
    sizes = done.select("file_id", F.explode("path").alias("s")).groupBy("file_id", F.col("s.id").alias("id")).agg(F.count("*").alias("size"))
    rows = done.join(sizes, ["file_id", "id"]).withColumn("parent_id", F.when(F.size("path") > 1, F.element_at("path", F.lit(-2))["id"]))
    rows = rows.withColumn("pre", (F.row_number().over(Window.partitionBy("file_id").orderBy("path")) - 1).cast("int"))
    tops = rows.select("file_id", F.col("id").alias("parent_id"), F.col("pre").alias("parent"))
    rows = rows.join(tops, ["file_id", "parent_id"], "left")
    index = F.row_number().over(Window.partitionBy("file_id", "parent_id").orderBy("pre")) - 1
    return rows.select("file_id", "id", "pre", (F.col("pre") + F.col("size") - 1).cast("int").alias("end_pre"), F.coalesce("parent", F.lit(-1)).alias("parent"), (F.size("path") - 1).alias("depth"), index.cast("int").alias("child_idx"))


def recovered(content: str, language: str, recovery: str) -> Tree | None:
    """The tree of a text whatever its parser does: see parse_sources."""
    for _ in range(ATTEMPTS if recovery == "retry" else 1):
        try:
            return parse(content, language)
        except Exception:  # a parser may be anyone's (`parsers.register`)
            if recovery == "abort":
                raise
    if recovery == "retry":
        return parse(content, language)
    if recovery == "fallback":
        return Tree(content, parse_brackets(content), language)
    return None if recovery == "skip" else Tree(content, Node("ERROR", 0, len(content), error=True), language)


def parse_sources(sources: DataFrame, most_bytes: int = 10 << 20, recovery: str = "partial") -> DataFrame:
    """The node table of sources (file_id, language, content).

    Empty, null and oversized contents are left out; `rejected_sources` names
    them. Files are dealt out to all cores and packed into Arrow batches. Where a
    parser raises, recovery says what becomes of the file: partial - one ERROR
    node for all of it; fallback - its tree as bracketed code; skip - nothing;
    retry - ATTEMPTS more, then as abort - the job fails. `parse_errors` tells
    which files these are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(tree.columns(fid) for fid, language, content in told(batches) if (tree := recovered(content, language, recovery)) is not None)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    good = sources.where(usable(most_bytes)).select(F.col("file_id").cast("string").alias("file_id"), "language", "content")
    return spread(good).mapInArrow(run, NODE)


def parse_errors(sources: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """(file_id, _error) of the sources whose parser raises, `_error` being STRUCT<code, message, file, line, op>."""
    kind = "file_id string, _error struct<code:string,message:string,file:string,line:int,op:string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for fid, language, content in zip(frame.file_id, frame.language, frame.content):
                try:
                    parse(content, language)
                except Exception as e:
                    rows.append((fid, {"code": "parse", "message": f"{type(e).__name__}: {e}", "file": fid, "line": getattr(e, "lineno", None), "op": language}))
            yield pd.DataFrame(rows, columns=["file_id", "_error"])

    return spread(sources.where(usable(most_bytes)).select("file_id", "language", "content")).mapInPandas(run, kind)


def usable(most_bytes: int = 10 << 20) -> Column:
    return F.coalesce(F.octet_length("content").between(1, most_bytes), F.lit(False))


def rejected_sources(sources: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """(file_id, error) of sources that parse_sources leaves out."""
    reason = F.when(F.col("content").isNull(), "no content").when(F.octet_length("content") == 0, "empty").otherwise("too large")
    return sources.where(~usable(most_bytes)).select("file_id", F.struct(F.lit("parse").alias("code"), reason.alias("message")).alias("error"))


def embedded_ranges(nodes: DataFrame) -> DataFrame:
    """(file_id, language, start_char, end_char) of the scripts and styles in parsed HTML; a lang attribute overrides the language."""
    host = nodes.where(F.col("kind").isin("script_element", "style_element")).select("file_id", F.col("pre").alias("element"), F.when(F.col("kind") == "script_element", "javascript").otherwise("css").alias("usual"))
    raw = nodes.where("kind = 'raw_text'").select("file_id", F.col("parent").alias("element"), "start_char", "end_char")
    value = F.regexp_extract("text", "(?i)^lang\\s*=\\s*[\"']?([^\"']+)", 1)
    tags = nodes.where("kind = 'start_tag'").select("file_id", F.col("parent").alias("element"), F.col("pre").alias("tag"))
    given = nodes.where("kind = 'attribute'").select("file_id", F.col("parent").alias("tag"), F.lower(value).alias("lang")).where("lang <> ''").groupBy("file_id", "tag").agg(F.min("lang").alias("lang"))
    given = given.join(tags, ["file_id", "tag"]).select("file_id", "element", "lang")
    names = F.col("lang")
    for alias, name in ALIASES.items():
        names = F.when(F.col("lang") == alias, name).otherwise(names)
    rows = host.join(raw, ["file_id", "element"]).join(given, ["file_id", "element"], "left")
    return rows.select("file_id", F.coalesce(names, "usual").alias("language"), "start_char", "end_char")


_LANG = re.compile("lang\\s*=\\s*[\"']?([^\"']+)", re.I | re.A)


def embedded_spots(tree: Tree) -> list[tuple[str, int, int]]:
    """(language, start, end) of the scripts and styles of one HTML tree: `embedded_ranges` in the task that has it."""
    out = []
    for n in tree.nodes:
        if n.kind not in ("script_element", "style_element"):
            continue
        raw = [c for c in n.children if c.kind == "raw_text"]
        given = [m[1].lower() for tag in n.children if raw and tag.kind == "start_tag" for c in tag.children if c.kind == "attribute" and (m := _LANG.match(c.text))]
        usual = "javascript" if n.kind == "script_element" else "css"
        out += [(ALIASES.get(min(given), min(given)) if given else usual, c.start, c.end) for c in raw]
    return out


def parse_embedded(sources: DataFrame, ranges: DataFrame) -> DataFrame:
    """The node table of ranges (file_id, language, start_char, end_char) within sources; offsets are the host's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(parse_ranges(content, [(a, b)], language)[0].columns(f"{fid}#{a}") for fid, content, language, a, b in told(batches))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    return spread(with_ranges(sources, ranges)).mapInArrow(run, NODE)


def with_ranges(sources: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file_id, content, language, start_char, end_char): the ranges with the sources that they are in."""
    return sources.select("file_id", "content").join(ranges, "file_id").select("file_id", "content", "language", "start_char", "end_char")


_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in NODE.split(", ")])


def _batches(files: Iterator[list[list]], most_rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The node columns of files, put together to batches of some size."""
    held: list[list] = [[] for _ in COLUMNS]
    for columns in files:
        for own, more in zip(held, columns):
            own += more
        if len(held[0]) > most_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, _SCHEMA.types)], schema=_SCHEMA)
            held = [[] for _ in COLUMNS]
    if held[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, _SCHEMA.types)], schema=_SCHEMA)
