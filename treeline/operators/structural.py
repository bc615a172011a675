"""Rules over the node table as built-in expressions, windows and joins (the Catalyst tier).

Every rule becomes a boolean column of the nodes. Composites are boolean
algebra; `inside ... end` and `has ... end` are running maxima and minima over
one sort by (file_id, pre), exact since regions nest or are apart; siblings are
windows over (file_id, parent). "Direct parent or child" joins on file_id and
parent; "stop by a rule" and bindings to ancestors go through whole files once,
level by level, in Arrow batches - never a join of a file's nodes with each
other. Rules with patterns, bindings
or recursive utils go to the interpreter (`scan`).
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import WindowSpec

from treeline.operators.labels import whole_files
from treeline.operators.rules import ORDER, RuleError, nth_holds, parse_nth
from treeline.storage import spread

_fresh = itertools.count()


def _doc() -> WindowSpec:
    return Window.partitionBy("file_id").orderBy("pre")


def _before() -> WindowSpec:
    return _doc().rowsBetween(Window.unboundedPreceding, -1)


def _after() -> WindowSpec:
    return _doc().rowsBetween(1, Window.unboundedFollowing)


def _siblings(reverse: bool = False) -> WindowSpec:
    return Window.partitionBy("file_id", "parent").orderBy(F.desc("child_idx") if reverse else "child_idx")


def supported(spec: Any) -> bool:
    """Whether a rule needs no bindings, so that it can be compiled to a plan."""
    if not isinstance(spec, dict):
        return True
    return "pattern" not in spec and all(supported(v) for k, v in spec.items() for v in (v if isinstance(v, list) else [v]))


def with_text(nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """nodes with the texts that are too long to be kept in their rows; roots: a table that has the files' roots, nodes by default.

    Such a text is a slice of its root's. Only the long nodes are joined with
    the roots, all others pass by.
    """
    if not {"start_char", "end_char", "parent", "text"} <= set(nodes.columns):
        return nodes
    long = F.coalesce(F.col("text").isNull() & (F.col("end_char") > F.col("start_char")), F.lit(False))
    tops = (nodes if roots is None else roots).where("parent < 0").select(F.col("file_id").alias("__f"), F.col("text").alias("__t"), F.col("start_char").alias("__s"))
    cut = F.substring(F.col("__t"), F.col("start_char") - F.col("__s") + 1, F.col("end_char") - F.col("start_char"))
    held = nodes.where(long).join(tops, F.col("file_id") == F.col("__f"), "left")
    return nodes.where(~long).unionByName(held.select(*(cut.alias(c) if c == "text" else F.col(f"`{c}`") for c in nodes.columns)))


def _without(utils: dict[str, dict], name: str) -> dict[str, dict]:
    return {k: v for k, v in utils.items() if k != name}


def reads_text(spec: Any, utils: dict[str, dict]) -> bool:
    """Whether a rule has a regex anywhere."""
    if isinstance(spec, list):
        return any(reads_text(v, utils) for v in spec)
    if not isinstance(spec, dict):
        return False
    if "regex" in spec or spec.get("matches") in utils and reads_text(utils[spec["matches"]], _without(utils, spec["matches"])):
        return True
    return any(reads_text(v, utils) for k, v in spec.items() if k != "matches")


def rebinds(spec: dict, utils: dict[str, dict]) -> bool:
    """Whether a rule can stand for another node than the one it is tried on: nothing but `has`, or an `any` or `matches` that comes down to one."""
    if set(spec) == {"has"}:
        return True
    if set(spec) == {"any"}:
        return any(rebinds(v, utils) for v in spec["any"])
    return set(spec) == {"matches"} and spec["matches"] in utils and rebinds(utils[spec["matches"]], _without(utils, spec["matches"]))


def select(nodes: DataFrame, spec: dict, utils: dict[str, dict] | None = None) -> DataFrame:
    """The nodes that match a rule. A regex sees texts of any length.

    As in the interpreter, a rule that is nothing but `has` gives the descendant
    that it finds, once for each node that has it, and so does an `any` or a
    `matches` that comes down to one.
    """
    utils = utils or {}
    read = with_text(nodes) if reads_text(spec, utils) else nodes
    alone = condition(spec, utils)
    if alone is not None:
        return read.where(alone)
    return _bound(read, spec, utils, F.lit(True)).select(*nodes.columns)


def _bound(nodes: DataFrame, spec: dict, utils: dict[str, dict], where: Column) -> DataFrame:
    """What a rule stands for on those nodes for which `where` holds."""
    if rebinds(spec, utils):
        if "has" in spec:
            return _found_by_has(nodes, spec["has"], utils, where)
        if "matches" in spec:
            return _bound(nodes, utils[spec["matches"]], _without(utils, spec["matches"]), where)
        out = None
        for v in spec["any"]:  # a node goes by the first alternative that it matches
            nodes, name = mark(nodes, v, utils)
            part = _bound(nodes, v, utils, where & F.col(name))
            out = part.drop(*(c for c in part.columns if c.startswith("__m"))) if out is None else out.unionByName(part.drop(*(c for c in part.columns if c.startswith("__m"))))
            where = where & ~F.col(name)
        return out
    marked, column = mark(nodes, spec, utils)
    return marked.where(where & F.col(column))


def _found_by_has(nodes: DataFrame, value: dict, utils: dict[str, dict], where: Column) -> DataFrame:
    """For each node that `has` holds for, the descendant that it finds."""
    inner, stop, field = {k: v for k, v in value.items() if k not in ("stopBy", "field")}, value.get("stopBy", "neighbor"), value.get("field")
    if rebinds(inner, utils) or field is not None and isinstance(stop, dict):
        raise RuleError("needs_interpreter", "has")
    marked, hit = mark(nodes, inner, utils)
    marked = marked.withColumn("__w", where)
    if field is not None:
        first = F.row_number().over(Window.partitionBy("file_id", "parent").orderBy("child_idx"))
        below = F.min(F.when(F.col(hit), F.col("pre"))).over(_doc().rowsBetween(0, Window.unboundedFollowing))
        at = F.when(F.col(hit), F.col("pre")) if stop == "neighbor" else F.when(F.col("__b") <= F.col("end_pre"), F.col("__b"))
        kids = marked.withColumn("__b", below).where((F.col("field") == field) & (F.col("parent") >= 0)).withColumn("__n", first).where("__n = 1")
        found = kids.select("file_id", F.col("parent").alias("__up"), at.alias("pre")).where("pre IS NOT NULL")
    elif stop == "neighbor":
        found = marked.where(F.col(hit) & (F.col("parent") >= 0)).groupBy("file_id", F.col("parent").alias("__up")).agg(F.min("pre").alias("pre"))
    elif stop == "end":
        below = F.min(F.when(F.col(hit), F.col("pre"))).over(_after())
        found = marked.withColumn("__b", below).where("__b <= end_pre").select("file_id", F.col("pre").alias("__up"), F.col("__b").alias("pre"))
    else:
        marked, halt = mark(marked, stop, utils)
        marked, first = _first_free(marked, hit, halt)
        found = marked.where(F.col(first).isNotNull()).select("file_id", F.col("pre").alias("__up"), F.col(first).alias("pre"))
    ups = marked.where("__w").select("file_id", F.col("pre").alias("__up"))
    return nodes.join(found.join(ups, ["file_id", "__up"]), ["file_id", "pre"]).drop("__up")


def condition(spec: dict, utils: dict[str, dict]) -> Column | None:
    """A rule that looks at the node alone as one condition, which the scan can take; None for any other rule."""
    if not spec or not set(spec) <= {"kind", "regex", "range", "all", "any", "not", "matches"}:
        return None
    value = F.lit(True)
    for key in ORDER:
        if key not in spec:
            continue
        of = spec[key]
        if key in ("kind", "regex", "range"):
            value = value & _own(key, of)
            continue
        if key == "matches":
            parts = [condition(utils[of], {k: v for k, v in utils.items() if k != of})] if of in utils else [None]
        else:
            parts = [condition(v, utils) for v in (of if isinstance(of, list) else [of])]
        if any(p is None for p in parts):
            return None
        if key == "not":
            value = value & ~F.coalesce(parts[0], F.lit(False))
        elif key == "any":
            value = value & functools.reduce(lambda a, b: a | b, parts, F.lit(False))
        else:
            value = functools.reduce(lambda a, b: a & b, parts, value)
    return value


def _own(key: str, value: Any) -> Column:
    if key == "kind":
        return F.col("is_error") if value == "ERROR" else F.col("kind") == value
    if key == "regex":
        return F.col("text").rlike(value)
    points = [F.col(f"{end}_{part}") == value[end][of] for end in ("start", "end") for part, of in (("line", "line"), ("col", "column"))]
    return points[0] & points[1] & points[2] & points[3]


def mark(nodes: DataFrame, spec: dict, utils: dict[str, dict] | None = None) -> tuple[DataFrame, str]:
    """nodes with one more boolean column, and its name."""
    utils = utils or {}
    if not spec:
        raise RuleError("no_positive_matcher")
    names = []
    for key in ORDER:  # cheap tests come first, relations last
        if key in spec:
            nodes, name = _mark_key(nodes, key, spec[key], utils)
            names.append(name)
    if unknown := set(spec) - set(ORDER):
        raise RuleError("unknown_key", ", ".join(sorted(unknown)))
    return _combine(nodes, names, all)


def _named(nodes: DataFrame, value: Column) -> tuple[DataFrame, str]:
    name = f"__m{next(_fresh)}"
    return nodes.withColumn(name, F.coalesce(value, F.lit(False))), name


def _combine(nodes: DataFrame, names: list[str], how: Any) -> tuple[DataFrame, str]:
    if len(names) == 1:
        return nodes, names[0]
    value = F.lit(how is all)
    for n in names:
        value = (value & F.col(n)) if how is all else (value | F.col(n))
    return _named(nodes, value)


def _mark_key(nodes: DataFrame, key: str, value: Any, utils: dict[str, dict]) -> tuple[DataFrame, str]:
    if key in ("kind", "regex", "range"):
        return _named(nodes, _own(key, value))
    if key == "nthChild":
        return _nth(nodes, value, utils)
    if key in ("all", "any"):
        names = []
        for v in value:
            nodes, name = mark(nodes, v, utils)
            names.append(name)
        return _combine(nodes, names, all if key == "all" else any)
    if key == "not":
        nodes, name = mark(nodes, value, utils)
        return _named(nodes, ~F.col(name))
    if key == "matches":
        if value not in utils:
            raise RuleError("undefined_util", value)
        return mark(nodes, utils[value], {k: v for k, v in utils.items() if k != value})
    if key == "pattern":
        raise RuleError("needs_interpreter", "pattern")
    return _relation(nodes, key, value, utils)


def _nth(nodes: DataFrame, value: Any, utils: dict[str, dict]) -> tuple[DataFrame, str]:
    spec = value if isinstance(value, dict) else {"position": value}
    step, offset = parse_nth(spec["position"])
    peer = F.col("is_named") & (F.col("parent") >= 0)
    if "ofRule" in spec:
        nodes, of = mark(nodes, spec["ofRule"], utils)
        peer = peer & F.col(of)
    order = _siblings(bool(spec.get("reverse")))
    nodes, at = nodes.withColumn(at := f"__m{next(_fresh)}", F.sum(peer.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))), at
    rest = F.col(at) - offset
    if step == 0:
        return _named(nodes, peer & (rest == 0))
    # the remainder first, then the quotient's sign: truncation does no harm
    return _named(nodes, peer & (rest % step == 0) & (rest / step >= 0))


assert nth_holds(-1, 3, 3)


def _relation(nodes: DataFrame, key: str, value: dict, utils: dict[str, dict]) -> tuple[DataFrame, str]:
    inner = {k: v for k, v in value.items() if k not in ("stopBy", "field")}
    stop, field = value.get("stopBy", "neighbor"), value.get("field")
    if field is not None and key in ("precedes", "follows"):
        raise RuleError("field_not_supported", key)
    nodes, hit = mark(nodes, inner, utils)
    halt = None
    if isinstance(stop, dict):
        nodes, halt = mark(nodes, stop, utils)
    if key in ("precedes", "follows"):
        return _sideways(nodes, key, hit, stop, halt)
    return (_inside if key == "inside" else _has)(nodes, hit, stop, halt, field)


def _sideways(nodes: DataFrame, key: str, hit: str, stop: Any, halt: str | None) -> tuple[DataFrame, str]:
    later = key == "precedes"
    order = _siblings(not later)
    has_peers = F.col("parent") >= 0
    if stop == "neighbor":
        return _named(nodes, has_peers & F.lead(hit).over(order))
    rest = order.rowsBetween(1, Window.unboundedFollowing)
    place = F.col("child_idx") if later else -F.col("child_idx")
    first = F.min(F.when(F.col(hit), place)).over(rest)
    if halt is None:
        return _named(nodes, has_peers & first.isNotNull())
    end = F.min(F.when(F.col(halt), place)).over(rest)
    return _named(nodes, has_peers & first.isNotNull() & (end.isNull() | (first <= end)))


def _join(nodes: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, str]:
    """A column that tells whether a row's `on` is in keys, which has it without repeats."""
    name = f"__m{next(_fresh)}"
    joined = spread(nodes, *on).join(spread(keys.select(*on, F.lit(True).alias(name)), *on), on, "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(False))), name


def _inside(nodes: DataFrame, hit: str, stop: Any, halt: str | None, field: str | None) -> tuple[DataFrame, str]:
    if stop == "neighbor":
        parents = nodes.where(F.col(hit)).select("file_id", F.col("pre").alias("parent"))
        nodes, name = _join(nodes, parents, ["file_id", "parent"])
        if field is None:
            return nodes, name
        # where a field has several children, the first is meant
        first = F.min(F.when(F.col("field") == field, F.col("child_idx"))).over(Window.partitionBy("file_id", "parent"))
        nodes = nodes.withColumn(at := f"__m{next(_fresh)}", first)
        return _named(nodes, F.col(name) & (F.col("child_idx") == F.col(at)))
    if stop == "end" and field is None:
        return _named(nodes, F.max(F.when(F.col(hit), F.col("end_pre"))).over(_before()) >= F.col("pre"))
    # the nearest ancestor that matches, and the nearest one that stops
    nodes = nodes.withColumn(v := f"__m{next(_fresh)}", F.when(F.col(hit), F.col("pre")).cast("int"))
    columns, above = [v], lambda x: x.nearest(x[v])
    if field is not None:
        # what counts is that the way up comes through the first child in the field: that child stands for its parent, below and on it
        nodes = nodes.withColumn(f := f"__m{next(_fresh)}", (F.col("field") == field).cast("int"))
        columns, above = [v, f, "child_idx"], lambda x: x.nearest_or_own(x.through(x[v], x[f]))
    if halt is None:
        nodes, (best,) = _levels(nodes, columns, lambda x: [above(x)])
        return _named(nodes, F.col(best) >= -1)
    nodes = nodes.withColumn(h := f"__m{next(_fresh)}", F.when(F.col(halt), F.col("pre")).cast("int"))
    nodes, (best, end) = _levels(nodes, [*columns, h], lambda x: [above(x), x.nearest(x[h])], 2)
    return _named(nodes, F.col(best) >= F.coalesce(end, F.lit(-1)))


class _Files:
    """Whole files' rows, level by level: rows[d] are those at depth d, parents[d] where their parents stand."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns
        file, pre, parent, depth = (columns[c] for c in ("__file", "pre", "parent", "depth"))
        key = (file << 32) | pre
        up = np.searchsorted(key, (file << 32) | np.maximum(parent, 0))
        up = np.where((parent >= 0) & (up < len(key)), np.minimum(up, len(key) - 1), -1)
        up = np.where((up >= 0) & (key[up] == ((file << 32) | np.maximum(parent, 0))), up, -1)
        self.up = up
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
        self.rows = [order[i:j] for i, j in zip(cuts, cuts[1:])]
        self.rows = [r[up[r] >= 0] if d else r for d, r in enumerate(self.rows)]
        self.parents = [up[r] for r in self.rows]

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def nearest(self, value: np.ndarray) -> np.ndarray:
        """For each row the value of its nearest ancestor that has one; -1 is none."""
        out = np.full(len(value), -1, np.int64)
        for rows, up in zip(self.rows[1:], self.parents[1:]):
            out[rows] = np.where(value[up] >= 0, value[up], out[up])
        return out

    def nearest_or_own(self, value: np.ndarray) -> np.ndarray:
        return np.where(value >= 0, value, self.nearest(value))

    def through(self, hit: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """For the first of the children that fit, what its parent has in hit; -1 for all others."""
        index, none = self["child_idx"], np.iinfo(np.int64).max
        first = np.full(len(index), none)
        kids = np.flatnonzero((fits == 1) & (self.up >= 0))
        np.minimum.at(first, self.up[kids], index[kids])
        return np.where((self.up >= 0) & (index == first[self.up]), hit[self.up], -1)

    def first_free(self, hit: np.ndarray, halt: np.ndarray) -> np.ndarray:
        """For each row the first descendant that hits, none being looked for below one that halts; -1 is none."""
        none = np.iinfo(np.int64).max
        out = np.full(len(hit), none)
        for rows, up in zip(self.rows[:0:-1], self.parents[:0:-1]):
            np.minimum.at(out, up, np.where(hit[rows] == 1, self["pre"][rows], np.where(halt[rows] == 1, none, out[rows])))
        return np.where(out == none, -1, out)


def _levels(nodes: DataFrame, columns: list[str], work: Callable[[_Files], list[np.ndarray]], outs: int = 1) -> tuple[DataFrame, list[str]]:
    """nodes with what work makes of columns of whole files, each an int column with null for -1. One shuffle by file; every file is gone through once, a level at a time."""
    names = [f"__m{next(_fresh)}" for _ in range(outs)]
    schema = StructType([*nodes.schema.fields, *(StructField(n, IntegerType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_files(batches):
            yield from told(table)

    def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("file_id").combine_chunks()
        new = np.ones(len(ids), bool)
        new[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
        values = {c: pc.fill_null(table.column(c).cast(pa.int64()), -1).to_numpy() for c in dict.fromkeys(["pre", "parent", "depth", *columns])}
        for name, out in zip(names, work(_Files({"__file": np.cumsum(new), **values}))):
            table = table.append_column(name, pa.array(out.astype(np.int32), mask=out < 0))
        yield from table.to_batches()

    return spread(nodes).sortWithinPartitions("file_id", "pre").mapInArrow(run, schema), names


def _has(nodes: DataFrame, hit: str, stop: Any, halt: str | None, field: str | None) -> tuple[DataFrame, str]:
    if field is not None:
        return _has_field(nodes, hit, stop, halt, field)
    if stop == "neighbor":
        kids = nodes.where(F.col(hit)).select("file_id", F.col("parent").alias("pre")).distinct()
        return _join(nodes, kids, ["file_id", "pre"])
    if stop == "end":
        return _named(nodes, F.min(F.when(F.col(hit), F.col("pre"))).over(_after()) <= F.col("end_pre"))
    nodes, name = _first_free(nodes, hit, halt)
    return _named(nodes, F.col(name).isNotNull())


def _first_free(nodes: DataFrame, hit: str, halt: str) -> tuple[DataFrame, str]:
    """nodes with the first descendant that hits, none being looked for below one that halts."""
    nodes = nodes.withColumns({(a := f"__m{next(_fresh)}"): F.col(hit).cast("int"), (b := f"__m{next(_fresh)}"): F.col(halt).cast("int")})
    nodes, (name,) = _levels(nodes, [a, b], lambda x: [x.first_free(x[a], x[b])])
    return nodes, name


def _has_field(nodes: DataFrame, hit: str, stop: Any, halt: str | None, field: str) -> tuple[DataFrame, str]:
    # where a field has several children, the first is meant
    first = F.row_number().over(Window.partitionBy("file_id", "parent").orderBy("child_idx"))
    below = F.min(F.when(F.col(hit), F.col("pre"))).over(_after())
    nodes = nodes.withColumn(b := f"__m{next(_fresh)}", F.coalesce(below <= F.col("end_pre"), F.lit(False)))
    kids = nodes.where((F.col("field") == field) & (F.col("parent") >= 0)).withColumn("__n", first).where("__n = 1")
    good = F.col(hit)
    if stop == "end":
        good = good | F.col(b)
    elif halt is not None:
        grand = nodes.where(F.col(hit)).select("file_id", F.col("parent").alias("pre")).distinct()
        kids, g = _join(kids, grand, ["file_id", "pre"])
        good = good | (~F.col(halt) & F.col(g))
    found = kids.where(good).select("file_id", F.col("parent").alias("pre"))
    return _join(nodes, found, ["file_id", "pre"])


# --- bindings of relations --------------------------------------------------


def nearest_ancestor(nodes: DataFrame, low: dict, up: dict, utils: dict[str, dict] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, pre, ancestor_pre) and the columns keep: for nodes that match low, the nearest ancestor that matches up."""
    marked, d = mark(nodes, low, utils)
    marked, a = mark(marked, up, utils)
    marked = marked.withColumn(v := f"__m{next(_fresh)}", F.when(F.col(a), F.col("pre")).cast("int"))
    marked, (found,) = _levels(marked.select("file_id", "pre", "parent", "depth", *keep, d, v), [v], lambda x: [x.nearest(x[v])])
    return marked.where(F.col(d) & F.col(found).isNotNull()).select("file_id", "pre", F.col(found).alias("ancestor_pre"), *keep)


def first_descendant(nodes: DataFrame, up: dict, low: dict, utils: dict[str, dict] | None = None) -> DataFrame:
    """(file_id, pre, descendant_pre): for nodes that match up, the first descendant that matches low - a window, no join."""
    marked, a = mark(nodes, up, utils)
    marked, d = mark(marked, low, utils)
    marked = marked.withColumn("descendant_pre", F.min(F.when(F.col(d), F.col("pre"))).over(_after()))
    return marked.where(F.col(a) & (F.col("descendant_pre") <= F.col("end_pre"))).select("file_id", "pre", "descendant_pre")


def outermost(matches: DataFrame) -> DataFrame:
    """Matches that lie in no other one: pre beyond every end before."""
    reach = F.max("end_pre").over(_before())
    return matches.withColumn("__reach", reach).where("__reach IS NULL OR pre > __reach").drop("__reach")


def siblings(nodes: DataFrame) -> DataFrame:
    """nodes with next_pre and prev_pre."""
    return nodes.withColumn("next_pre", F.lead("pre").over(_siblings())).withColumn("prev_pre", F.lag("pre").over(_siblings()))


def first_match(matches: DataFrame) -> DataFrame:
    """The first match of each file in document order."""
    return matches.withColumn("__n", F.row_number().over(_doc())).where("__n = 1").drop("__n")


def traversal(nodes: DataFrame, order: str) -> DataFrame:
    """nodes with position: rank in pre, post or level order within the file."""
    by = {"pre": [F.col("pre")], "post": [F.col("end_pre"), F.desc("depth")], "level": [F.col("depth"), F.col("pre")]}[order]
    return nodes.withColumn("position", F.row_number().over(Window.partitionBy("file_id").orderBy(*by)) - 1)
