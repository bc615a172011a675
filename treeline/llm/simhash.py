"""Operator 10: SimHash near-dedup, its pairs found by the May-Ozerov recursion.

A document's fingerprint has 256 bits: the majority, bit by bit, of the hashes
of its distinct words and pairs of neighbouring words. Near copies differ in
few bits. Fingerprints within a distance are found by filters: for a random
strip of half the coordinates and a random centre, a filter keeps those whose
partial weight - the weight of their difference from the centre on the strip -
is low. Two close fingerprints pass a filter together far more often than two
others. Each filter's list is filtered again on the coordinates left, and so on
until lists are small, which are compared by brute force. The number of
filters at each level follows from the recall that is asked for.

Equal fingerprints are one to begin with. One level spreads the lists over the
cluster: its filters keep KEPT of all fingerprints, or less where lists would
outgrow LOCAL, so that the lists of a fingerprint grow slowly and without a step
with the number of all. From there on the recursion stays inside a task. A list
gives each of its close fingerprints one link, to the least of its component
there, so that thousands of copies cost thousands of links.

Fingerprints that are close to one another pass filters together. Before a list
is filtered, groups that make up much of it are taken out: all that are close to
one of them are linked to it, and by the triangle inequality only the few that
are within twice the distance of it can be close to one of the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import textscan as ts
from treeline.llm.shared import components, least_rows, read, settled, written

BITS = 256
LANES = BITS // 64
#: Two documents are near copies if their fingerprints differ in at most so many bits.
DISTANCE = 52
#: The recall that the filters of all levels together aim at, for two fingerprints DISTANCE bits apart; closer ones meet more often.
RECALL = 0.9
#: A filter keeps a random fingerprint with about this probability, or less where the spread lists would be longer than LOCAL.
KEPT = 0.03
#: Lists up to BRUTE are compared all with all: about where a level of filters begins to cost less.
BRUTE = 8000
#: Spread lists aim at LOCAL rows, or at ROOT times the root of the number of all: there, passing the filters of the first level costs about as much as searching the lists.
LOCAL, ROOT = 8000, 2
#: So many rows of a list are tried as centres of a group, and a group is taken out if it has MUCH of the list.
TRIED, MUCH = 64, 0.02
SEED = 5

_U = np.uint64
_FIELDS = [f"f{k}" for k in range(LANES)]


# --- fingerprints -----------------------------------------------------------


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, LANES) uint64 and whether a text has any word; without one its fingerprint is 0."""
    out, some = np.zeros((len(texts), LANES), _U), np.zeros(len(texts), bool)
    for a, b, words, off in ts.scan(texts):
        pairs = ts.mix(words[:-1] * _U(3) + words[1:]) if len(words) else words
        features, sizes = [], []
        for k in range(b - a):
            i, j = off[k], off[k + 1]
            x = np.unique(np.concatenate([words[i:j], pairs[i : max(i, j - 1)]])) if j > i else words[:0]
            features.append(x)
            sizes.append(len(x))
        for k in range(b - a):
            if sizes[k]:
                out[a + k] = _majority(features[k])
                some[a + k] = True
    return out, some


def _majority(x: np.ndarray) -> np.ndarray:
    lanes = np.empty((len(x), LANES), _U)
    for k in range(LANES):
        lanes[:, k] = x if k == 0 else ts.mix(x + _U(0x9E37 * k))
    total = np.zeros(BITS, np.int64)
    rows = lanes.view(np.uint8)
    for s in range(0, len(x), 255):  # 255 fit a byte
        total += np.add.reduce(np.unpackbits(rows[s : s + 255], axis=1), axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(x)).view(_U)


# --- filters ----------------------------------------------------------------


@lru_cache(maxsize=None)
def _weight_limit(bits: int, kept: float = KEPT) -> int:
    """The largest t with P(Bin(bits, 1/2) <= t) at most kept."""
    total, t = 0.0, -1
    while True:
        total += math.comb(bits, t + 1) / 2.0**bits
        if total > kept:
            return max(t, 0)
        t += 1


@lru_cache(maxsize=None)
def filters_needed(bits: int, recall: float, kept: float = KEPT) -> int:
    """How many filters on one strip of so many bits let two fingerprints DISTANCE apart meet with this recall.

    All filters of a level share the strip; how many of the differing bits are
    on it is left to chance, and the failures of all splits are averaged.
    """
    limit = _weight_limit(bits, kept)
    splits = []
    for apart in range(max(0, DISTANCE - (BITS - bits)), min(DISTANCE, bits) + 1):
        same, both = bits - apart, 0.0
        for in_same in range(min(limit, same) + 1):
            # weights of the two on the coordinates where they differ are i and apart - i
            lo, hi = max(0, apart - (limit - in_same)), min(apart, limit - in_same)
            if lo <= hi:
                both += math.comb(same, in_same) * sum(math.comb(apart, i) for i in range(lo, hi + 1)) / 2.0**bits
        splits.append((math.comb(bits, apart) * math.comb(BITS - bits, DISTANCE - apart) / math.comb(BITS, DISTANCE), both))
    least, most = 1, 1 << 40
    while least < most:
        half = (least + most) // 2
        if sum(share * (1 - both) ** half for share, both in splits) <= 1 - recall:
            most = half
        else:
            least = half + 1
    return least


class Filters:
    """The filters of one node of the recursion, fixed by its seed."""

    def __init__(self, seed: int, level: int, recall: float, kept: float = KEPT):
        draw = np.random.RandomState(seed & 0x7FFFFFFF)
        # strips of two levels are each other's complement; deeper ones are drawn anew
        order = np.random.RandomState((SEED + level // 2) & 0x7FFFFFFF).permutation(BITS)
        strip = order[: BITS // 2] if level % 2 == 0 else order[BITS // 2 :]
        on = np.zeros(BITS, np.uint8)
        on[strip] = 1
        self.mask = np.packbits(on).view(_U)
        self.limit = _weight_limit(len(strip), kept)
        n = filters_needed(len(strip), recall, kept)
        self.centres = np.frombuffer(draw.bytes(n * BITS // 8), _U).reshape(n, LANES) & self.mask

    def passing(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each filter the rows of x that it keeps."""
        lanes = np.flatnonzero(self.mask)
        part = np.ascontiguousarray((x & self.mask)[:, lanes].T)
        for j, centre in enumerate(self.centres[:, lanes]):
            weight = np.bitwise_count(part[0] ^ centre[0]).astype(np.uint16)
            for k in range(1, len(lanes)):
                weight += np.bitwise_count(part[k] ^ centre[k])
            yield j, np.flatnonzero(weight <= self.limit)


def spread_kept(n: int, local: int = LOCAL) -> float:
    """What the filters of the first level keep of n fingerprints."""
    return min(KEPT, max(local, ROOT * math.sqrt(n)) / max(n, 1))


def depth_of(n: int) -> int:
    """Levels until a list of n is down to BRUTE."""
    return max(0, math.ceil(math.log(max(1.0, n / BRUTE)) / -math.log(KEPT)))


def _close(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the one and which of the other are within DISTANCE; both lane by lane, (LANES, n). Most pairs are told apart by half of their bits."""
    half = np.bitwise_count(left[0][:, None] ^ right[0][None, :])
    for k in range(1, LANES // 2):
        half += np.bitwise_count(left[k][:, None] ^ right[k][None, :])
    at = np.flatnonzero(half <= DISTANCE)
    i, j = np.divmod(at, right.shape[1])
    d = half.ravel()[at].astype(np.uint16)
    for k in range(LANES // 2, LANES):
        d += np.bitwise_count(left[k][i] ^ right[k][j])
    near = d <= DISTANCE
    return i[near], j[near]


def _brute(x: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within DISTANCE, a block of them at a time."""
    own = np.ascontiguousarray(x[rows].T)
    for s in range(0, len(rows), 64):
        for t in range(s, len(rows), 1 << 14):
            i, j = _close(own[:, s : s + 64], own[:, t : t + (1 << 14)])
            up = t + j > s + i
            if up.any():
                yield rows[s + i[up]], rows[t + j[up]]


def _tops(root: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The least known row of the component of each row."""
    top = root[rows]
    while not np.array_equal(up := root[top], top):
        top = up
    root[rows] = top
    return top


def _sparse(x: np.ndarray, rows: np.ndarray, root: np.ndarray, seed: int) -> np.ndarray:
    """rows without the groups that make up much of them, all of whose links are made."""
    draw = np.random.RandomState(seed & 0x7FFFFFFF)
    while len(rows) > BRUTE:
        tried = rows[draw.choice(len(rows), TRIED, replace=False)]
        near = np.zeros(TRIED, np.int64)
        for s in range(0, len(rows), 1 << 14):
            near += np.bincount(_close(x[tried].T, np.ascontiguousarray(x[rows[s : s + (1 << 14)]].T))[0], minlength=TRIED)
        if near.max() < max(TRIED, MUCH * len(rows)):
            break
        leader = tried[near.argmax()]
        d = np.bitwise_count(x[rows] ^ x[leader]).sum(1, dtype=np.uint16)
        inside = d <= DISTANCE
        group = rows[inside]
        least_rows(root, np.full(len(group), leader), group)
        around = rows[~inside & (d <= DISTANCE + int(d[inside].max()))]
        for s in range(0, len(group), 256):
            around = around[_tops(root, around) != _tops(root, group[:1])]
            if not len(around):
                break
            for t in range(0, len(around), 1 << 14):
                i, j = _close(x[group[s : s + 256]].T, np.ascontiguousarray(x[around[t : t + (1 << 14)]].T))
                least_rows(root, group[s + i], around[t + j])
        rows = rows[~inside]
    return rows


def _search(x: np.ndarray, rows: np.ndarray, root: np.ndarray, level: int, seed: int, left: int | None = None, recall: float = RECALL) -> None:
    """The recursion inside a task: joins in root what is close. left: levels to go; recall: that of each of them."""
    if len(rows) > 512:
        top = _tops(root, rows)
        if (top == top[:1]).all():
            return
    rows = _sparse(x, rows, root, seed)
    if len(rows) <= BRUTE:
        for a, b in _brute(x, rows):
            least_rows(root, a, b)
        return
    if not left:  # at the start, or where more are left than were to be expected
        left = max(1, depth_of(len(rows)))
        recall = recall ** (1 / left)
    for j, kept in Filters(seed, level, recall).passing(x[rows]):
        if len(kept) > 1:
            _search(x, rows[kept], root, level + 1, seed * 1_000_003 + j + 1, left - 1 or None, recall if left > 1 else RECALL**0.5)


# --- on Spark ---------------------------------------------------------------


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, f0 .. f3) of the documents that have an id and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, some = fingerprints(batch.column(1))
            ids = batch.column(0).filter(pa.array(some))
            x = x[some].view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x[:, k]) for k in range(LANES))], ["doc_id", *_FIELDS])

    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return known.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{f} bigint" for f in _FIELDS))


def links(nodes: DataFrame, n: int, local: int = LOCAL) -> DataFrame:
    """Close fingerprints as (a, b) links that join each component. nodes: (node, f0 .. f3), n of them, all different."""
    kept_share, half = spread_kept(n, local), RECALL**0.5  # one half of the failures for the spread, one for the tasks

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(SEED, 0, half, kept_share)
        for batch in batches:
            x = np.stack([batch.column(k + 1).to_numpy() for k in range(LANES)], 1).view(_U)
            held, size = [], 0
            for j, kept in filters.passing(x):
                held.append((np.full(len(kept), j, np.int64), kept))
                size += len(kept)
                if size > 200_000:
                    yield _rows(batch, held)
                    held, size = [], 0
            if held:
                yield _rows(batch, held)

    def _rows(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        at = pa.array(np.concatenate([h[1] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[0] for h in held])), *(batch.column(k).take(at) for k in range(LANES + 1))], ["list", "node", *_FIELDS])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(key: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            table = np.concatenate(parts)
            parts.clear()
            node, x, root = table[:, 0], np.ascontiguousarray(table[:, 1:]).view(_U), np.arange(len(table))
            _search(x, np.arange(len(node)), root, 1, key + 1, None, half)
            root = settled(root)
            linked = np.flatnonzero(root != np.arange(len(node)))
            return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], ["a", "b"])

        now, parts = None, []
        for batch in batches:
            key = batch.column(0).to_numpy()
            table = np.stack([batch.column(k + 1).to_numpy() for k in range(LANES + 1)], 1)
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if key[i] != now and parts:
                    yield one(now, parts)
                    parts = []
                now = int(key[i])
                parts.append(table[i:j])
        if parts:
            yield one(now, parts)

    fields = ", ".join(f"{f} bigint" for f in _FIELDS)
    lists = nodes.select("node", *_FIELDS).mapInArrow(spread, f"list bigint, node bigint, {fields}")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(parts, "list").sortWithinPartitions("list").mapInArrow(search, "a bigint, b bigint")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of all documents that have a near copy; group_id is the least doc_id of the group.

    docs: doc_id (an integer), text. A group is a component of "within DISTANCE
    bits". Documents without an id, and those with a null, empty or blank text,
    are in no group. Rows with the same id are one document if their texts
    agree; if not, it is in the groups of all its texts, which so become one.
    Order and repeats of rows change nothing. An empty table gives no rows.
    """
    table = written(fingerprint_table(docs), "fingerprints")
    nodes = written(table.groupBy(*_FIELDS).agg(F.min("doc_id").alias("node")), "nodes")
    # a document with several texts stands in several nodes: link them by their own ids
    equal = table.join(nodes, _FIELDS).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b")
    return components(equal.unionByName(links(nodes, nodes.count()))).select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have a near copy, with their group: `groups` of the whole table."""
    return groups(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group, the one with the least doc_id; those in no group stay."""
    gone = written(groups(docs).where("doc_id <> group_id").select("doc_id"), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
