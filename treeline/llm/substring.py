"""Operator 4: substring dedup, by difference-cover anchors.

COVER is a set of residues modulo PERIOD such that any two residues i, j have
an offset d < PERIOD with both (i + d) and (j + d) modulo PERIOD in COVER. Of
every text only the windows of WIDTH words that begin at a position in COVER
are hashed. Two equal passages of at least PERIOD - 1 + WIDTH words, wherever
they lie in their texts, so have an anchor at the same place of both. Then

1. anchors: a hash that occurs once is no part of a repeat;
2. extension: a passage of LENGTH words is a candidate if an anchor that
   repeats lies in it. From each anchor candidates extend to both sides and are
   compared LENGTH words at a time, by 64-bit hashes of them. For this they
   travel in runs under the least hash of the windows within them, which equal
   passages share;
3. every passage that occurred before, in the order of doc_id and position, is
   a repeat, and repeats that overlap or touch make one span.

The result is that of comparing all passages of LENGTH words, but for two
passages that differ and have the same 64-bit hash.

No group is gathered in one task, however many documents share a passage. Each
task settles its own repeats, FLUSH hashes at a time: of a hash only its first
occurrence there travels, the others are repeats already and know which one
they follow. Windows that HOT occurrences share aren't travelled under: the
passages around them go under their own hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm import textscan as ts
from treeline.llm.shared import identity, read, written

#: A perfect difference set: 6 of 31 positions are hashed.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
LENGTH = 50
WIDTH = LENGTH - PERIOD + 1
#: A task settles so many hashes at a time.
FLUSH = 1 << 20
#: A window that so many positions of the cover hold is hot. Of the hot ones, the MOST_HOT with most positions are split: any other holds less than 1 / MOST_HOT of all positions.
HOT, MOST_HOT = 20_000, 100_000
#: Words of a cell by which the spans that follow others are joined with these.
CELL = 256

_COVERED = np.zeros(PERIOD, bool)
_COVERED[list(COVER)] = True


def _places(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of texts with these word offsets: the text it is in and its place there."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return text, np.arange(off[-1]) - off[text]


def _lists(first: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """values cut into lists that begin at first."""
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)).astype(np.int32)), pa.array(values))


class _Held:
    """Arrays of one length that are gathered until they have as many items as `most`."""

    def __init__(self, most: int) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.most, self.size = most, 0

    def add(self, *arrays: np.ndarray) -> bool:
        self.parts.append(arrays)
        self.size += len(arrays[0])
        return self.size >= self.most

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(c) for c in zip(*self.parts)]
        self.parts, self.size = [], 0
        return out


def _anchors(docs: DataFrame) -> DataFrame:
    """(h, i, t, at, n, known): a row for each hash of the cover's positions that a task holds, with the first of them and their number; and for each of its texts the other positions."""
    names = ["h", "i", "t", "at", "n", "known"]

    def settle(h: np.ndarray, i: np.ndarray, t: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(h, kind="stable")
        first = np.ones(len(h), bool)
        first[1:] = h[order[1:]] != h[order[:-1]]
        begins = np.flatnonzero(first)
        n, one = np.diff(np.append(begins, len(h))), order[begins]
        yield pa.RecordBatch.from_arrays([pa.array(h[one]), pa.array(i[one]), pa.array(t[one]), pa.array(at[one]), pa.array(n.astype(np.int32)), pa.nulls(len(one), pa.list_(pa.int32()))], names)
        rest = np.sort(order[~first])  # texts stand together
        if len(rest):
            new = np.ones(len(rest), bool)
            new[1:] = (t[rest[1:]] != t[rest[:-1]]) | (i[rest[1:]] != i[rest[:-1]])
            begins = np.flatnonzero(new)
            one = rest[begins]
            # any partition will do for these: they are known to repeat
            yield pa.RecordBatch.from_arrays([pa.array(t[one] ^ i[one]), pa.array(i[one]), pa.array(t[one]), pa.array(at[one]), pa.array(np.zeros(len(one), np.int32)), _lists(begins, at[rest])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(FLUSH)
        for batch in batches:
            ids, marks = (batch.column(k).to_numpy() for k in (0, 1))
            for a, _, words, off in ts.scan(batch.column(2)):
                text, place = _places(off)
                size = np.diff(off)[text]
                at = np.flatnonzero(_COVERED[place % PERIOD] & (place + WIDTH <= size) & (size >= LENGTH))
                if held.add(ts.window_hashes(words, at, WIDTH).view(np.int64), ids[a + text[at]], marks[a + text[at]], place[at].astype(np.int32)):
                    yield from settle(*held.take())
        if held.size:
            yield from settle(*held.take())

    return docs.select("i", "t", "text").mapInArrow(run, "h bigint, i bigint, t bigint, at int, n int, known array<int>")


def _shared_places(base: DataFrame) -> DataFrame:
    """(i, t, places, hot) of the texts that have anchors which repeat: their positions, and those windows that are hot, with how many hold them."""
    over = Window.partitionBy("h")
    rows = _anchors(base).withColumn("all", F.sum("n").over(over).cast("bigint"))
    rows = rows.where("known IS NOT NULL OR all > 1").withColumn("hot", F.when(F.col("known").isNull() & (F.col("all") >= HOT), F.struct("h", "all")))
    return rows.groupBy("i", "t").agg(F.flatten(F.collect_list(F.coalesce("known", F.array("at")))).alias("places"), F.collect_set("hot").alias("hot"))


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(h[i : i + width])."""
    out, reach = h, 1
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(h) - width + 1], out[width - reach : width - reach + len(h) - width + 1]) if width > reach else out


_RUNS = "m bigint, i bigint, t bigint, start int, hashes array<bigint>, n int, by_i bigint, by_t bigint, by_start int"


def _candidates(joined: DataFrame, hot: np.ndarray) -> DataFrame:
    """Candidate passages in runs (m, i, t, start, hashes), a hash for each passage; and runs of n passages (i, t, start) that follow those of the same task (by_i, by_t, by_start).

    joined: i, t, text, places (the repeated anchors' positions). hot: the windows whose hash no passage travels under, sorted.
    """
    names = [c.split()[0] for c in _RUNS.split(", ")]
    none = lambda n, kind: pa.nulls(n, kind)

    def settle(f: np.ndarray, m: np.ndarray, i: np.ndarray, t: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        # documents by rank, so that a passage's place in the order of all is one number
        new = np.ones(len(f), bool)
        new[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1])
        own = np.cumsum(new) - 1
        doc_i, doc_t = i[new], t[new]
        by = np.lexsort((doc_t, doc_i))
        rank = np.empty(len(by), np.int64)
        step = np.ones(len(by), bool)
        step[1:] = (doc_t[by[1:]] != doc_t[by[:-1]]) | (doc_i[by[1:]] != doc_i[by[:-1]])
        rank[by] = np.cumsum(step) - 1
        key = (rank[own] << 32) | start
        order = np.lexsort((key, f))
        first = np.ones(len(f), bool)
        first[1:] = f[order[1:]] != f[order[:-1]]
        group = np.cumsum(first) - 1
        head = order[np.flatnonzero(first)][group]  # of each passage in this order, the first one equal to it
        follows = ~first & (key[order] != key[head])  # a row that is there twice is no repeat of itself
        lead = np.sort(order[first])
        split = np.zeros(len(lead), bool)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, m[lead]), len(hot) - 1)
            split = hot[at] == m[lead]
        m[lead[split]] = ts.mix(f[lead[split]].view(np.uint64)).view(np.int64)
        new = np.ones(len(lead), bool)
        new[1:] = (np.diff(key[lead]) != 1) | (m[lead[1:]] != m[lead[:-1]])
        begins = np.flatnonzero(new)
        one = lead[begins]
        yield pa.RecordBatch.from_arrays([pa.array(m[one]), pa.array(i[one]), pa.array(t[one]), pa.array(start[one]), _lists(begins, f[lead]), none(len(one), pa.int32()), none(len(one), pa.int64()), none(len(one), pa.int64()), none(len(one), pa.int32())], names)
        own, other = order[follows], head[follows]
        if len(own):
            at = np.argsort(key[own], kind="stable")
            own, other = own[at], other[at]
            once = np.ones(len(own), bool)
            once[1:] = key[own[1:]] != key[own[:-1]]
            own, other = own[once], other[once]
            new = np.ones(len(own), bool)
            new[1:] = (np.diff(key[own]) != 1) | (np.diff(key[other]) != 1)
            begins = np.flatnonzero(new)
            a, b, n = own[begins], other[begins], np.diff(np.append(begins, len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(t[a] ^ start[a]), pa.array(i[a]), pa.array(t[a]), pa.array(start[a]), none(len(a), pa.list_(pa.int64())), pa.array(n.astype(np.int32)), pa.array(i[b]), pa.array(t[b]), pa.array(start[b])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(FLUSH)
        for batch in batches:
            ids, marks, places = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            list_off = places.offsets.to_numpy()
            flat = places.values.to_numpy(zero_copy_only=False)
            for a, b, words, off in ts.scan(batch.column(2)):
                if len(words) < LENGTH:
                    continue
                text, place = _places(off)
                shared = np.zeros(len(words), np.int32)
                part = flat[list_off[a] : list_off[b]]
                shared[np.repeat(off[:-1], np.diff(list_off[a : b + 1])) + part] = 1
                total = np.concatenate([[0], np.cumsum(shared)])
                n = len(words) - LENGTH + 1
                at = np.flatnonzero((total[PERIOD : PERIOD + n] > total[:n]) & (text[:n] == text[LENGTH - 1 :]))
                if not len(at):
                    continue
                least = _sliding_least(ts.window_hashes(words, np.arange(len(words) - WIDTH + 1), WIDTH), PERIOD)[at]
                full = ts.window_hashes(words, at, LENGTH)
                if held.add(full.view(np.int64), least.view(np.int64), ids[a + text[at]], marks[a + text[at]], place[at].astype(np.int32)):
                    yield from settle(*held.take())
        if held.size:
            yield from settle(*held.take())

    # rest isn't read here, but keeps the texts' exchange the same as that of the cut
    return joined.select("i", "t", "text", "places", *(["rest"] if "rest" in joined.columns else [])).mapInArrow(run, _RUNS)


def _repeats(runs: DataFrame) -> DataFrame:
    """(i, t, start, n, source, by_i, by_t, by_start): passages start .. start + n - 1 that occurred before: in document source, or where the passages they follow did.

    Runs come sorted by m and by the order of passages; whole groups of one m
    are compared, as many at a time as make FLUSH passages. A group that isn't
    split is small, by HOT.
    """
    out = "i bigint, t bigint, start int, n int, source bigint, by_i bigint, by_t bigint, by_start int"
    names = [c.split()[0] for c in out.split(", ")]

    def compare(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        chain = table.filter(table.column("n").is_valid())
        if len(chain):
            yield from chain.select(["i", "t", "start", "n"]).append_column("source", pa.nulls(len(chain), pa.int64())).append_column("by_i", chain["by_i"]).append_column("by_t", chain["by_t"]).append_column("by_start", chain["by_start"]).to_batches()
        table = table.filter(table.column("n").is_null()).combine_chunks()
        if not len(table):
            return
        lists = pa.concat_arrays(table.column("hashes").chunks)
        count = np.diff(lists.offsets.to_numpy())
        f = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(count)), count)
        i, t, start = (table.column(c).to_numpy() for c in ("i", "t", "start"))
        start = start[row] + np.arange(len(f)) - np.repeat(np.cumsum(count) - count, count)
        order = np.argsort(f, kind="stable")
        first = np.ones(len(f), bool)
        first[1:] = f[order[1:]] != f[order[:-1]]
        head = np.empty(len(f), np.int64)
        head[order] = order[np.flatnonzero(first)][np.cumsum(first) - 1]
        # a row that is there twice meets itself
        again = (i[row] == i[row[head]]) & (t[row] == t[row[head]]) & (start == start[head])
        at = np.flatnonzero(~again)
        if not len(at):
            return
        source = i[row[head[at]]]
        blank = (t[row[head[at]]] & 1) == 1
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]]) | (source[1:] != source[:-1]) | (blank[1:] != blank[:-1])
        begins = np.flatnonzero(new)
        one, n = at[begins], np.diff(np.append(begins, len(at)))
        no = pa.nulls(len(one), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(i[row[one]]), pa.array(t[row[one]]), pa.array(start[one].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(source[begins], mask=blank[begins]), no, no, pa.nulls(len(one), pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch.column(4).values)
            if size >= FLUSH:
                m = batch.column(0).to_numpy()
                cut = int(np.searchsorted(m, m[-1]))  # the last group may go on
                if cut:
                    yield from compare([*held[:-1], batch.slice(0, cut)])
                    held, size = [batch.slice(cut)], len(batch.slice(cut).column(4).flatten())
        if held:
            yield from compare(held)

    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(parts, "m").sortWithinPartitions("m", "i", "t", "start").mapInArrow(run, out)


def _base(docs: DataFrame) -> DataFrame:
    """(i, t, text, rest) of the documents that are long enough for a passage; rest holds the other columns."""
    i, t = identity()
    long = docs.where(F.octet_length("text") >= 2 * LENGTH - 1)
    return long.select(i.alias("i"), t.alias("t"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest"))


def _found(base: DataFrame) -> DataFrame:
    """What _repeats says of base (i, t, text, and rest or not)."""
    places = written(_shared_places(base), "places")
    hot = places.select(F.explode("hot").alias("w")).select("w.*").distinct().orderBy(F.desc("all"), "h").limit(MOST_HOT).collect()  # MOST_HOT at most
    joined = base.join(places.select("i", "t", "places"), ["i", "t"])
    return _repeats(_candidates(joined, np.sort(np.array([r.h for r in hot], np.int64))))


def _merged(found: DataFrame, *more: Column) -> DataFrame:
    """(i, t, start_word, end_word, *more): passages that overlap or touch become one span."""
    found = found.withColumn("stop", F.col("start") + F.col("n") + (LENGTH - 1))
    order = Window.partitionBy("i", "t").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    found = found.withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.groupBy("i", "t", "span").agg(F.min("start").cast("bigint").alias("start_word"), F.max("stop").cast("bigint").alias("end_word"), *more).drop("span")


def _with_sources(found: DataFrame) -> DataFrame:
    """found (written) with sources: for passages that follow others, the sources of these, or their own document where they are first."""
    cells = F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("start") + F.col("n") - 1) / CELL))
    known = found.where("by_i IS NULL").withColumn("sources", F.array("source"))
    lead = known.select(F.col("i").alias("by_i"), F.col("t").alias("by_t"), F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e"), "source", F.explode(cells).alias("cell"))
    chain = found.where("by_i IS NOT NULL").drop("source")
    by = F.sequence(F.floor(F.col("by_start") / CELL), F.floor((F.col("by_start") + F.col("n") - 1) / CELL))
    pieces = chain.withColumn("cell", F.explode(by))
    pieces = pieces.withColumn("b", F.greatest(F.col("by_start").cast("bigint"), F.col("cell") * CELL)).withColumn("z", F.least((F.col("by_start") + F.col("n")).cast("bigint"), (F.col("cell") + 1) * CELL))
    met = pieces.join(lead, ["by_i", "by_t", "cell"], "left")
    shared = F.when(F.col("e").isNotNull(), F.least("z", "e") - F.greatest("b", "s"))
    # what no source covers of a piece is first in the document that is followed
    each = met.groupBy("i", "t", "start", "n", "by_i", "by_t", "by_start", "cell", "b", "z").agg(F.collect_list(F.when(shared > 0, F.struct("source"))).alias("from"), F.coalesce(F.sum(F.when(shared > 0, shared)), F.lit(0)).alias("covered"))
    own = F.when(F.col("by_t").bitwiseAND(F.lit(1)) == 0, F.col("by_i"))
    sources = F.concat(F.transform("from", lambda x: x["source"]), F.when(F.col("covered") < F.col("z") - F.col("b"), F.array(own)).otherwise(F.array().cast("array<bigint>")))
    chained = each.select("i", "t", "start", "n", sources.alias("sources"))
    return known.select("i", "t", "start", "n", "sources").unionByName(chained)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_ids): the repeats of docs, end_word exclusive.

    docs: doc_id (an integer), text. A word is a run of other than ASCII white
    space. A passage of LENGTH words is a repeat if it occurred before: in a
    document with a lesser doc_id (null ids come last; of equal ids the lesser
    hash of the text), or earlier in the same text. source_doc_ids are those in
    which its passages occurred first. Rows alike in id and text are one
    document. Texts that are null, empty or shorter have none; very long ones
    are read whole; an empty table gives no rows; other columns, whatever their
    names, are left out.
    """
    found = _with_sources(written(_found(_base(docs.select("doc_id", "text")).drop("rest")), "repeats"))
    merged = _merged(found, F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("source_doc_ids"))
    doc = F.when(F.col("t").bitwiseAND(F.lit(1)) == 0, F.col("i"))
    return merged.select(doc.alias("doc_id"), "start_word", "end_word", "source_doc_ids")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of the documents of which each passage of 50 words occurred before: `spans` of the whole table."""
    return spans(read(spark, sf_dir, "documents"))


OP4_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(range(0, greatest(len(ws) - {LENGTH - 1}, 0))) AS s, ws FROM w),
h AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1 : s + {LENGTH}], ' ')) AS h FROM p),
f AS (SELECT doc_id, s, first_value(doc_id) OVER o AS source, row_number() OVER o AS n FROM h WINDOW o AS (PARTITION BY h ORDER BY doc_id, s)),
r AS (SELECT doc_id, s, source, s + {LENGTH} AS e, max(s + {LENGTH}) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f WHERE n > 1),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM r)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start_word, CAST(max(e) AS BIGINT) AS end_word, list_sort(list(DISTINCT source)) AS source_doc_ids
FROM g GROUP BY doc_id, span
"""


def _cut(text: str, starts: list[int], stops: list[int]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    begin, _, _ = ts.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    edge = [*begin.tolist(), len(raw)]
    out, at = [], 0
    for s, e in sorted(zip(starts, stops)):
        out.append(raw[at : edge[s]])
        at = edge[e]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with every span of `spans` cut from its text, up to the next word, and n_chars of what is left.

    The first occurrence stays. A document that a cut leaves without any word
    goes; all others stay, null and short texts among them, with all their
    columns, in whatever order; rows that repeat are cut alike. Columns of docs
    may have any names. An empty table gives no rows.

    Texts are shuffled once: the join that finds candidates and the one that
    cuts read the same exchange.
    """
    base = _base(docs)
    found = _merged(_found(base)).groupBy("i", "t").agg(F.collect_list("start_word").alias("starts"), F.collect_list("end_word").alias("stops"))

    @F.arrow_udf("string")
    def cut(text: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
        return pa.array([t if s is None else _cut(t, s, e) for t, s, e in zip(text.to_pylist(), starts.to_pylist(), stops.to_pylist())], pa.string())

    cut = cut.asNondeterministic()  # else the filter below would cut every text once more
    joined = base.join(found, ["i", "t"], "left")
    joined = joined.withColumn("left", F.when(F.col("starts").isNotNull(), cut("text", "starts", "stops")).otherwise(F.col("text")))
    joined = joined.where(F.col("starts").isNull() | F.col("left").rlike(r"[^ \t\n\x0b\f\r]"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("left").alias(name)
        kept = F.col("rest").getField(name)
        if name == "n_chars":
            return F.when(F.col("starts").isNull(), kept).otherwise(F.length("left").cast(docs.schema[name].dataType)).alias(name)
        return kept.alias(name)

    short = docs.where("text IS NULL OR octet_length(text) < %d" % (2 * LENGTH - 1))
    return joined.select(*map(column, docs.columns)).union(short)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's third stage: docs `without_repeats`, on the same terms."""
    return without_repeats(docs)
