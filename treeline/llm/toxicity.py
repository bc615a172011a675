"""Operator 8: toxicity, by averaged subword embeddings and a linear softmax.

A word is the bag of its character n-grams with its ends marked, each hashed
to a row of an embedding table. A document is the average of its distinct words'
n-grams' rows; a softmax over two classes is linear in it. Table and softmax are trained
together by stochastic gradients in numpy, both classes with the same weight.
Only n-grams whose rates in the two classes differ beyond chance have a row: the
others would learn the sample by heart. A misspelling that was never seen
shares most n-grams with its word, and so its vectors.

Scoring uses that the model is linear: the two classes' logits differ by the
mean over a document's n-grams of one number a row. Texts are scored whole, by
vectorised hashing of every n-gram of every word.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import textscan as ts
from treeline.llm.shared import read

BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 4, 5)
EPOCHS = 12
#: Few texts get more epochs, up to so many steps.
LEAST_STEPS = 600
BATCH = 64
RATE = 0.3
SEED = 11
#: An n-gram has a row where its rates in toxic and clean training texts differ: the least log-likelihood ratio statistic, so that the texts it takes follow how many are toxic.
EVIDENCE = 8
#: Empty n-grams that every document's average holds besides its own, so that a handful of odd ones doesn't decide.
PADDING = 400
#: Most labelled documents to train on: half of them toxic where there are as many. The classifier is fitted on this bounded sample, everything else covers all rows.
MOST_LABELLED = 4000
THRESHOLD = 0.7

_U = np.uint64
_BASE = _U(0x100000001B3 * 0x10001 | 1)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0: dropped, 1: part of a word (letter, mark, digit), 2: white space."""
    return np.array([2 if chr(c).isspace() else int(unicodedata.category(chr(c))[0] in "LMN") for c in range(sys.maxunicode + 1)], np.uint8)


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all words and n-grams of the texts, and the text that each is in, one length after another.

    Letter case is folded; words are what lies between white space, less all
    characters that aren't letters, marks or digits, so that a dot within a word
    doesn't hide it. A word's n-grams count the blanks on both sides of it. Each
    word of a text counts once, so that no word wins by repetition.
    """
    folded = [f" {t.lower()} " for t in texts]
    chars = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in folded])
    kind = _kinds()[chars]
    keep = kind > 0
    chars, text, gap = chars[keep], text[keep], kind[keep] == 2
    once = np.ones(len(chars), bool)
    once[1:] = ~(gap[1:] & gap[:-1]) | (text[1:] != text[:-1])
    chars, text, gap = chars[once], text[once], gap[once]
    mixed = ts.mix(np.where(gap, 32, chars).astype(np.uint64) + _U(1))
    gaps = np.flatnonzero(gap)
    if len(gaps) < 2:
        return
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * ts.powers(len(chars)))])
    first, last = gaps[:-1], gaps[1:]
    real = (last > first + 1) & (text[first] == text[last])
    first, last = first[real], last[real]
    whole = (total[last] - total[first + 1]) * ts.powers(len(chars), inverse=True)[first]
    # a word that a text has again adds nothing
    _, once = np.unique(ts.mix(whole + text[first].astype(np.uint64) * _BASE), return_index=True)
    once.sort()
    first, last, whole = first[once], last[once], whole[once]
    yield (ts.mix(whole) & _U(BUCKETS - 1)).astype(np.int32), text[first]
    edge = np.zeros(len(chars) + 1, np.int8)
    edge[first + 1] += 1
    edge[last + 1] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    keep[0] = True
    keep[1:] |= text[1:] != text[:-1]  # the blank before a text's first word
    mixed, text, gaps = mixed[keep], text[keep], np.flatnonzero(gap[keep])
    n = len(mixed)
    # the blank that ends the word which begins at or after each place
    end = np.append(gaps, n)[np.searchsorted(gaps, np.arange(n), "right")].astype(np.int32)
    places = np.arange(n, dtype=np.int32)
    acc = np.zeros(n, np.uint64)
    for k in range(min(max(GRAMS), n)):
        acc = acc[: n - k] * _BASE + mixed[k:]
        if k + 1 in GRAMS:
            start = np.flatnonzero((end[: n - k] >= places[k:]) & (text[: n - k] == text[k:]))
            yield (ts.mix(acc[start] + _U(k)) & _U(BUCKETS - 1)).astype(np.int32), text[start]


def _by_text(texts: pa.Array) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """For runs [a, b) of texts: a, b, and pieces of the n-grams' buckets with the text in [0, b - a) of each."""
    texts = pc.fill_null(texts, "")
    _, off = ts.raw(texts)
    for a, b in ts.chunks(off):
        yield a, b, _grams(texts.slice(a, b - a).to_pylist())


@dataclass
class Model:
    """weights[bucket]: what the n-gram adds to the difference of the two logits; bias: the rest."""

    weights: np.ndarray
    bias: float

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Of being toxic; nan for a text without n-grams, null or blank."""
        out = np.full(len(texts), np.nan)
        for a, b, pieces in _by_text(texts):
            n, total = np.zeros(b - a, np.int64), np.zeros(b - a)
            for buckets, text in pieces:
                n += np.bincount(text, minlength=b - a)
                total += np.bincount(text, self.weights[buckets], minlength=b - a)
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                out[a:b] = np.where(n > 0, 1 / (1 + np.exp(-(total / (n + PADDING) + self.bias))), np.nan)
        return out


def _evidence(texts_with: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Of each n-gram, twice the log of the likelihood ratio of two rates, one a class, to one rate. texts_with[class, bucket]: texts that have it; known: texts by class."""

    def log(k: np.ndarray, n: np.ndarray) -> np.ndarray:
        share = np.clip(k / np.maximum(n, 1), 1e-12, 1 - 1e-12)
        return k * np.log(share) + (n - k) * np.log(1 - share)

    return 2 * (log(texts_with, known[:, None]).sum(0) - log(texts_with.sum(0), known.sum()))


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fits table and softmax jointly. Texts without n-grams are skipped; without both classes nothing is toxic."""
    ids, parts, sizes, labels = [], [], [], []
    for a, b, pieces in _by_text(pa.array(texts, pa.large_string())):
        key, count = np.unique(np.concatenate([text.astype(np.int64) * BUCKETS + buckets for buckets, text in pieces]), return_counts=True)
        ids.append((key % BUCKETS).astype(np.int32))
        parts.append(count.astype(np.float32))
        sizes.append(np.bincount(key // BUCKETS, minlength=b - a))
        labels.append(toxic[a:b])
    if not ids:
        return Model(np.zeros(BUCKETS), -20.0)
    y = np.concatenate(labels)
    used = np.flatnonzero(np.concatenate(sizes) > 0)
    known = np.bincount(y[used], minlength=2)
    if not known.all():
        return Model(np.zeros(BUCKETS), -20.0)
    texts_with = np.zeros((2, BUCKETS))
    for i, n, toxic_or_not in zip(ids, sizes, labels):
        mark = np.repeat(toxic_or_not, n)
        for c in (0, 1):
            texts_with[c] += np.bincount(i[mark == c], minlength=BUCKETS)
    seen = _evidence(texts_with, known) >= EVIDENCE
    # the average is over all n-grams; those without a row are zero in it. One run at a time, so that little is held twice
    for k, (i, p, n) in enumerate(zip(ids, parts, sizes)):
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        p /= (np.bincount(doc, p, len(n)) + PADDING).astype(np.float32)[doc]
        kept = seen[i]
        ids[k], parts[k], sizes[k] = i[kept], p[kept], np.bincount(doc[kept], minlength=len(n))
    idx, part, size = np.concatenate(ids), np.concatenate(parts), np.concatenate(sizes)
    del ids, parts
    if not len(idx):
        return Model(np.zeros(BUCKETS), -20.0)
    # both classes weigh the same, however few of the texts are toxic
    weight = (len(used) / (2 * known)).astype(np.float32)
    at = np.concatenate([[0], np.cumsum(size)])
    draw = np.random.RandomState(seed)
    table = draw.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    table[~seen] = 0
    soft, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    g_table, g_soft, g_bias = np.full(BUCKETS, 1e-8, np.float32), np.full_like(soft, 1e-8), np.full_like(bias, 1e-8)
    batches = []
    order = draw.permutation(used)
    for s in range(0, len(order), BATCH):
        rows = order[s : s + BATCH]
        take = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows])
        unique, back = np.unique(idx[take], return_inverse=True)
        batches.append((rows, size[rows], unique, back.astype(np.int32), part[take]))
    del idx, part
    for _ in range(max(epochs, -(-LEAST_STEPS // len(batches)))):
        for k in draw.permutation(len(batches)):
            rows, counts, unique, back, share = batches[k]
            first = np.cumsum(counts) - counts
            mean, some = np.zeros((len(rows), DIMENSIONS), np.float32), counts > 0  # a text may be left without rows
            if some.any():
                mean[some] = np.add.reduceat(table[unique][back] * share[:, None], first[some], axis=0)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (weight[y[rows]] / len(rows))[:, None]
            d_soft, d_bias, d_mean = mean.T @ p, p.sum(0), p @ soft.T
            doc = np.repeat(np.arange(len(rows)), counts)
            grad = np.stack([np.bincount(back, share * d_mean[doc, j], len(unique)) for j in range(DIMENSIONS)], 1)
            # each row's steps are scaled by what its gradients have summed up to (Adagrad): an average's parts are small
            g_table[unique] += (grad**2).mean(1)
            g_soft += d_soft**2
            g_bias += d_bias**2
            table[unique] -= RATE * grad / np.sqrt(g_table[unique])[:, None]
            soft -= RATE * d_soft / np.sqrt(g_soft)
            bias -= RATE * d_bias / np.sqrt(g_bias)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[list[str], np.ndarray]:
    """At most `most` labelled texts with their toxic label, one a document, in an order fixed by the ids' hashes.

    An id with several labels is toxic if one of them says so; of several texts
    of one id the least counts. Rows without an id, a label or a text are left out.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__toxic"))
    known = known.withColumn("__h", F.xxhash64("doc_id"))
    halves = [known.where(F.col("__toxic") == c).orderBy("__h", "doc_id").limit(most // 2) for c in (0, 1)]
    picked = halves[0].unionByName(halves[1])
    # at most `most` rows, so small enough to be broadcast; and as many come to the driver
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    rows = texts.groupBy("doc_id", "__toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r["__toxic"], r.text))
    return [r.text for r in rows], np.array([r["__toxic"] for r in rows], np.int64)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    return train(*sample(docs, labels, most))


def score(docs: DataFrame, model: Model, name: str = "__toxicity") -> DataFrame:
    """docs with one more column `name` DOUBLE in [0, 1]; null where the text is null or has no letter or digit.

    Every row is scored by itself, so ties, repeats and further columns change
    nothing; columns keep their names, and one that is called `name` already is
    an error. Texts are scored whole. An empty table gives no rows.
    """
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        p = shared.value.probabilities(texts)
        return pa.array(p, pa.float64(), mask=np.isnan(p))

    # else a filter on the score would be pushed below it, and every text scored twice
    return docs.withColumn(name, run.asNondeterministic()(F.col("text")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are rejected as toxic, with their probability: THRESHOLD or more. Those without a score aren't."""
    docs = read(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, read(spark, sf_dir, "labels")))
    return scored.where(F.col("__toxicity") >= THRESHOLD).select("doc_id", F.col("__toxicity").alias("probability"), F.lit(True).alias("toxic"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's first stage: docs without those that are toxic, by THRESHOLD or more; a document without a score stays. Columns of docs may have any names."""
    name = "__toxicity"
    while name in docs.columns:
        name += "_"
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")), name)
    return scored.where(~F.coalesce(F.col(name) >= THRESHOLD, F.lit(False))).drop(name)
