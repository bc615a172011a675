import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from treeline.llm import simhash
from treeline.llm.shared import least_rows, settled


def brute_roots(x):
    root = np.arange(len(x))
    for a, b in simhash._brute(x, np.arange(len(x))):
        least_rows(root, a, b)
    return settled(root)


def flipped(draw, base, most):
    """Each fingerprint with `most` of its bits turned."""
    bits = np.unpackbits(base.view(np.uint8).reshape(len(base), -1), axis=1)
    for row in bits:
        row[draw.choice(simhash.BITS, most, replace=False)] ^= 1
    return np.packbits(bits, axis=1).view(np.uint64)


def random_prints(draw, n):
    return np.packbits(draw.randint(0, 2, (n, simhash.BITS)).astype(np.uint8), axis=1).view(np.uint64)


def searched(x, level=0, recall=simhash.RECALL):
    root = np.arange(len(x))
    simhash._search(x, np.arange(len(x)), root, level, 7, None, recall)
    return settled(root)


def near_copies(seed, groups=60, size=5, words=150, changed=2):
    draw = random.Random(seed)
    rows, doc = [], 0
    for g in range(groups):
        text = [f"g{g}w{draw.randrange(10_000)}" for _ in range(words)]
        for _ in range(size):
            copy = list(text)
            for _ in range(changed):
                copy[draw.randrange(words)] = f"c{draw.randrange(10_000)}"
            rows.append((doc, " ".join(copy), g))
            doc += 1
    return rows


def test_near_copies_are_grouped_and_others_arent(spark, docs):
    rows = near_copies(1) + [(1000 + i, " ".join(f"u{i}x{k}" for k in range(120)), None) for i in range(100)]
    got = {r.doc_id: r.group_id for r in simhash.groups(docs([r[:2] for r in rows])).collect()}
    assert got == {d: 5 * g for d, _, g in rows if g is not None}


@pytest.mark.parametrize(("n", "apart"), [(12_000, 0), (3000, 8), (40_000, 0)])
def test_recursion_has_the_recall_against_brute_force(n, apart):
    """Pairs at the limit itself, and somewhat closer ones, are found at least as often as asked for."""
    draw = np.random.RandomState(3)
    base = random_prints(draw, n)
    x = np.concatenate([base, flipped(draw, base[:1500], simhash.DISTANCE - apart)])
    root = searched(x)
    found = (root[np.arange(1500)] == root[n : n + 1500]).mean()
    assert found >= simhash.RECALL - 0.015 and (np.bincount(root, minlength=len(x)) > 1).sum() <= 1500


def test_the_spread_level_has_its_recall_and_grows_without_a_step():
    """Rows that a fingerprint sends, as lists are held down to LOCAL: never a jump, and far less than in proportion."""
    draw = np.random.RandomState(4)
    base = random_prints(draw, 3000)
    other = flipped(draw, base, simhash.DISTANCE)
    before = None
    for n in (10**5 * 2**k for k in range(17)):
        kept = simhash.spread_kept(n)
        sent = simhash.filters_needed(simhash.BITS // 2, simhash.RECALL**0.5, kept) * sum(math.comb(128, i) for i in range(simhash._weight_limit(128, kept) + 1)) / 2.0**128
        assert before is None or sent <= before * 1.6
        assert kept * n <= max(simhash.LOCAL, simhash.ROOT * n**0.5) + 1 or kept == simhash.KEPT
        assert sent < 200
        before = sent
    together = np.zeros(3000, bool)
    for _, rows in simhash.Filters(simhash.SEED, 0, simhash.RECALL**0.5).passing(np.concatenate([base, other])):
        low = np.zeros(6000, bool)
        low[rows] = True
        together |= low[:3000] & low[3000:]
    assert together.mean() >= simhash.RECALL**0.5 - 0.015


def test_a_large_group_of_close_fingerprints_in_one_list():
    """50,000 different fingerprints around one centre, and others: in seconds, and as by brute force where that is feasible."""
    draw = np.random.RandomState(6)
    x = np.concatenate([flipped(draw, np.repeat(random_prints(draw, 1), 50_000, axis=0), 10), random_prints(draw, 5000)])
    began = time.monotonic()
    root = searched(x)
    assert (root[:50_000] == 0).all() and np.array_equal(root[50_000:], np.arange(50_000, 55_000))
    assert time.monotonic() - began < 60
    # a chain of groups, each within the limit of the next one's rim, and rows that only reach the rim
    centre = random_prints(draw, 1)
    chain = [centre]
    for _ in range(6):
        chain.append(flipped(draw, chain[-1], 30))
    y = np.concatenate([*(flipped(draw, np.repeat(c, 300, axis=0), 14) for c in chain), random_prints(draw, 900)])
    assert np.array_equal(searched(y), brute_roots(y))


def test_spread_over_tasks_as_within_one(spark):
    draw = np.random.RandomState(5)
    x = np.packbits(draw.randint(0, 2, (400, simhash.BITS)).astype(np.uint8), axis=1).view(np.int64)
    rows = [(i, *map(int, x[i // 2]) ) for i in range(800)]
    rows = [(i, r[1] ^ (i % 2), *r[2:]) for i, r in enumerate(rows)]
    nodes = spark.createDataFrame(rows, "node bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    want = {(i + 1, i) for i in range(0, 800, 2)}
    assert {tuple(r) for r in simhash.links(nodes, 800).collect()} == want
    assert {tuple(r) for r in simhash.links(nodes, 800, local=100).collect()} == want


def test_groups_of_the_table_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    x, some = simhash.fingerprints(pa.array([r.text for r in rows], pa.string()))
    root = brute_roots(x[some])
    ids = np.array([r.doc_id for r in rows])[some]
    sizes = np.bincount(root, minlength=len(root))
    want = {int(ids[i]): int(ids[root[i]]) for i in range(len(ids)) if sizes[root[i]] > 1}
    got = {r.doc_id: r.group_id for r in simhash.op10_simhash(spark, sf).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)


def test_thousands_of_copies_nulls_and_empty(spark, docs):
    rows = [(i, "the very same text again") for i in range(3000)] + [(5000, None), (5001, ""), (5002, " \n"), (None, "the very same text again"), (5003, "word " * 100_000), (5004, "else")]
    got = simhash.groups(docs(rows, "node f0 list root")).collect()
    assert len(got) == 3000 and {r.group_id for r in got} == {0}
    assert simhash.groups(docs([])).count() == 0


def test_stage_keeps_one_of_each_group(spark, docs):
    df = docs([(3, "same words here"), (1, "same words here"), (2, None), (4, "quite another text"), (None, "same words here")], "group_id a b")
    out = simhash.stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 2, 4, None]
