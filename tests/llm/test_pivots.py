import numpy as np
import pytest

from treeline.llm import pivots

SCHEMA = "vec_id bigint, embedding array<float>"


def clusters(n, width, seed, spread=0.08):
    draw = np.random.RandomState(seed)
    base = draw.normal(size=(n // 4, width))
    x = np.repeat(base, 4, axis=0) + spread * draw.normal(size=(n // 4 * 4, width))
    return x.astype(np.float32)


def brute(x, cosine):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T, 1) >= cosine)
    return set(zip(i.tolist(), j.tolist()))


def pairs(spark, x, **k):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    return {(r.a, r.b): r.cosine for r in pivots.pairs(df, **k).collect()}


def test_recall_and_precision_against_brute_force(spark):
    x = clusters(4000, 32, 1)
    want, got = brute(x, pivots.COSINE), pairs(spark, x, block=64)
    assert set(got) <= want and len(want) > 1000
    assert len(got) >= 0.95 * len(want)


@pytest.mark.parametrize("inner", [0.98, 0.94])
def test_a_large_group_of_near_copies_against_brute_force(spark, inner):
    """2,000 of 20,000 vectors, whose cosines with one another are about `inner`; pivots were drawn from the group by dozens."""
    draw = np.random.RandomState(6)
    x = draw.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = draw.normal(size=(2000, 64))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x[:2000] = np.sqrt(inner) * x[0] + np.sqrt(1 - inner) * noise
    x = x.astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = np.triu(u @ u.T, 1) >= pivots.COSINE
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = pivots.pairs(df).toArrow()
    a, b = got["a"].to_numpy(), got["b"].to_numpy()
    assert near[a, b].all() and len(set(zip(a.tolist(), b.tolist()))) == len(a)
    assert near.sum() > 100_000 and len(a) >= 0.9 * near.sum()


def test_blocks_change_nothing(spark):
    x = clusters(600, 16, 2)
    assert pairs(spark, x, block=16) == pairs(spark, x, block=100_000)


def test_the_table_with_near_copies_against_brute_force(spark):
    """The table's own vectors, each with a copy at a cosine from about 0.93 to 1."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    draw = np.random.RandomState(1)
    noise = draw.normal(size=x.shape)
    noise *= draw.uniform(0, 0.4, (len(x), 1)) / np.linalg.norm(noise, axis=1, keepdims=True)
    both = np.concatenate([x, x + noise]).astype(np.float32)
    want, got = brute(both, pivots.COSINE), pairs(spark, both)
    assert len(want) > 1000 and set(got) <= want and len(got) >= 0.9 * len(want)


def test_nulls_ties_repeats_lengths_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, None), (None, [1.0, 0.0]), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (12, [0.0, 1.0]), (12, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "'y' AS v", "'z' AS pivot", "1 AS k", "2 AS node", "3 AS copies", "4 AS links")
    assert {(r.a, r.b): r.cosine for r in pivots.pairs(df).collect()} == {(1, 3): 1.0}
    got = {r.vec_id: (r.class_id, r.n_links) for r in pivots.groups(df).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 9: (9, 1), 10: (9, 1), 11: (11, 1), 12: (1, 4)}
    assert pivots.pairs(df.limit(0)).count() == 0 and pivots.groups(df.limit(0)).count() == 0
    one = pivots.groups(df.where("vec_id = 3")).collect()
    assert [(r.vec_id, r.class_id, r.n_links) for r in one] == [(3, 3, 0)]


def rows_of(x, cosine):
    """Class and links of every row by brute force."""
    n = len(x)
    links, root = np.zeros(n, int), list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in brute(x, cosine):
        links[i] += 1
        links[j] += 1
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    return {i: (top(i), int(links[i])) for i in range(n)}


def test_every_row_has_its_class_and_links(spark, tmp_path):
    """Groups of equal vectors next to near ones and single ones, against brute force over rows and against the SQL."""
    import duckdb

    x = np.concatenate([np.repeat(clusters(200, 16, 4), 3, axis=0), clusters(40, 16, 5)[::4], -clusters(8, 16, 6)])
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.class_id, r.n_links) for r in pivots.op9_pivots(spark, str(tmp_path)).collect()}
    assert got == rows_of(x, pivots.COSINE) and max(n for _, n in got.values()) > 5
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert {r[0]: (r[1], r[2]) for r in con.execute(f"SELECT vec_id, class_id, n_links FROM ({pivots.OP9_SQL})").fetchall()} == got


def test_links_of_a_large_group_and_of_its_copies(spark):
    """1,500 near copies and 3,000 equal vectors: counts in full, a row each."""
    draw = np.random.RandomState(8)
    x = draw.normal(size=(9000, 32))
    x[:1500] = x[0] + 0.05 * draw.normal(size=(1500, 32))
    x[1500:4500] = x[1500]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: (r.class_id, r.n_links) for r in pivots.groups(df, block=512).collect()}
    assert len(got) == 9000 and all(got[i] == (1500, 2999) for i in range(1500, 4500))
    assert sum(got[i][1] for i in range(1500)) >= 0.95 * 1500 * 1499 and {got[i][0] for i in range(1500)} == {0}
