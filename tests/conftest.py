import os

import pytest

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    """A value as something that compares and sorts alike from both engines."""
    if value is None or value != value:
        return None
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "tzinfo"):
        return str(value.replace(tzinfo=None))
    return value


@pytest.fixture(scope="session")
def agree(spark, sf, duck):
    """Asserts that a query and its SQL give the same columns and rows."""

    def check(run, sql):
        df = run(spark, sf)
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(names)
        key = lambda r: [(x is not None, str(x)) for x in r]
        ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
        theirs = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=key)
        assert ours == theirs

    return check
