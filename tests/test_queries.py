import pytest

import __spark_entry__ as entry
from treeline.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(agree, name):
    agree(QUERIES[name], ORACLES[name])


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["page_id", "href"]


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_approximate_latency_is_near_the_exact_one(spark, sf):
    exact = {r.operation_type: r for r in QUERIES["latency_percentiles"](spark, sf).collect()}
    for r in QUERIES["latency_approx"](spark, sf).collect():
        assert r.n == exact[r.operation_type].n
        assert r.p[0] == pytest.approx(exact[r.operation_type].p50, rel=0.05)
