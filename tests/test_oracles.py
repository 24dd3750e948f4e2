"""Every query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as entry
from granary.plans import registry
from tests import brute
from tests.oracle import compared, connect

entry._plans()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.SQL:
        assert compared(df, con, registry.SQL[name]) is None
    else:
        getattr(brute, name)(spark, sf, df.collect())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and abs(sum(r["probability"] for r in rows if r["source"] == "current") - 1) < 1e-4
