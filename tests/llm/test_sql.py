"""Corpus queries against their SQL counterparts."""

import pytest

from granary.llm.queries import QUERIES, SQL
from tests.oracle import compared, connect


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, name):
    assert compared(QUERIES[name](spark, sf), connect(sf), SQL[name]) is None
