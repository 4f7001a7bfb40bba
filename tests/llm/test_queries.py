"""The registered queries against their SQL on whole tables."""

import oracle
import pytest

from rowforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert oracle.difference(queries.QUERIES[name](spark, folder), oracle.connect(folder), queries.ORACLES[name]) is None
