"""Every registered query against DuckDB on the smallest tables."""

import __spark_entry__ as entry
import pytest
from oracle import connect, difference

from rowforge.plans import registered

FOLDER = "/root/testdata/sf0.001"
# results that may be empty on the smallest tables
MAY_BE_EMPTY = {"slo_breach"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


QUERIES, SQL = registered()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert difference(df, con, SQL[name]) is None
    if name not in MAY_BE_EMPTY:
        assert con.execute(f"SELECT count(*) FROM ({SQL[name]})").fetchall()[0][0] > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 1
