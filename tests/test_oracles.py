"""Every registered query against its SQL statement on the smallest data set."""

import pytest
from check_oracles import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    status, n, note = compare(spark, con, name, QUERIES[name], SQL.get(name), FOLDER)
    assert status in ("ok", "ok~", "rows"), note


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["market", "pos", "ticker", "final_score"]
    assert df.count() > 0


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
