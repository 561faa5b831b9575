"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF
from tests.oracle import compare, duck

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert df.count() >= 0
        return
    r = compare(df, con, ORACLES[name])
    assert r["cols"] and r["rows"] and r["hash"], r


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) > 0
