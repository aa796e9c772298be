"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from lineup.plans import catalog
from tools.oracle_check import compare, duck

catalog.load_all()
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


def test_every_query_has_an_oracle_or_is_documented():
    rows_only = set(QUERIES) - set(ORACLES)
    assert rows_only == {"model_metrics"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query_matches_oracle(spark, con, small_dir, name):
    sp = QUERIES[name](spark, small_dir).toPandas()
    dk = con.execute(ORACLES[name]).df()
    assert compare(sp, dk) is None


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "avg_pts_last_10" in df.columns
