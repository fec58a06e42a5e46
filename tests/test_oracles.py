"""Every query with comparison SQL against DuckDB on the same files."""

import pytest

import __spark_entry__ as entry
from oracle_harness import compare, connect

SQLS = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_same_rows(spark, sf, con, name):
    n, faults = compare(spark, name, QUERIES[name], SQLS[name], sf, con)
    assert not faults
    assert n > 0


def test_names():
    assert set(SQLS) <= set(QUERIES)
    try:
        from tallyloom.llm.queries import QUERIES as own
    except ImportError:
        own = {}
    assert {n for n in QUERIES if n.startswith("op")} == set(own)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["month", "creator", "n", "rank", "percent"]
    assert df.count() > 0


LIGHT = (
    "adf_test pacf ar_fit ar_fitted ma_fit arma_fit armax_fit granger_test walk_forward_error pca_2d "
    "reg_split linreg_reg tree_reg linreg_summary linreg_training linreg_features_per_key"
).split()


@pytest.mark.parametrize("name", LIGHT)
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
