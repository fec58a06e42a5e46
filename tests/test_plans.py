"""Shapes of plans: no row-wise Python, no products of tables, pruned scans."""

import re

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
# Queries whose small least-squares solves run as Arrow batches.
ARROW = {
    "df_test", "pacf_lag1", "ar1_fit", "arma_11_fit", "granger_lag1", "walk_forward", "linreg_per_key",
    "series_rebuild", "series_rss", "series_long",
}


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_plan_shape(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "BatchEvalPython" not in text
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if name not in ARROW:
        assert "MapInPandas" not in text and "FlatMapGroupsInPandas" not in text
    for cell in re.findall(r"Window\n.*?Arguments: (.*)", text):
        assert not re.search(r"\], \[\]", cell) or "windowspecdefinition(" in cell


def test_unpartitioned_windows(spark, sf):
    """A window without keys would move all rows into one task."""
    for name in entry.oracle_sql():
        df = QUERIES[name](spark, sf)
        for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
            found = re.search(r"\bWindow \[.*\](?:, \[(.*?)\])?(?:, \[(.*?)\])?$", line)
            if found and " Window " in f" {line}":
                assert "windowspecdefinition(" in line
                spec = re.search(r"windowspecdefinition\((.*?)(?: ASC| DESC|, specifiedwindowframe)", line).group(1)
                assert spec.strip(), name


def test_pruning_and_pushdown(spark, sf):
    text = plan(QUERIES["filter_category"](spark, sf))
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,2-HIGH)]" in text
    schema = re.search(r"ReadSchema: (.*)", plan(QUERIES["count_by_month"](spark, sf))).group(1)
    assert schema == "struct<o_orderdate:timestamp_ntz>" or schema == "struct<o_orderdate:timestamp>"


def test_semi_and_anti(spark, sf):
    assert "LeftSemi" in plan(QUERIES["active_creators_band"](spark, sf))
    assert "LeftAnti" in plan(QUERIES["anti_join_terms"](spark, sf))
