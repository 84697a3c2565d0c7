"""Every registered query: plan without pair-wise joins or Python, rows equal to its SQL."""

from __future__ import annotations

import re

import pytest
from compare import compare, connect
from conftest import SMALL

import __spark_entry__ as entry
from panelwright.plans import all_queries

PLANS, SQL = all_queries()
# strategies that pair all rows, and row-at-a-time Python
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "EvalPython")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(spark, duck, name):
    def plan(session, sf_dir):
        df = PLANS[name](session, sf_dir)
        if name in SQL:
            text = physical(df)
            assert not [b for b in BANNED if b in text]
        return df

    difference, _ = compare(spark, duck, plan, SQL.get(name), SMALL)
    assert difference is None, difference


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 25570 and df.columns[:2] == ["district", "day"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(PLANS) and len(SQL) > 100


def test_label_plan_has_two_shuffles_and_one_sort_after_the_dense_rows(spark):
    plan = physical(PLANS["label_events_v2"](spark, SMALL))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    top = plan[: plan.index("Generate explode")]
    assert len(re.findall(r"\bSort \[", top)) == 1


def test_only_needed_columns_are_read(spark):
    plan = physical(PLANS["daily_panel"](spark, SMALL))
    schema = re.search(r"ReadSchema: (struct<l_[^>]*>)", plan).group(1)
    assert "l_extendedprice" not in schema and "l_comment" not in schema
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan


def test_asof_plan_joins_nothing(spark):
    assert "Join" not in physical(PLANS["asof_events_per_user"](spark, SMALL))


@pytest.mark.parametrize("name,scans,exchanges", [
    ("index_values_at_references", 4, 7), ("features_as_of", 9, 21), ("missing_units", 9, 20),
    ("as_of_feature_vectors", 13, 27), ("feature_shift", 2, 3),
])
def test_scans_and_exchanges_without_broadcasts(spark, name, scans, exchanges):
    """Plans as they are on tables too large to broadcast."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        plan = physical(PLANS[name](spark, SMALL))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert plan.count("FileScan parquet") <= scans
    assert len(re.findall(r"(?<!Reused)Exchange (?:hash|Single|range)", plan)) <= exchanges
