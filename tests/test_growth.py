"""Plans that must not lean on the size of small files, as exploded rows outgrow them."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.plans import all_queries, score_queries, source_queries

PLANS, _ = all_queries()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["polygon_defects", "polygon_problems", "multipolygon_defects", "spatial_validation_summary"]
)
def test_edges_are_never_broadcast(spark, name):
    assert "Broadcast" not in physical(PLANS[name](spark, SMALL))


@pytest.mark.parametrize("name", ["horizon_trend", "outlook_nesting"])
def test_forecasts_are_spread_before_they_grow(spark, name):
    plan = physical(PLANS[name](spark, SMALL))
    assert plan.index("Generate explode") < plan.index("REPARTITION_BY_NUM")


def test_trend_rows_are_aggregated_once(spark):
    plan = physical(PLANS["horizon_trend"](spark, SMALL))
    assert plan[: plan.index("Generate explode")].count("HashAggregate") == 2  # partial and final


@pytest.mark.parametrize("name", ["replay_records", "replay_metrics", "released_head_results"])
def test_panel_rows_with_features_are_not_shuffled(spark, name):
    """Zones and dates are few and meet the panel by broadcast, rates by district."""
    plan = physical(PLANS[name](spark, SMALL))
    joins = [line for line in plan.split("\n") if "SortMergeJoin" in line]
    assert not [j for j in joins if "[Zone#" in j or "[Date#" in j or "month#" in j or "Date#" in j]


def test_features_are_tested_by_one_array_function(spark):
    """Written out, the tests of forty features a head make methods the JVM does not compile."""
    plan = physical(PLANS["replay_records"](spark, SMALL))
    assert plan.count("exists(array(") >= 3 and plan.lower().count("isnan(") < 40


@pytest.mark.parametrize("name", ["climatology_rates", "label_events_v2"])
def test_labels_pass_few_windows(spark, name):
    """One pass for the gaps, six for the labels, two where the dry streak is a column."""
    plan = physical(PLANS[name](spark, SMALL))
    windows = [line for line in plan.split("\n") if "+- Window [" in line]
    assert len(windows) <= (9 if name == "label_events_v2" else 7)


def test_held_out_rows_are_counted_before_they_are_stacked(spark):
    """And they meet the few rows per event by broadcast, not gathered by event."""
    plan = physical(score_queries.baseline_counts(spark, SMALL))
    assert "HashAggregate" in plan[plan.index("Generate explode"):]
    assert not re.search(r"SortMergeJoin \[event#\d+\],", plan)


def test_missing_units_open_one_set_per_group(spark):
    plan = physical(PLANS["missing_units"](spark, SMALL))
    assert 0 < plan.count("collect_set(") - plan.count("partial_collect_set(") <= 2


def test_unused_attributes_of_safe_rows_are_not_carried(spark):
    plan = physical(PLANS["dissolved_parts"](spark, SMALL))
    assert "any_value(" in plan or "first(" in plan
    assert "body_name#" not in plan and "block_name#" not in plan


def test_codes_are_cleaned_as_before(spark):
    texts = ["", " ", "NaN", "none", " NONE ", "nones", "1.0", "1.00", "1.0.0", ".0", "1.0\n", "10", "a.0b", "x.05", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(S.clean_code("t")).collect()
    assert [r[0] for r in got] == [
        None, None, None, None, None, "nones", "1", "1.00", "1.0", "", "1\n", "10", "a.0b", "x.05", None,
    ]


def test_zone_rows_are_neither_sorted_nor_broadcast(spark):
    """Written zone by zone, too: sorting the wide rows by file took most of a writer's memory."""
    plan = physical(source_queries._zone_rows(spark, SMALL))
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortAggregate", "")


def test_zones_without_rows_have_empty_files(spark, tmp_path):
    for name in ("lineitem", "nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    african = spark.read.parquet(f"{SMALL}/nation.parquet").where("n_regionkey = 0").select("n_nationkey")
    spark.read.parquet(f"{SMALL}/supplier.parquet").join(
        african, F.col("s_nationkey") == F.col("n_nationkey"), "left_anti"
    ).write.parquet(f"{tmp_path}/supplier.parquet")
    got = PLANS["zone_files_read_back"](spark, str(tmp_path)).groupBy("zone_id").count().collect()
    want = spark.read.parquet(f"{SMALL}/lineitem.parquet").join(
        spark.read.parquet(f"{tmp_path}/supplier.parquet"), F.col("s_suppkey") == F.col("l_suppkey")
    ).select("s_suppkey", F.to_date("l_shipdate")).distinct().count()
    zones = {r["zone_id"]: r["count"] for r in got}
    assert "af" not in zones and sum(zones.values()) == want > 0


@pytest.mark.parametrize("name", ["climatology_rates", "district_month_rate_lookup"])
def test_rates_pass_five_windows_without_sliding_frames(spark, name, monkeypatch):
    """One pass for the gaps and four for the labels; a sliding frame copies every row it passes."""
    monkeypatch.setattr(score_queries, "staged", lambda df, label: df)
    plan = physical(PLANS[name](spark, SMALL))
    windows = [line for line in plan.split("\n") if "+- Window [" in line]
    panels = len([line for line in windows if "row_number()" in line])
    assert panels > 0 and len(windows) == 5 * panels
    frames = [f for line in windows for f in re.findall(r"(\w+)\([^()]*\) windowspecdefinition\([^()]*specifiedwindowframe\(RowFrame, (-?\d+)", line)]
    assert frames and {name for name, _ in frames} == {"lead"}


def test_rate_counts_are_filtered_where_they_are_read(spark):
    plan = physical(PLANS["district_month_rate_lookup"](spark, SMALL))
    assert "Scan ExistingRDD" not in plan
    assert "EqualTo(split,test), EqualTo(event,all)" in plan
