"""Nulls and empty fields: no row is lost, and a null matches nothing."""

from __future__ import annotations

import datetime as dt

from conftest import SMALL
from pyspark.sql import functions as F

from panelwright.operators.asof import asof_join
from panelwright.operators.windows import with_dry_streak
from panelwright.plans.area_tables import registry_rows
from panelwright.plans.tables import calendar_ends, sparse_weather, table, weather_panel
from panelwright.sources.tables import read_registry, read_table


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_a_null_key_finds_nothing(spark):
    left = spark.createDataFrame([(1, "a", day(5)), (2, None, day(5)), (3, "a", None)], "i int, k string, t timestamp")
    right = spark.createDataFrame([("a", day(1), 7), (None, day(1), 1), ("a", None, 9)], "k string, at timestamp, v int")
    got = asof_join(left, right, left_ts="t", right_ts="at", by=["k"], cols=["v"])
    assert {r.i: r.v for r in got.collect()} == {1: 7, 2: None, 3: None}
    assert got.columns == ["i", "k", "t", "v"]


def test_missing_rain_ends_a_dry_run(spark):
    rain = [9.0, 0.0, None, 0.0, 0.0, 3.0, 0.0]
    df = spark.createDataFrame(
        [("d", day(i).date(), r) for i, r in enumerate(rain)],
        "District string, Date date, Rainfall_Observed_mm double",
    )
    got = with_dry_streak(df, 2.5).orderBy("Date").collect()
    assert [r.Dry_Spell_Days_Streak for r in got] == [0, 1, 0, 1, 2, 0, 1]


def test_registry_rows_with_empty_columns_stay(spark, tmp_path):
    path = tmp_path / "registry.csv"
    path.write_text("Village directory\ncode,name,block\n0172,,9\n,x,\n7,name,8\n")
    rows = read_registry(spark, str(path), ["code", "name", "block"]).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("0172", None, "9"), (None, "x", None), ("7", "name", "8")], key=str)


def test_read_table_falls_back_on_a_missing_path_only(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n1\n")
    assert read_table(spark, str(tmp_path / "none"), str(tmp_path / "t.csv"), "a int").first().a == 1
    (tmp_path / "empty").mkdir()
    try:
        read_table(spark, str(tmp_path / "empty"), str(tmp_path / "t.csv"), "a int").first()
        raise AssertionError("an unreadable table must not be replaced")
    except Exception as error:
        assert "UNABLE_TO_INFER_SCHEMA" in str(error)


def test_registry_recipe_covers_all_lines(spark):
    lines = table(spark, SMALL, "lineitem").select("l_orderkey", "l_suppkey").distinct().count()
    assert registry_rows(spark, SMALL).count() == lines


def test_panel_holds_all_rain(spark):
    sums = [df.agg(F.sum("Rainfall_Observed_mm")).first()[0]
            for df in (sparse_weather(spark, SMALL), weather_panel(spark, SMALL))]
    assert sums[0] == sums[1]
    first, last = calendar_ends(spark, SMALL)
    ends = spark.range(1).select(first.alias("a"), last.alias("b")).first()
    assert (ends.a.month, ends.a.day, ends.b.month, ends.b.day) == (1, 1, 12, 31)
