"""Point-in-time joins: brute force, ties, hot keys and the publication rules."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators import asof as A
from panelwright.operators import panel as P


def when(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("block", ["hour", "day", "month"])
def test_asof_join_equals_brute_force_with_a_hot_key(spark, block):
    rng = random.Random(3)
    # key 0 holds most rows; keys repeat timestamps and some have no right rows at all
    keys = [0] * 8 + [1, 2, 3]
    left = [(i, rng.choice(keys), when(rng.randrange(0, 5000, 7))) for i in range(600)]
    right = [(rng.choice(keys[:-1]), when(rng.randrange(0, 5000, 11)), i) for i in range(300)]
    ldf = spark.createDataFrame(left, "id int, k int, ts timestamp")
    rdf = spark.createDataFrame(right, "k int, at timestamp, v int")
    got = {
        r["id"]: r["v"]
        for r in A.asof_join(
            ldf, rdf, left_ts="ts", right_ts="at", by=["k"], cols=["v"], block=block
        ).collect()
    }
    assert len(got) == len(left)
    for i, k, ts in left:
        known = [(at, v) for rk, at, v in right if rk == k and at <= ts]
        assert got[i] == (max(known)[1] if known else None)


def test_row_blocks_equal_brute_force_and_are_even(spark):
    rng = random.Random(4)
    # key 0 holds a third of all rows in one hour, many of them in one minute; null keys and times
    def row(i):
        if rng.random() < 0.35:
            return 0, when(rng.choice([10, rng.randrange(60)]))
        return rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, None]), rng.choice([None, when(rng.randrange(9000))])

    left = [(i, *row(i)) for i in range(4000)]
    right = [(*row(i), i) for i in range(1500)]
    ldf = spark.createDataFrame(left, "id int, k int, ts timestamp")
    rdf = spark.createDataFrame(right, "k int, at timestamp, v int")
    args = dict(left_ts="ts", right_ts="at", by=["k"])
    cuts = A.row_cuts(ldf, rdf, **args, blocks=32)
    known = {}
    for k, at, v in right:
        if k is not None and at is not None:
            known.setdefault(k, []).append((at, v))
    for table in (cuts, cuts.limit(0)):
        got = {r.id: r.v for r in A.asof_join(ldf, rdf, **args, cols=["v"], cuts=table).collect()}
        assert len(got) == len(left)
        for i, k, ts in left:
            before = [x for x in known.get(k, []) if ts is not None and x[0] <= ts]
            assert got[i] == (max(before)[1] if before else None)
    spread = A._row_blocks(
        ldf.dropna(), rdf.dropna().select("k", F.col("at").alias("_at"), F.struct("v").alias("_value")),
        "ts", ["k"], cuts)
    sizes = [r["count"] for r in spread[2].where("k = 0").groupBy("_block").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 2 * 5500 / 32
    assert cuts.count() <= 32 and A.row_cuts(ldf.limit(0), rdf.limit(0), **args).count() == 0


def test_duplicate_left_rows_are_kept(spark):
    left = spark.createDataFrame([(1, dt.date(2024, 1, 5))] * 3, "k int, d date")
    right = spark.createDataFrame([(1, dt.date(2024, 1, 1), "x")], "k int, at date, v string")
    out = A.asof_join(left, right, left_ts="d", right_ts="at", by=["k"], cols=["v"], block="month")
    assert [r["v"] for r in out.collect()] == ["x"] * 3


def releases(spark):
    raw = spark.createDataFrame(
        [(dt.date(2025, 5, 19), dt.date(2025, 5, 25), 0.5), (dt.date(2025, 5, 26), dt.date(2025, 6, 1), -0.6)],
        "period_start date, period_end date, iod_dmi double",
    )
    return A.weekly_releases(raw)


def test_weekly_release_is_used_from_day_three(spark):
    days = P.calendar(spark, "2025-05-26", "2025-06-06")
    daily = A.index_features(
        A.daily_release_values(days, releases(spark), cols=["iod_dmi", "period_end", "available_date"])
    )
    got = {r["Date"]: r for r in daily.collect()}
    assert got[dt.date(2025, 5, 27)]["iod_dmi"] is None
    assert got[dt.date(2025, 5, 27)]["iod_positive_flag"] == 0
    assert got[dt.date(2025, 6, 3)]["iod_dmi"] == 0.5 and got[dt.date(2025, 6, 3)]["iod_positive_flag"] == 1
    assert got[dt.date(2025, 6, 4)]["iod_dmi"] == -0.6 and got[dt.date(2025, 6, 4)]["iod_negative_flag"] == 1
    assert got[dt.date(2025, 6, 6)]["iod_dmi_lag7"] == 0.5
    known = daily.where("iod_dmi is not null")
    assert A.release_violations(known).count() == 0


def test_release_violations_are_found(spark):
    df = spark.createDataFrame(
        [
            (dt.date(2025, 6, 5), dt.date(2025, 6, 1), dt.date(2025, 6, 4)),
            (dt.date(2025, 6, 6), dt.date(2025, 6, 1), dt.date(2025, 6, 7)),
            (dt.date(2025, 6, 6), dt.date(2025, 6, 1), dt.date(2025, 6, 2)),
        ],
        "Date date, period_end date, available_date date",
    )
    got = sorted(r["violation"] for r in A.release_violations(df).collect())
    assert got == ["published_before_delay", "used_before_publication"]


def test_availability_with_hours(spark):
    t = dt.datetime(2026, 9, 1)
    df = spark.createDataFrame(
        [(t, t + dt.timedelta(hours=14)), (t, t + dt.timedelta(hours=13, minutes=59)), (t, t)],
        "obs timestamp, ref timestamp",
    ).withColumn("av", S.available_at("obs", F.make_dt_interval(hours=F.lit(14))))
    used = [r["u"] for r in df.select(S.usable_as_of("obs", "av", "ref").alias("u")).collect()]
    assert used == [True, False, False]
    early = spark.createDataFrame([(t, t - dt.timedelta(hours=1))], "obs timestamp, av timestamp")
    assert A.publication_violations(early, observed="obs", available="av").count() == 1
    assert early.select(S.usable_as_of("obs", "av", "obs").alias("u")).first()["u"] is None


def test_freshness(spark):
    df = spark.createDataFrame([("2026-09-10",), ("2026-08-30",), ("2026-08-29",), ("2026-09-14",), ("bad",)], "d string")
    got = [
        r["f"] for r in df.select(
            S.freshness(F.try_to_date("d", "yyyy-MM-dd"), F.to_date(F.lit("2026-09-13"))).alias("f")
        ).collect()
    ]
    assert got == ["CURRENT", "CURRENT", "STALE", "UNAVAILABLE", "UNAVAILABLE"]


def test_latest_common_date(spark):
    d = dt.date
    panel = spark.createDataFrame(
        [("a", d(2025, 6, i), 1.0) for i in range(1, 9)] + [("b", d(2025, 6, i), None if i == 8 else 1.0) for i in range(1, 9)],
        "District string, Date date, x double",
    )
    daily = spark.createDataFrame([(d(2025, 6, i),) for i in range(1, 6)], "Date date")

    def found(daily_days, rel):
        return A.latest_common_date(
            panel, required=["x"], n_keys=2, releases=rel, daily=daily_days, fallback="2024-12-31"
        ).first()["common_date"]

    assert found(daily, releases(spark)) == d(2025, 6, 5)
    late = spark.createDataFrame([(d(2025, 6, 20),)], "Date date")
    assert found(late, releases(spark)) == d(2024, 12, 31)
    future = releases(spark).withColumn("available_date", F.to_date(F.lit("2030-01-01")))
    assert found(daily, future) == d(2024, 12, 31)


def test_densify_fills_every_day_for_every_key(spark):
    d = dt.date
    sparse = spark.createDataFrame(
        [("a", d(2024, 1, 2), 5.0), ("a", d(2024, 1, 4), 6.0), ("b", d(2024, 1, 1), 7.0), ("a", d(2023, 12, 30), 9.0)],
        "k string, t date, v double",
    )
    keys = spark.createDataFrame([("a", "z1"), ("b", "z2"), ("c", "z3")], "k string, zone string")
    out = P.densify_daily(
        sparse, key="k", ts="t", measures={"v": F.lit(0.0)}, start="2024-01-01", end="2024-01-05", keys=keys
    ).orderBy("k", "t").collect()
    assert len(out) == 15
    assert [r["v"] for r in out] == [0, 5, 0, 6, 0, 7, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    assert {(r["k"], r["zone"]) for r in out} == {("a", "z1"), ("b", "z2"), ("c", "z3")}
    plain = P.densify_daily(sparse, key="k", ts="t", measures={"v": F.lit(0.0)}, start="2024-01-01", end="2024-01-05")
    assert plain.count() == 10


def test_lagged_circulation_keeps_leading_nulls(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i), 1.0, float(i), 1000.0 + i, 0.5) for i in range(12)]
    df = spark.createDataFrame(
        rows, "Date date, u850_raw double, v850_raw double, wind850_speed_raw double, mslp_raw double, regional_slp_gradient_raw double"
    )
    plain = A.lagged_circulation(df).orderBy("Date").collect()
    assert plain[0]["u850_regional"] is None and plain[1]["u850_regional"] == 0.0
    assert plain[7]["u850_lag7"] is None and plain[8]["u850_lag7"] == 0.0
    assert plain[8]["u850_rolling_7d"] == pytest.approx(4.0)
    filled = A.lagged_circulation(df, backfill=True).orderBy("Date").collect()
    assert filled[0]["u850_regional"] == 0.0 and filled[0]["u850_lag7"] == 0.0
