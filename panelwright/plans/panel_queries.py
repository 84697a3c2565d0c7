"""Queries over the daily panel: features, repairs, labels and audits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.config import CORE_TARGETS, HORIZON_MONTHS, HORIZONS
from panelwright.functions import scalars as S
from panelwright.operators import labels as L
from panelwright.operators import panel as P
from panelwright.operators import quality as Q
from panelwright.operators import windows as W
from panelwright.plans.catalog import query, tidy
from panelwright.plans.tables import (
    TEST_RULES,
    panel_sql,
    sparse_weather,
    table,
    weather_panel,
    weather_with_streak,
)


def big(col: str) -> Column:
    return F.col(col).cast("bigint")


@query("daily_panel", f"""
with {panel_sql()}
select district, cast(dt as varchar) as day, zone, nation, rain, rh, tx, tn, ph from pw
""")
def daily_panel(spark, sf_dir):
    return tidy(
        weather_panel(spark, sf_dir).select(
            F.col("District").alias("district"), F.col("Date").alias("day"),
            F.col("Zone").alias("zone"), F.col("Nation").alias("nation"),
            big("Rainfall_Observed_mm").alias("rain"),
            big("Relative_Humidity_pct").alias("rh"),
            big("Tmax_C").alias("tx"), big("Tmin_C").alias("tn"),
            F.col("MJO_Phase").alias("ph"),
        )
    )


@query("trailing_rain_features", f"""
with {panel_sql()}
select district, cast(dt as varchar) as day, streak,
  cast(sum(rain) over (w rows between 2 preceding and current row) as bigint) as sum3,
  cast(sum(rain) over (w rows between 6 preceding and current row) as bigint) as sum7,
  cast(sum(rain) over (w rows between 14 preceding and current row) as bigint) as sum15,
  cast(sum(rain) over (w rows between 29 preceding and current row) as bigint) as sum30,
  cast(round(avg(rain) over (w rows between 6 preceding and current row) * 1e4) as bigint) as mean7,
  row_number() over (w) - 1 as pos,
  lag(rain, 1) over (w) as lag1, lag(rain, 7) over (w) as lag7, lag(rain, 14) over (w) as lag14
from ps window w as (partition by district order by dt)
""")
def trailing_rain_features(spark, sf_dir):
    w = W.series("District", "Date")
    df = W.trailing_rain(weather_with_streak(spark, sf_dir))
    rain = "Rainfall_Observed_mm"
    return tidy(
        df.select(
            F.col("District").alias("district"), F.col("Date").alias("day"),
            F.col("Dry_Spell_Days_Streak").alias("streak"),
            *[big(f"rain_sum_{n}").alias(f"sum{n}") for n in (3, 7, 15, 30)],
            S.scaled(W.trailing_mean(rain, 7, w), 4).alias("mean7"),
            W.position(w).alias("pos"),
            *[F.lag(rain, n).over(w).cast("bigint").alias(f"lag{n}") for n in (1, 7, 14)],
        )
    )


@query("derived_weather_features", f"""
with {panel_sql()},
e as (select *, 0.61078e0 * exp(17.27e0 * ((tx + tn) / 2e0) / ((tx + tn) / 2e0 + 237.3e0)) as es from pw)
select district, cast(dt as varchar) as day,
  cast(round(greatest(0.5e0, tx - tn) * 10) as bigint) as dtr,
  cast(round(greatest(0e0, es - es * (rh / 100e0)) * 1e4) as bigint) as vpd,
  d as doy,
  cast(round(sin(2 * pi() * d / 365.25e0) * 1e5) as bigint) as doy_sin,
  cast(round(cos(2 * pi() * d / 365.25e0) * 1e5) as bigint) as doy_cos,
  cast(round(sin(2 * pi() * ph / 8e0) * 1e5) as bigint) as ph_sin,
  cast(round(cos(2 * pi() * ph / 8e0) * 1e5) as bigint) as ph_cos,
  cast(sum(rain) over (partition by district order by dt rows between 2 preceding and current row) as bigint) as sum3,
  cast(sum(rain) over (partition by district order by dt rows between 14 preceding and current row) as bigint) as sum15,
  0 as drought
from e
""")
def derived_weather_features(spark, sf_dir):
    df = P.derive_features(weather_panel(spark, sf_dir))
    return tidy(
        df.select(
            F.col("District").alias("district"), F.col("Date").alias("day"),
            S.scaled("dtr_c", 1).alias("dtr"), S.scaled("vpd_kpa", 4).alias("vpd"),
            F.col("day_of_year").alias("doy"),
            S.scaled("doy_sin", 5).alias("doy_sin"), S.scaled("doy_cos", 5).alias("doy_cos"),
            S.scaled("mjo_phase_sin", 5).alias("ph_sin"),
            S.scaled("mjo_phase_cos", 5).alias("ph_cos"),
            big("rolling_rain_3d_mm").alias("sum3"), big("rolling_rain_15d_mm").alias("sum15"),
            big("Drought_Stress_Index").alias("drought"),
        )
    )


REPAIR = f"""
with {panel_sql()},
s1 as (select *, (tx < 10 and rain > 50 and m between 5 and 9) as low from pw),
s2 as (select *, case when low then cast(round((tn + 1.2e0) * 100) as bigint) else tx * 100 end as x1 from s1),
s3 as (select *, x1 < tn * 100 as swap,
       case when x1 < tn * 100 then greatest(x1, tn * 100) + 50 else x1 end as x2,
       case when x1 < tn * 100 then least(x1, tn * 100) else tn * 100 end as n2 from s2)"""


@query("temperature_repair", REPAIR + """
select district, cast(dt as varchar) as day, x2 as tmax_c100, n2 as tmin_c100 from s3
""")
def temperature_repair(spark, sf_dir):
    repaired, _ = P.repair_temperatures(weather_panel(spark, sf_dir))
    return tidy(
        repaired.select(
            F.col("District").alias("district"), F.col("Date").alias("day"),
            S.scaled("Tmax_C", 2).alias("tmax_c100"), S.scaled("Tmin_C", 2).alias("tmin_c100"),
        )
    )


@query("temperature_corrections", REPAIR + """
select district, cast(dt as varchar) as day, 'low_tmax_heavy_rain' as issue,
  tx * 100 as old_max, tn * 100 as old_min, x1 as new_max, tn * 100 as new_min from s3 where low
union all
select district, cast(dt as varchar), 'tmax_below_tmin', x1, tn * 100, x2, n2 from s3 where swap
""")
def temperature_corrections(spark, sf_dir):
    _, log = P.repair_temperatures(weather_panel(spark, sf_dir))
    return tidy(
        log.select(
            F.col("District").alias("district"), F.col("Date").alias("day"), "issue",
            S.scaled("old_tmax", 2).alias("old_max"), S.scaled("old_tmin", 2).alias("old_min"),
            S.scaled("new_tmax", 2).alias("new_max"), S.scaled("new_tmin", 2).alias("new_min"),
        )
    )


# --- labels --------------------------------------------------------------------

LABEL_BASE = f"""
with {panel_sql()},
a as (select *, row_number() over w - 1 as i, count(*) over (partition by district) as n,
  lead(rain) over w as nx,
  case when count(*) over (w rows between current row and 2 following) = 3
       then sum(rain) over (w rows between current row and 2 following) end as s3,
  count(*) over (w rows between current row and 4 following) = 5
    and max(rain) over (w rows between current row and 4 following) < 2.5 as r5,
  count(*) over (w rows between current row and 6 following) = 7
    and max(rain) over (w rows between current row and 6 following) < 2.5 as r7
  from ps window w as (partition by district order by dt)),
b as (select *, (rain >= 64.5 or coalesce(s3 >= 150, false)) as hv,
  (rain >= 5 and coalesce(nx >= 2.5, false)) as rv,
  case when lower(zone) like '%asia%' then 40 else 25 end as thr from a)"""

V1_STATE = LABEL_BASE + """,
c as (select *, coalesce(m in (5, 6, 7) and d >= 135 and i + 3 < n and rain >= 2.5 and nx >= 2.5
        and s3 >= thr and rh >= 70, false) as surge,
  coalesce(max(r5) over (partition by district order by dt rows between 2 following and 5 following), false) as coll
  from b),
e as (select *, min(case when surge and not coll then i end) over (partition by district, yr) as strict_on,
  min(case when m = 6 then i end) over (partition by district, yr)
    + count(case when m = 6 then 1 end) over (partition by district, yr) // 2 as june from c),
f as (select *, coalesce(strict_on, june) as ons,
  surge and coll and (strict_on is null or i < strict_on) as fo from e)"""

V2_STATE = LABEL_BASE + """,
y as (select *, row_number() over w - 1 as iy, count(*) over (partition by district, yr) as ny,
  lead(rain) over w as ynx,
  case when count(*) over (w rows between current row and 2 following) = 3
       then sum(rain) over (w rows between current row and 2 following) end as ys3,
  count(*) over (w rows between current row and 4 following) = 5
    and max(rain) over (w rows between current row and 4 following) < 2.5 as yr5
  from b window w as (partition by district, yr order by dt)),
c as (select *, coalesce(m in (5, 6, 7) and d >= 135 and iy + 3 < ny and rain >= 2.5 and ynx >= 2.5
        and ys3 >= thr and rh >= 70, false) as surge,
  coalesce(max(yr5) over (partition by district, yr order by dt rows between 2 following and 5 following), false) as coll
  from y),
e as (select *, min(case when surge and not coll then iy end) over (partition by district, yr) as strict_on,
  min(case when m = 6 then iy end) over (partition by district, yr)
    + count(case when m = 6 then 1 end) over (partition by district, yr) // 2 as june from c),
f as (select *, coalesce(strict_on, june) as ons, surge and coll as fo from e)"""

V1_LABELS = V1_STATE + """,
lab as (select district, dt, m, streak, rain,
  cast(coalesce(ons - i between 0 and 14, false) as bigint) as onset,
  cast(coalesce(max(fo) over (w rows between current row and 2 following), false) as bigint) as false_onset,
  cast(m between 6 and 10 and i + 19 < n and coalesce(max(r5) over (w rows between 1 following and 14 following), false) as bigint) as dry_spell_5d,
  cast(m between 6 and 10 and i + 28 < n and coalesce(max(r7) over (w rows between 1 following and 21 following), false) as bigint) as severe_break_7d,
  cast(i + 7 < n and (coalesce(max(rain) over (w rows between 1 following and 7 following) >= 64.5, false)
    or coalesce(max(s3) over (w rows between 1 following and 5 following) >= 150, false)) as bigint) as heavy_rain,
  cast(streak >= 3 and i + 7 < n and coalesce(max(rv) over (w rows between 1 following and 7 following), false) as bigint) as revival
  from f window w as (partition by district order by dt))"""

V2_LABELS = V2_STATE + """,
lab as (select district, zone, dt, m, yr, rain, streak,
  case when m in (5, 6, 7) and i + 24 < n then cast(coalesce(ons - iy between 1 and 14, false) as bigint) end as onset,
  case when m in (5, 6, 7) and i + 24 < n then cast(coalesce(max(fo) over (wy rows between 1 following and 14 following), false) as bigint) end as false_onset,
  case when m between 6 and 10 and i + 19 < n then cast(coalesce(max(r5) over (w rows between 1 following and 14 following), false) as bigint) end as dry_spell_5d,
  case when m between 6 and 10 and i + 28 < n then cast(coalesce(max(r7) over (w rows between 1 following and 21 following), false) as bigint) end as severe_break_7d,
  case when i + 10 < n then cast(coalesce(max(hv) over (w rows between 1 following and 7 following), false) as bigint) end as heavy_rain,
  case when m between 6 and 10 and i + 8 < n then cast(streak >= 3 and coalesce(max(rv) over (w rows between 1 following and 7 following), false) as bigint) end as revival
  from f window w as (partition by district order by dt), wy as (partition by district, yr order by dt))"""

HEADS = ", ".join(CORE_TARGETS)


def label_columns():
    return [F.col(c).alias(h) for h, c in CORE_TARGETS.items()]


@query("label_events_v1", V1_LABELS + f"""
select district, cast(dt as varchar) as day, {HEADS} from lab
""")
def label_events_v1(spark, sf_dir):
    df = L.label_events_v1(weather_with_streak(spark, sf_dir), rules=TEST_RULES)
    return tidy(
        df.select(F.col("District").alias("district"), F.col("Date").alias("day"), *label_columns())
    )


@query("label_events_v2", V2_LABELS + f"""
select district, cast(dt as varchar) as day, {HEADS} from lab
""")
def label_events_v2(spark, sf_dir):
    df = L.label_events_v2(weather_with_streak(spark, sf_dir), rules=TEST_RULES)
    return tidy(
        df.select(F.col("District").alias("district"), F.col("Date").alias("day"), *label_columns())
    )


def horizon_sql() -> str:
    flags = {"dry_spell": "r5", "severe_break": "r7", "heavy_rain": "hv", "revival": "rv"}
    cols = []
    for window, (a, b) in HORIZONS.items():
        known = f"i + {b + 7} < n"
        cols.append(f"cast({known} as bigint) as known_{window}")
        for event, flag in flags.items():
            season = known if event == "heavy_rain" else f"{known} and m between 6 and 10"
            value = (
                f"coalesce(max({flag}) over (w rows between {a} following and {b} following), false)"
            )
            if event == "revival":
                value = f"(streak >= 3 and {value})"
            cols.append(f"case when {season} then cast({value} as bigint) end as {event}_{window}")
    return ",\n  ".join(cols)


@query("label_horizons", LABEL_BASE + f"""
select district, cast(dt as varchar) as day,
  {horizon_sql()}
from b window w as (partition by district order by dt)
""")
def label_horizons(spark, sf_dir):
    df = L.label_horizons(weather_with_streak(spark, sf_dir), rules=TEST_RULES)
    return tidy(
        df.select(
            F.col("District").alias("district"), F.col("Date").alias("day"),
            *[F.col(f"label_available_{w}").alias(f"known_{w}") for w in HORIZONS],
            *[
                F.col(f"target_{e}_{w}").alias(f"{e}_{w}")
                for e in HORIZON_MONTHS for w in HORIZONS
            ],
        )
    )


@query("horizon_applicability", LABEL_BASE + """
select yr as year, m as month, count(*) as days,
""" + ",\n".join(
    f"cast(count(*) filter (i + {b + 7} < n{'' if e == 'heavy_rain' else ' and m between 6 and 10'}) as bigint) as {e}_{w}"
    for w, (a, b) in HORIZONS.items() for e in HORIZON_MONTHS
) + """
from b group by 1, 2
""")
def horizon_applicability(spark, sf_dir):
    df = L.label_horizons(weather_with_streak(spark, sf_dir), rules=TEST_RULES)
    return tidy(
        df.groupBy(F.year("Date").alias("year"), F.month("Date").alias("month")).agg(
            F.count(F.lit(1)).alias("days"),
            *[
                F.count_if(F.col(f"target_applicable_{e}_{w}")).alias(f"{e}_{w}")
                for w in HORIZONS for e in HORIZON_MONTHS
            ],
        )
    )


ONSET_TAIL = """
select district, yr as year, cast(max(case when {pos} = ons then dt end) as varchar) as onset_date,
  cast(max(case when strict_on is null then 1 else 0 end) as bigint) as is_fallback,
  cast(count(*) filter (fo) as bigint) as false_onsets
from f group by 1, 2
"""


@query("onset_dates_v1", V1_STATE + ONSET_TAIL.format(pos="i"))
def onset_dates_v1(spark, sf_dir):
    df = L.onset_events(weather_with_streak(spark, sf_dir), rules=TEST_RULES)
    return tidy(df.withColumnRenamed("District", "district"))


@query("onset_dates_v2", V2_STATE + ONSET_TAIL.format(pos="iy"))
def onset_dates_v2(spark, sf_dir):
    df = L.onset_events(weather_with_streak(spark, sf_dir), rules=TEST_RULES, within_year=True)
    return tidy(df.withColumnRenamed("District", "district"))


@query("warmup_and_timeline_rows", f"""
with {panel_sql()}, a as (select *, row_number() over (partition by district order by dt) - 1 as i from pw)
select district, cast(dt as varchar) as day, rain from a where i >= 8 and (i - 8) % 7 = 0
""")
def warmup_and_timeline_rows(spark, sf_dir):
    df = W.every_kth_row(W.drop_first_rows(weather_panel(spark, sf_dir), 8), 7)
    return tidy(
        df.select(F.col("District").alias("district"), F.col("Date").alias("day"),
                  big("Rainfall_Observed_mm").alias("rain"))
    )


# --- unions, merges and single-row picks -----------------------------------------

@query("zone_panel_union", """
select district, cast(dt as varchar) as day, zone_id, cast(rain as bigint) as rain,
  cast(coalesce(drought, 0) as bigint) as drought, cast(coalesce(logging, 0) as bigint) as logging from (
 select l_suppkey as district, cast(l_shipdate as date) as dt, 'A' as zone_id, sum(l_quantity) as rain,
        null as drought, null as logging from lineitem where l_returnflag = 'A' group by 1, 2
 union all
 select l_suppkey, cast(l_shipdate as date), 'N', sum(l_quantity), min(l_linenumber), null
   from lineitem where l_returnflag = 'N' group by 1, 2
 union all
 select l_suppkey, cast(l_shipdate as date), 'R', sum(l_quantity), null, max(l_linenumber)
   from lineitem where l_returnflag = 'R' group by 1, 2)
""")
def zone_panel_union(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")

    def zone(flag, *extra):
        return (
            lines.where(F.col("l_returnflag") == flag)
            .groupBy(F.col("l_suppkey").alias("district"), F.col("l_shipdate").cast("date").alias("day"))
            .agg(F.sum("l_quantity").cast("bigint").alias("rain"), *extra)
            .withColumn("zone_id", F.lit(flag))
        )

    return tidy(
        P.stack_panels(
            [
                zone("A"),
                zone("N", F.min("l_linenumber").alias("drought")),
                zone("R", F.max("l_linenumber").alias("logging")),
            ],
            {"drought": 0, "logging": 0},
        )
    )


@query("observation_merge", """
with h as (select l_suppkey as district, cast(l_shipdate as date) as dt, cast(sum(l_quantity) as bigint) as rain
           from lineitem where l_linestatus = 'F' and l_shipdate >= date '1999-01-01' group by 1, 2),
c as (select l_suppkey as district, cast(l_shipdate as date) as dt, cast(sum(l_quantity) as bigint) as rain
      from lineitem where l_linestatus = 'O' group by 1, 2)
select district, cast(dt as varchar) as day, rain from c
union all
select district, cast(dt as varchar), rain from h
where not exists (select 1 from c where c.district = h.district and c.dt = h.dt)
""")
def observation_merge(spark, sf_dir):
    def observed(status):
        return (
            table(spark, sf_dir, "lineitem")
            .where(F.col("l_linestatus") == status)
            .groupBy(F.col("l_suppkey").alias("District"), F.col("l_shipdate").cast("date").alias("Date"))
            .agg(F.sum("l_quantity").cast("bigint").alias("rain"))
        )

    merged = P.merge_observations(
        observed("F"), observed("O"), since="1999-01-01", columns=["District", "Date", "rain"]
    )
    return tidy(merged.select(F.col("District").alias("district"), F.col("Date").alias("day"), "rain"))


@query("latest_order_per_customer", """
select o_custkey as custkey, o_orderkey as orderkey, cast(cast(o_orderdate as date) as varchar) as day from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders)
where r = 1
""")
def latest_order_per_customer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    latest = P.keep_last(orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return tidy(
        latest.select(
            F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"),
            F.col("o_orderdate").cast("date").alias("day"),
        )
    )


# --- audits ------------------------------------------------------------------------

@query("null_and_duplicate_audit", """
with k as (select l_suppkey, cast(l_shipdate as date) as dt, count(*) as c,
  count(*) filter (l_quantity is null) as nq, count(*) filter (l_tax is null) as nt from lineitem group by 1, 2)
select cast(sum(c) as bigint) as total_rows, cast(count(*) filter (c > 1) as bigint) as duplicate_keys,
  cast(sum(c - 1) as bigint) as extra_copies, cast(sum(nq) as bigint) as null_l_quantity,
  cast(sum(nt) as bigint) as null_l_tax from k
""")
def null_and_duplicate_audit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("District"), F.col("l_shipdate").cast("date").alias("Date"),
        "l_quantity", "l_tax",
    )
    return tidy(Q.null_and_duplicate_counts(lines, ["l_quantity", "l_tax"]))


@query("calendar_gap_audit", """
with k as (select distinct l_suppkey as district, cast(l_shipdate as date) as dt from lineitem),
g as (select *, lag(dt) over (partition by district order by dt) as p from k)
select district, cast(cast(p + interval 1 day as date) as varchar) as gap_from,
  cast(cast(dt - interval 1 day as date) as varchar) as gap_to,
  cast(date_diff('day', p, dt) - 1 as bigint) as missing_days
from g where date_diff('day', p, dt) > 1
""")
def calendar_gap_audit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("District"), F.col("l_shipdate").cast("date").alias("Date")
    )
    return tidy(Q.calendar_gaps(lines).withColumnRenamed("District", "district"))


@query("derived_feature_mismatches", f"""
with {panel_sql()},
dense as (select district, dt, sum(rain) over (w rows between 6 preceding and current row) as s7,
                 sum(rain) over (w rows between 29 preceding and current row) as s30
          from pw window w as (partition by district order by dt)),
sg as (select *, sum(case when rain >= 2.5 then 1 else 0 end) over (partition by district order by dt) as g from ag),
sp as (select district, dt, sum(rain) over (w rows between 6 preceding and current row) as s7,
              sum(rain) over (w rows between 29 preceding and current row) as s30,
              case when rain >= 2.5 then 0 else row_number() over (partition by district, g order by dt)
                - (case when g > 0 then 1 else 0 end) end as st
       from sg window w as (partition by district order by dt))
select cast(count(*) as bigint) as total_rows,
  cast(count(*) filter (abs(sp.s7 - dense.s7) > 0.01) as bigint) as sum7,
  cast(count(*) filter (abs(sp.s30 - dense.s30) > 0.01) as bigint) as sum30,
  cast(count(*) filter (sp.st <> ps.streak) as bigint) as streak
from sp join dense using (district, dt) join ps using (district, dt)
""")
def derived_feature_mismatches(spark, sf_dir):
    # row-based sums over the sparse rows against sums over the gap-free series
    streak = "Dry_Spell_Days_Streak"
    dense = W.trailing_rain(weather_with_streak(spark, sf_dir), (7, 30)).select(
        "District", "Date", F.col("rain_sum_7").alias("d7"), F.col("rain_sum_30").alias("d30"),
        F.col(streak).alias("dry"),
    )
    sparse = W.with_dry_streak(sparse_weather(spark, sf_dir), TEST_RULES.dry_below)
    both = W.trailing_rain(sparse, (7, 30)).join(dense, ["District", "Date"])
    pairs = {"sum7": ("rain_sum_7", "d7"), "sum30": ("rain_sum_30", "d30"), "streak": (streak, "dry")}
    return tidy(Q.mismatch_counts(both, pairs, 0.01))


@query("physical_range_violations", """
select l_orderkey, l_linenumber, 'l_quantity' as "column", cast(l_quantity as bigint) as value from lineitem where not l_quantity between 1 and 48
union all
select l_orderkey, l_linenumber, 'l_linenumber', l_linenumber from lineitem where not l_linenumber between 1 and 6
""")
def physical_range_violations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    out = Q.out_of_range(
        lines, {"l_quantity": (1, 48), "l_linenumber": (1, 6)}, ["l_orderkey", "l_linenumber"]
    )
    return tidy(out.withColumn("value", big("value")))


# Numeric columns of the labelled panel that are neither labels nor look ahead, in order.
PANEL_FEATURES = (
    "Rainfall_Observed_mm Relative_Humidity_pct Tmax_C Tmin_C MJO_Phase Dry_Spell_Days_Streak"
    " dtr_c vpd_kpa day_of_year doy_sin doy_cos mjo_phase_sin mjo_phase_cos rolling_rain_3d_mm"
    " rolling_rain_15d_mm Drought_Stress_Index Waterlogging_Risk_Index"
).split()


@query("feature_schema_rule", f"""
with {panel_sql()}
select position, feature, (select count(*) from pw) as rows
from (select unnest(range(0, {len(PANEL_FEATURES)})) as position, unnest({PANEL_FEATURES}) as feature)
""")
def feature_schema_rule(spark, sf_dir):
    """Known values of every column that the feature rule picks from the labelled panel."""
    labelled = L.label_events_v1(
        P.derive_features(weather_with_streak(spark, sf_dir)), rules=TEST_RULES
    ).withColumn("future_rain", F.lit(1.0))
    features = P.feature_columns(labelled.schema)
    frame = P.ordered_features(P.prediction_frame(labelled, features), ["District"], features)
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"))
            for i, f in enumerate(features)
        ]
    )
    return tidy(
        frame.select(F.explode(rows).alias("r"))
        .groupBy("r.position", "r.feature")
        .agg(F.count("r.v").alias("rows"))
    )


@query("missing_feature_list", """
select e.user_id, e.event_id,
  concat_ws(',', case when p.k is null or p.k < 10 then 'k' end, case when e.value is null or e.value > 30 then 'value' end) as missing
from events e join (select event_id, try_cast(json_extract_string(props, '$.k') as double) as k from events) p using (event_id)
""")
def missing_feature_list(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    obs = events.select(
        "user_id", "event_id",
        # small readings count as not reported and large ones as not finite
        F.when(k >= 10, k).alias("k"),
        F.when(F.col("value") > 30, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"),
    )
    return tidy(
        Q.missing_features(obs, ["k", "value"]).select(
            "user_id", "event_id", F.array_join("missing_features", ",").alias("missing")
        )
    )


@query("sowing_season_totals", f"""
with {panel_sql()}
select district, yr as year, cast(count(*) filter (strftime(dt, '%m%d') between '0520' and '0807') as bigint) as sowing_days,
  cast(max(dayofyear(make_date(yr, 12, 31))) as bigint) as year_days,
  cast(sum(rain) filter (strftime(dt, '%m%d') between '0520' and '0807') as bigint) as sowing_rain
from pw group by 1, 2
""")
def sowing_season_totals(spark, sf_dir):
    df = weather_panel(spark, sf_dir).withColumn("season", S.in_season("Date", (5, 20), (8, 7)))
    return tidy(
        df.groupBy(F.col("District").alias("district"), F.year("Date").alias("year")).agg(
            F.count_if("season").alias("sowing_days"),
            F.max(S.days_in_year(F.year("Date"))).alias("year_days"),
            F.sum(F.when(F.col("season"), F.col("Rainfall_Observed_mm"))).cast("bigint").alias("sowing_rain"),
        )
    )
