"""Queries for point-in-time joins, text sources and grid fields."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators import asof as A
from panelwright.operators import panel as P
from panelwright.operators import quality as Q
from panelwright.operators import windows as W
from panelwright.plans.catalog import query, tidy
from panelwright.plans.panel_queries import big
from panelwright.plans.tables import (
    ENDS_SQL,
    calendar_ends,
    panel_sql,
    table,
    weather_panel,
    weather_with_streak,
    zones,
)
from panelwright.sources import text as X

WARM_DAYS = 30  # days before the calendar, so that its first days have lags


def order_days(spark, sf_dir):
    """Orders per day: weeks, months and the daily index all add these up."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def order_weeks(spark, sf_dir):
    """Weekly releases from orders: period, value in hundredths, availability."""
    return (
        order_days(spark, sf_dir)
        .groupBy(F.date_trunc("week", "day").cast("date").alias("period_start"))
        .agg(((F.sum("n") * 37 % 201 - 100) / 100.0).alias("iod_dmi"))
        .withColumn("period_end", F.date_add("period_start", 6))
        .transform(A.weekly_releases)
    )


WEEKS_SQL = """
wk as (select cast(date_trunc('week', o_orderdate) as date) as ps, count(*) * 37 % 201 - 100 as v from orders group by 1),
rel as (select ps, ps + 6 as pe, ps + 9 as av, v from wk)"""

MONTHS_SQL = """
mo as (select year(o_orderdate) as y, month(o_orderdate) as m, count(*) * 53 % 401 - 200 as v from orders group by 1, 2),
nin as (select y, m, cast(make_date(y, m, 1) + interval 1 month as date) as av, v from mo)"""


def index_days(spark, sf_dir, **kwargs):
    first, last = calendar_ends(spark, sf_dir)
    days = P.calendar(spark, F.date_sub(first, WARM_DAYS), last)
    daily = A.daily_release_values(
        days, order_weeks(spark, sf_dir),
        cols=["period_start", "period_end", "available_date", "iod_dmi"],
    )
    return A.index_features(daily, **kwargs)


INDEX_SQL = f"""
cal as (select cast(unnest(generate_series(first_day - {WARM_DAYS}, last_day, interval 1 day)) as date) as dt, first_day from {ENDS_SQL}),
aj as (select c.dt, r.ps, r.pe, r.av, r.v from cal c asof left join rel r on r.av <= c.dt),
idx as (select *, coalesce(cast(v / 100e0 > 0.4 as bigint), 0) as pos, coalesce(cast(v / 100e0 < -0.4 as bigint), 0) as neg,
  lag(v, 7) over (order by dt) as v7, lag(v, 14) over (order by dt) as v14 from aj)"""


@query("weekly_release_asof", f"""
with {WEEKS_SQL}, {INDEX_SQL}
select cast(dt as varchar) as day, cast(pe as varchar) as period_end, v, pos, neg, v7, v14 from idx
where dt >= (select min(first_day) from cal)
""")
def weekly_release_asof(spark, sf_dir):
    first, _ = calendar_ends(spark, sf_dir)
    df = index_days(spark, sf_dir).where(F.col("Date") >= first)
    return tidy(
        df.select(
            F.col("Date").alias("day"), "period_end", S.scaled("iod_dmi", 2).alias("v"),
            F.col("iod_positive_flag").alias("pos"), F.col("iod_negative_flag").alias("neg"),
            S.scaled("iod_dmi_lag7", 2).alias("v7"), S.scaled("iod_dmi_lag14", 2).alias("v14"),
        )
    )


@query("index_enriched_panel_check", f"""
with {panel_sql()}, {WEEKS_SQL}, {INDEX_SQL},
j as (select p.*, idx.* exclude (dt) from pw p left join idx on idx.dt = p.dt)
select (select count(*) from pw) as rows_before, count(*) as rows_after,
  count(*) filter (v is null) as null_iod_dmi, count(*) filter (v14 is null) as null_iod_dmi_lag14,
  cast(min(dt) as varchar) as first_date, cast(max(dt) as varchar) as last_date from j
""")
def index_enriched_panel_check(spark, sf_dir):
    panel = weather_panel(spark, sf_dir)
    joined = A.attach_daily(panel, index_days(spark, sf_dir))
    return tidy(Q.join_preservation(panel, joined, ["iod_dmi", "iod_dmi_lag14"], "Date"))


@query("release_leakage_check", f"""
with {WEEKS_SQL}, {INDEX_SQL},
bad as (select dt, case when pe - 3 > dt then 1 end as x from idx)
select 'clean' as source, cast(count(*) filter (av < pe + 3 or av > dt) as bigint) as violations from idx
union all
select 'early_use', cast(count(*) as bigint) from orders o join rel r on cast(date_trunc('week', o.o_orderdate) as date) = r.ps
where r.av > cast(o.o_orderdate as date)
""")
def release_leakage_check(spark, sf_dir):
    releases = order_weeks(spark, sf_dir)
    # using a week's own release on the order day is the mistake to be caught
    early = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("Date"),
        F.date_trunc("week", "o_orderdate").cast("date").alias("period_start"),
    ).join(releases, "period_start")
    counts = {
        "clean": A.release_violations(index_days(spark, sf_dir)),
        "early_use": A.release_violations(early),
    }
    return tidy(
        Q.check_summary(counts).select(F.col("check").alias("source"), "violations")
    )


@query("index_values_at_references", f"""
with {WEEKS_SQL}, {MONTHS_SQL},
ref as (select distinct cast(date_trunc('month', l_shipdate) as date) as ref from lineitem),
lg as (select ref, unnest([0, 7, 14]) as lag from ref),
w as (select l.ref, l.lag, r.v from (select *, ref - lag as at from lg) l asof left join rel r on r.av <= l.at),
n as (select ref.ref, n.v from ref asof left join nin n on n.av <= ref.ref),
m as (select ref.ref, e.dt from ref asof left join (select distinct cast(o_orderdate as date) as dt from orders) e on e.dt <= ref.ref)
select cast(w.ref as varchar) as ref, max(case when lag = 0 then w.v end) as v0,
  coalesce(max(case when lag = 7 then w.v end), max(case when lag = 0 then w.v end)) as v7,
  coalesce(max(case when lag = 14 then w.v end), max(case when lag = 0 then w.v end)) as v14,
  max(n.v) as monthly, cast(max(m.dt) as varchar) as daily_at
from w join n using (ref) join m using (ref) group by w.ref
""")
def index_values_at_references(spark, sf_dir):
    refs = (
        table(spark, sf_dir, "lineitem")
        .select(F.date_trunc("month", "l_shipdate").cast("date").alias("ref"))
        .distinct()
    )
    full = A.asof_many(
        refs, "ref",
        [
            weekly_source(spark, sf_dir),
            monthly_source(spark, sf_dir),
            A.AsOfSource(order_days(spark, sf_dir).select(F.col("day").alias("daily_at")), "daily_at", ("daily_at",)),
        ],
    )
    return tidy(
        full.select(
            "ref", S.scaled("iod_dmi", 2).alias("v0"),
            S.scaled(F.coalesce("iod_dmi_lag7", "iod_dmi"), 2).alias("v7"),
            S.scaled(F.coalesce("iod_dmi_lag14", "iod_dmi"), 2).alias("v14"),
            S.scaled("Nino34_Anomaly", 2).alias("monthly"), "daily_at",
        )
    )


def weekly_source(spark, sf_dir):
    return A.AsOfSource(order_weeks(spark, sf_dir), "available_date", ("iod_dmi",), (0, 7, 14))


def monthly_source(spark, sf_dir):
    return A.AsOfSource(order_months(spark, sf_dir), "available_date", ("Nino34_Anomaly",))


def order_months(spark, sf_dir):
    return (
        order_days(spark, sf_dir)
        .groupBy(F.year("day").alias("year"), F.month("day").alias("month"))
        .agg(((F.sum("n") * 53 % 401 - 200) / 100.0).alias("Nino34_Anomaly"))
        .withColumn("available_date", S.month_published("year", "month"))
    )


@query("asof_events_per_user", """
with l as (select * from events where event_type in ('click', 'view', 'signup')),
r as (select user_id, ts, event_id, event_type from events where event_type in ('purchase', 'error'))
select l.event_id, l.user_id, r.event_id as last_id, r.event_type as last_type
from l asof left join r on l.user_id = r.user_id and r.ts <= l.ts
""")
def asof_events_per_user(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.where(F.col("event_type").isin("click", "view", "signup")).select(
        "event_id", "user_id", "ts"
    )
    right = events.where(F.col("event_type").isin("purchase", "error")).select(
        "user_id", F.col("ts").alias("at"), F.col("event_id").alias("last_id"),
        F.col("event_type").alias("last_type"),
    )
    joined = A.asof_join(
        left, right, left_ts="ts", right_ts="at", by=["user_id"],
        cols=["last_id", "last_type"],
    )
    return tidy(joined.select("event_id", "user_id", "last_id", "last_type"))


@query("asof_events_per_kind", """
with l as (select event_id, event_type, ts from events where value is not null),
r as (select event_type, ts, max(event_id) as last_id from events where user_id % 3 = 0 group by 1, 2)
select l.event_id, l.event_type, r.last_id from l asof left join r on l.event_type = r.event_type and r.ts <= l.ts
""")
def asof_events_per_kind(spark, sf_dir):
    """A handful of keys own all rows: blocks of equal row counts."""
    events = table(spark, sf_dir, "events")
    left = events.where(F.col("value").isNotNull()).select("event_id", "event_type", "ts")
    right = events.where(F.col("user_id") % 3 == 0).select(
        "event_type", F.col("ts").alias("at"), F.col("event_id").alias("last_id")
    )
    cuts = A.row_cuts(left, right, left_ts="ts", right_ts="at", by=["event_type"])
    return tidy(
        A.asof_join(
            left, right, left_ts="ts", right_ts="at", by=["event_type"], cols=["last_id"], cuts=cuts
        ).select("event_id", "event_type", "last_id")
    )


@query("asof_customer_orders", """
with l as (select l_orderkey, l_linenumber, o_custkey, o_orderkey, l_shipdate from lineitem join orders on l_orderkey = o_orderkey),
r as (select o_custkey, o_orderdate, max(o_orderkey) as k from orders group by 1, 2)
select l_orderkey, l_linenumber, cast(r.k as bigint) as latest_order
from l asof left join r on l.o_custkey = r.o_custkey and r.o_orderdate <= l.l_shipdate
""")
def asof_customer_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    left = lines.join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey"
    )
    right = orders.withColumnRenamed("o_orderkey", "latest_order")
    joined = A.asof_join(
        left, right, left_ts="l_shipdate", right_ts="o_orderdate", by=["o_custkey"],
        cols=["latest_order"], block="month",
    )
    return tidy(joined.select("l_orderkey", "l_linenumber", "latest_order"))


@query("publication_order_check", """
with e as (select event_id, ts, ts + (cast(json_extract_string(props, '$.k') as bigint) - 10) * interval 1 hour as av from events)
select event_id, cast(case when av < ts then 1 else 0 end as bigint) as violation,
  cast(case when av >= ts then case when av <= timestamp '2024-01-20 00:00:00' then 1 else 0 end end as bigint) as usable from e
""")
def publication_order_check(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    df = events.withColumn("av", S.available_at("ts", F.make_dt_interval(hours=F.col("k") - 10)))
    bad = A.publication_violations(df, observed="ts", available="av").select(
        "event_id", F.lit(1).alias("violation")
    )
    reference = F.lit("2024-01-20 00:00:00").cast(df.schema["ts"].dataType)
    return tidy(
        df.withColumn("usable", S.usable_as_of("ts", "av", reference))
        .join(bad, "event_id", "left")
        .select("event_id", F.coalesce("violation", F.lit(0)).alias("violation"), "usable")
    )


@query("data_freshness", """
with u as (select c_custkey as custkey, max(cast(o_orderdate as date)) as last_day from customer left join orders on o_custkey = c_custkey group by 1)
select custkey, case when last_day is null or date '2001-07-20' < last_day then 'UNAVAILABLE'
  when date_diff('day', last_day, date '2001-07-20') <= 14 then 'CURRENT' else 'STALE' end as freshness from u
""")
def data_freshness(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.max(F.col("o_orderdate").cast("date")).alias("last_day")
    )
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    return tidy(
        keys.join(last, "custkey", "left").select(
            "custkey", S.freshness("last_day", F.to_date(F.lit("2001-07-20"))).alias("freshness")
        )
    )


@query("full_coverage_hours", """
select cast(date_trunc('hour', ts) as varchar) as hour, count(distinct event_type) as keys
from events where value is not null group by 1
having count(distinct event_type) = (select count(distinct event_type) from events)
""")
def full_coverage_hours(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("District"), F.date_trunc("hour", "ts").alias("Date"), "value"
    )
    hours = A.complete_dates(events, ["value"])
    return tidy(
        hours.select(F.date_format("Date", "yyyy-MM-dd HH:mm:ss").alias("hour"), "keys")
    )


@query("latest_common_date", f"""
with {WEEKS_SQL},
c as (select cast(o_orderdate as date) as dt from orders where o_totalprice is not null group by 1
      having count(distinct o_orderpriority) = (select count(distinct o_orderpriority) from orders)),
s as (select distinct cast(l_shipdate as date) as dt from lineitem)
select cast(coalesce(case when (select min(av) from rel) <= (select max(dt) from c)
  then (select max(c.dt) from c join s using (dt)) end, date '1994-12-31') as varchar) as common_date
""")
def latest_common_date(spark, sf_dir):
    panel = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("District"), F.col("o_orderdate").cast("date").alias("Date"),
        "o_totalprice",
    )
    daily = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("Date")
    )
    return tidy(
        A.latest_common_date(
            panel, required=["o_totalprice"], releases=order_weeks(spark, sf_dir),
            daily=daily, fallback="1994-12-31",
        )
    )


def zone_codes(spark, sf_dir):
    """Zones with their alphabetical codes, counted from the data; one row per zone."""
    names = zones(spark, sf_dir).select("Zone").distinct()
    return names.withColumn("zone_code", (F.row_number().over(Window.orderBy("Zone")) - 1).cast("int"))


def features_as_of(spark, sf_dir):
    """Point-in-time features of every district at the last day of every month."""
    panel = W.trailing_rain(weather_with_streak(spark, sf_dir))
    refs = order_days(spark, sf_dir).select(F.last_day("day").alias("Date")).distinct()
    national = A.asof_many(refs, "Date", [weekly_source(spark, sf_dir), monthly_source(spark, sf_dir)])
    index = national.withColumns(
        {
            "iod_positive_flag": S.above("iod_dmi", 0.4, null_is_zero=False),
            "iod_negative_flag": S.below("iod_dmi", -0.4, null_is_zero=False),
            "iod_dmi_lag7": F.coalesce("iod_dmi_lag7", "iod_dmi"),
            "iod_dmi_lag14": F.coalesce("iod_dmi_lag14", "iod_dmi"),
        }
    )
    return panel.join(index, "Date").join(zone_codes(spark, sf_dir), "Zone")


@query("features_as_of", f"""
with {panel_sql()}, {WEEKS_SQL}, {MONTHS_SQL}, {INDEX_SQL},
ref as (select distinct last_day(o_orderdate) as dt from orders),
nn as (select c.dt, n.v as nino from cal c asof left join nin n on n.av <= c.dt),
t as (select *, cast(sum(rain) over (w rows between 2 preceding and current row) as bigint) as sum3,
  cast(sum(rain) over (w rows between 6 preceding and current row) as bigint) as sum7,
  cast(sum(rain) over (w rows between 14 preceding and current row) as bigint) as sum15,
  cast(sum(rain) over (w rows between 29 preceding and current row) as bigint) as sum30
  from ps window w as (partition by district order by dt)),
z as (select zone, row_number() over (order by zone) - 1 as ze from (select distinct zone from zn))
select t.district, cast(t.dt as varchar) as day, t.rain, t.streak, sum3, sum7, sum15, sum30,
  greatest(1, 2 * (tx - tn)) as dtr2, i.v as iod,
  cast(i.v / 100e0 > 0.4 as bigint) as pos, cast(i.v / 100e0 < -0.4 as bigint) as neg,
  coalesce(i.v7, i.v) as iod7, coalesce(i.v14, i.v) as iod14, nn.nino, z.ze as zone_code
from t join ref on ref.dt = t.dt left join idx i on i.dt = t.dt left join nn on nn.dt = t.dt
join z on z.zone = t.zone
""")
def features_as_of_query(spark, sf_dir):
    df = features_as_of(spark, sf_dir)
    return tidy(
        df.select(
            F.col("District").alias("district"), F.col("Date").alias("day"),
            big("Rainfall_Observed_mm").alias("rain"),
            F.col("Dry_Spell_Days_Streak").alias("streak"),
            *[big(f"rain_sum_{n}").alias(f"sum{n}") for n in (3, 7, 15, 30)],
            (S.diurnal_range("Tmax_C", "Tmin_C") * 2).cast("bigint").alias("dtr2"),
            S.scaled("iod_dmi", 2).alias("iod"),
            F.col("iod_positive_flag").alias("pos"), F.col("iod_negative_flag").alias("neg"),
            S.scaled("iod_dmi_lag7", 2).alias("iod7"), S.scaled("iod_dmi_lag14", 2).alias("iod14"),
            S.scaled("Nino34_Anomaly", 2).alias("nino"),
            "zone_code",
        )
    )


# --- text sources -----------------------------------------------------------------

def _daily_counts(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("d"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("o_orderstatus") == "F").alias("f"),
        )
    )


def _with_noise(lines):
    """Index lines between a header, a short line and a line that does not parse."""
    noise = lines.sparkSession.createDataFrame(
        [("year month day rmm1 rmm2 phase amplitude",), ("1999 1",), ("1999 13 45 x y z w q r s",)],
        "value string",
    )
    return noise.unionByName(lines)


@query("daily_index_lines", """
select cast(cast(o_orderdate as date) as varchar) as day, count(*) * 2 as rmm1,
  -count(*) filter (o_orderstatus = 'F') as rmm2, count(*) % 8 + 1 as phase,
  count(*) * 5 as amplitude from orders group by cast(o_orderdate as date)
""")
def daily_index_lines(spark, sf_dir):
    c = _daily_counts(spark, sf_dir)
    lines = c.select(
        F.concat(
            F.lit("  "),
            F.concat_ws(
                "   ", F.date_format("d", "yyyy"), F.date_format("d", "M"), F.date_format("d", "d"),
                F.format_string("%.2f", F.col("n") * 0.02), F.format_string("%.2f", F.col("f") * -0.01),
                (F.col("n") % 8 + 1).cast("string"), F.format_string("%.2f", F.col("n") * 0.05),
                F.lit("final_value"),
            ),
        ).alias("value")
    )
    df = X.parse_daily_index(_with_noise(lines))
    return tidy(
        df.select(
            F.col("Date").alias("day"), S.scaled("RMM1", 2).alias("rmm1"),
            S.scaled("RMM2", 2).alias("rmm2"), F.col("MJO_Phase").alias("phase"),
            S.scaled("MJO_Amplitude", 2).alias("amplitude"),
        )
    )


@query("monthly_index_lines", f"""
with {MONTHS_SQL} select y as year, m as month, cast(av as varchar) as available, v as anomaly from nin
""")
def monthly_index_lines(spark, sf_dir):
    lines = order_months(spark, sf_dir).select(
        F.concat_ws(
            " ", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, " "),
            *[F.lit("26.50"), F.lit("0.10")] * 3, F.lit("27.00"),
            F.format_string("%.2f", "Nino34_Anomaly"),
        ).alias("value")
    )
    df = X.parse_monthly_index(_with_noise(lines))
    return tidy(
        df.select(
            "year", "month", F.col("available_date").alias("available"),
            S.scaled("Nino34_Anomaly", 2).alias("anomaly"),
        )
    )


@query("wide_year_lines", """
with y as (select distinct year(o_orderdate) as year from orders),
m as (select year, cast(unnest(range(1, 13)) as bigint) as month from y),
c as (select year(o_orderdate) as year, month(o_orderdate) as month, count(*) as n from orders group by 1, 2)
select m.year, m.month, c.n as value from m left join c on c.year = m.year and c.month = m.month
""")
def wide_year_lines(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    n = F.count(F.lit(1))
    wide = (
        orders.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("m"))
        .agg(n.alias("n"))
        .groupBy("year")
        .pivot("m", list(range(1, 13)))
        .agg(F.max("n"))
    )
    lines = wide.select(
        F.concat_ws(
            "  ", F.col("year").cast("string"),
            *[
                F.when(F.coalesce(F.col(str(i)), F.lit(0)) == 0, "-9999.000")
                .otherwise(F.format_string("%.3f", F.col(str(i)).cast("double")))
                for i in range(1, 13)
            ],
        ).alias("value")
    )
    return tidy(
        X.parse_wide_years(_with_noise(lines)).withColumn("value", big("value"))
    )


@query("release_lines", f"""
with {WEEKS_SQL}
select cast(ps as varchar) as period_start, cast(pe as varchar) as period_end, cast(av as varchar) as available, v from rel
""")
def release_lines(spark, sf_dir):
    lines = order_weeks(spark, sf_dir).select(
        F.concat_ws(
            ",", F.date_format("period_start", "yyyyMMdd"), F.date_format("period_end", "yyyyMMdd"),
            F.format_string("%.2f", "iod_dmi"),
        ).alias("value")
    )
    df = X.parse_releases(lines)
    return tidy(
        df.select("period_start", "period_end", F.col("available_date").alias("available"),
                  S.scaled("iod_dmi", 2).alias("v"))
    )


def grid_lines(spark, sf_dir, field: str):
    """Grid text of one field: three latitudes by three longitudes per ship day."""
    measure = {
        "u": F.col("l_quantity").cast("bigint"),
        "v": F.col("l_linenumber").cast("bigint") - 4,
        "slp": F.col("l_linenumber").cast("bigint") * 10,
    }[field]
    base = 100000 if field == "slp" else 0
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("d"),
        (F.col("l_linenumber") % 3).alias("lat"), (F.col("l_orderkey") % 3).alias("lon"),
        measure.alias("x"),
    )
    cells = lines.groupBy("d", "lat").agg(
        *[
            (F.coalesce(F.sum(F.when(F.col("lon") == i, F.col("x"))), F.lit(0)) + base).alias(f"x{i}")
            for i in range(3)
        ]
    )
    level = F.lit("") if field == "slp" else F.lit("[0]")
    text = F.concat(
        F.lit("["), F.dayofyear("d") - 1, F.lit("]"), level, F.lit("["), F.col("lat"), F.lit("], "),
        F.concat_ws(", ", "x0", "x1", "x2"),
    )
    return cells.select(F.year("d").alias("year"), text.alias("value"))


GRID_SQL = """
gl as (select cast(l_shipdate as date) as dt, l_linenumber % 3 as lat, l_orderkey % 3 as lon,
  sum(l_quantity) as u, sum(l_linenumber - 4) as v, sum(l_linenumber * 10) as p from lineitem group by 1, 2, 3),
gd as (select distinct dt, lat from gl),
gc as (select gd.dt, gd.lat, coalesce(u, 0) as u, coalesce(v, 0) as v, 100000 + coalesce(p, 0) as p
  from (select dt, lat, unnest([0, 1, 2]) as lon from gd) gd left join gl on gl.dt = gd.dt and gl.lat = gd.lat and gl.lon = gd.lon),
ga as (select dt, avg(u) as um, avg(v) as vm, avg(p / 100e0) as pm,
  avg(case when lat = 0 then p / 100e0 end) - avg(case when lat = 2 then p / 100e0 end) as gr from gc group by 1),
gm as (select dt, cast(round(um * 1e4) as bigint) as u, cast(round(vm * 1e4) as bigint) as v,
  cast(round(sqrt(um * um + vm * vm) * 1e4) as bigint) as s, cast(round(pm * 1e2) as bigint) as p,
  cast(round(gr * 1e2) as bigint) as g from ga)"""


def grid_days(spark, sf_dir):
    fields = [
        X.parse_grid(grid_lines(spark, sf_dir, f), F.col("year")) for f in ("u", "v", "slp")
    ]
    return X.grid_daily_means(*fields)


@query("grid_daily_means", f"""
with {GRID_SQL} select cast(dt as varchar) as day, u, v, s, p, g from gm
""")
def grid_daily_means(spark, sf_dir):
    return tidy(
        grid_days(spark, sf_dir).select(
            F.col("Date").alias("day"), S.scaled("u850_raw", 4).alias("u"),
            S.scaled("v850_raw", 4).alias("v"), S.scaled("wind850_speed_raw", 4).alias("s"),
            S.scaled("mslp_raw", 2).alias("p"), S.scaled("regional_slp_gradient_raw", 2).alias("g"),
        )
    )


def _circulation(spark, sf_dir, backfill):
    df = A.lagged_circulation(grid_days(spark, sf_dir), backfill=backfill)
    return tidy(
        df.select(
            F.col("Date").alias("day"), S.scaled("u850_regional", 4).alias("u"),
            S.scaled("mslp_regional", 2).alias("p"), S.scaled("regional_slp_gradient", 2).alias("g"),
            S.scaled("u850_lag7", 4).alias("u7"), S.scaled("mslp_lag7", 2).alias("p7"),
            S.scaled("u850_rolling_7d", 4).alias("ur"), S.scaled("mslp_rolling_7d", 2).alias("pr"),
        )
    )


@query("lagged_circulation", f"""
with {GRID_SQL}, l as (select dt, lag(u) over w as u, lag(p) over w as p, lag(g) over w as g,
  lag(u, 8) over w as u7, lag(p, 8) over w as p7 from gm window w as (order by dt))
select cast(dt as varchar) as day, u, p, g, u7, p7,
  cast(round(avg(u) over w) as bigint) as ur, cast(round(avg(p) over w) as bigint) as pr
from l window w as (order by dt rows between 6 preceding and current row)
""")
def lagged_circulation(spark, sf_dir):
    return _circulation(spark, sf_dir, False)


@query("lagged_circulation_backfilled", f"""
with {GRID_SQL}, l as (select dt, lag(u) over w as u, lag(p) over w as p, lag(g) over w as g from gm window w as (order by dt)),
b as (select dt, first_value(u ignore nulls) over f as u, first_value(p ignore nulls) over f as p,
  first_value(g ignore nulls) over f as g from l window f as (order by dt rows between current row and unbounded following)),
k as (select *, lag(u, 7) over (order by dt) as k7, lag(p, 7) over (order by dt) as q7 from b),
j as (select *, first_value(k7 ignore nulls) over f as u7, first_value(q7 ignore nulls) over f as p7 from k
  window f as (order by dt rows between current row and unbounded following))
select cast(dt as varchar) as day, u, p, g, u7, p7,
  cast(round(avg(u) over w) as bigint) as ur, cast(round(avg(p) over w) as bigint) as pr
from j window w as (order by dt rows between 6 preceding and current row)
""")
def lagged_circulation_backfilled(spark, sf_dir):
    return _circulation(spark, sf_dir, True)
