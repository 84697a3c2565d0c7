"""Daily panel, release series, registries and score tables read from the test tables.

Each recipe turns whole input tables into the shape an operator expects; aggregation
comes first and is combined map-side, so a supplier or customer that owns a large share
of the rows shuffles at most one row per day.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.config import RULES
from panelwright.operators.panel import densify_daily
from panelwright.operators.windows import YEAR, with_dry_streak

# First and last day of the whole years in which lines were shipped.
ENDS_SQL = """(select make_date(year(min(l_shipdate)), 1, 1) as first_day,
      make_date(year(max(l_shipdate)), 12, 31) as last_day from lineitem) ends"""

# The wet zone of the test tables is one of the five regions.
TEST_RULES = replace(RULES, wet_zone_token="asia")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calendar_ends(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    """First and last day of the whole years that the lines cover, as scalar subqueries."""
    shipped = table(spark, sf_dir, "lineitem").select("l_shipdate")
    first = shipped.agg(F.trunc(F.min("l_shipdate"), "year")).scalar()
    last = shipped.agg(
        F.date_sub(F.add_months(F.trunc(F.max("l_shipdate"), "year"), 12), 1)
    ).scalar()
    return first, last


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier (district) with its nation (block level parent) and region (zone)."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey"
    )
    region = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), "r_name"
    )
    return (
        table(spark, sf_dir, "supplier")
        .select("s_suppkey", "s_nationkey")
        .join(nation.join(region, "n_regionkey"), "s_nationkey")
        .select(
            F.col("s_suppkey").alias("District"),
            F.col("n_name").alias("Nation"),
            F.col("r_name").alias("Zone"),
        )
    )


def sparse_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and ship day with rain, row count and the two temperatures."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_suppkey").alias("District"),
            F.col("l_shipdate").cast("date").alias("Date"),
            "l_quantity",
            "l_linenumber",
        )
        .groupBy("District", "Date")
        .agg(
            F.sum("l_quantity").alias("Rainfall_Observed_mm"),
            F.count(F.lit(1)).cast("int").alias("_rows"),
            F.min("l_quantity").alias("Tmax_C"),
            (F.min("l_linenumber") * 4).cast("double").alias("Tmin_C"),
        )
    )


def weather_panel(
    spark: SparkSession, sf_dir: str, days: tuple[str, str] | None = None
) -> DataFrame:
    """One row per supplier and day, empty days dry and mild.

    ``days`` (first, last) bounds the calendar, and with it the lines that are read.
    """
    first, last = map(F.lit, days) if days else calendar_ends(spark, sf_dir)
    first, last = first.cast("date"), last.cast("date")
    dense = densify_daily(
        sparse_weather(spark, sf_dir),
        key="District",
        ts="Date",
        start=first,
        end=last,
        measures={
            "Rainfall_Observed_mm": F.lit(0.0),
            "_rows": F.lit(0),
            "Tmax_C": F.lit(32.0),
            "Tmin_C": F.lit(24.0),
        },
        keys=zones(spark, sf_dir),
    )
    return dense.select(
        "District",
        "Nation",
        "Zone",
        "Date",
        F.year("Date").alias(YEAR),
        "Rainfall_Observed_mm",
        F.least(F.lit(100.0), 60.0 + 15.0 * F.col("_rows")).alias("Relative_Humidity_pct"),
        "Tmax_C",
        "Tmin_C",
        (F.dayofyear("Date") % 8 + 1).alias("MJO_Phase"),
    )


def weather_with_streak(
    spark: SparkSession, sf_dir: str, days: tuple[str, str] | None = None
) -> DataFrame:
    return with_dry_streak(weather_panel(spark, sf_dir, days), TEST_RULES.dry_below)


def between_days(sql: str, days: tuple[str, str]) -> str:
    """SQL over a panel whose calendar is bounded by ``days`` instead of the lines."""
    return sql.replace(
        ENDS_SQL, f"(select date '{days[0]}' as first_day, date '{days[1]}' as last_day) ends"
    )


def panel_sql() -> str:
    """The same panel as DuckDB CTEs ``zn``, ``pw`` (weather) and ``ps`` (with streak)."""
    return f"""
zn as (select s_suppkey as district, n_name as nation, r_name as zone
       from supplier join nation on s_nationkey = n_nationkey
       join region on n_regionkey = r_regionkey),
ag as (select l_suppkey as district, cast(l_shipdate as date) as dt,
              cast(sum(l_quantity) as bigint) as rain, count(*) as n,
              cast(min(l_quantity) as bigint) as tx, min(l_linenumber) * 4 as tn
       from lineitem group by 1, 2),
gr as (select district, nation, zone,
              cast(unnest(generate_series(first_day, last_day, interval 1 day)) as date) as dt
       from zn, {ENDS_SQL}),
pw as (select g.district, g.nation, g.zone, g.dt, coalesce(a.rain, 0) as rain,
              least(100, 60 + 15 * coalesce(a.n, 0)) as rh,
              coalesce(a.tx, 32) as tx, coalesce(a.tn, 24) as tn,
              year(g.dt) as yr, month(g.dt) as m, dayofyear(g.dt) as d,
              dayofyear(g.dt) % 8 + 1 as ph
       from gr g left join ag a on a.district = g.district and a.dt = g.dt),
pg as (select *, sum(case when rain >= 2.5 then 1 else 0 end)
                 over (partition by district order by dt) as g from pw),
ps as (select *, case when rain >= 2.5 then 0
                      else row_number() over (partition by district, g order by dt)
                           - (case when g > 0 then 1 else 0 end) end as streak
       from pg)"""
