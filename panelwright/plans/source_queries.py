"""Queries that write the outputs of the library and read them back with its own readers.

Each call writes to new folders beside the session's other staged tables.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators import quality as Q
from panelwright.operators.metrics import row_positions
from panelwright.operators.replay import replay_order
from panelwright.operators.staging import shared_folder, staged
from panelwright.plans.catalog import query, tidy
from panelwright.plans.panel_queries import big
from panelwright.plans.tables import sparse_weather, table, zones
from panelwright.sources import tables as T


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"


def _field(name):
    return F.col(name)


ZONE_IDS = {"AFRICA": "af", "AMERICA": "am", "ASIA": "as", "EUROPE": "eu", "MIDDLE EAST": "me"}


def _zone_rows(spark, sf_dir):
    """Rainy days with the zone of their district.

    Days stream past the few districts of their partition, so no task sorts or holds them.
    """
    districts = zones(spark, sf_dir).select("District", "Zone").hint("shuffle_hash")
    return sparse_weather(spark, sf_dir).drop("_rows").join(districts, "District")


def _zone_file(rows):
    """Rainy days in the columns of a zone file."""
    values = {
        "Date": _field("Date"), "Zone": _field("Zone"), "District": F.col("District").cast("string"),
        "Latitude": F.lit(22.5), "Longitude": F.lit(88.25),
        "Rainfall_Observed_mm": _field("Rainfall_Observed_mm"), "Tmax_C": _field("Tmax_C"),
        "Tmin_C": _field("Tmin_C"), "Relative_Humidity_pct": F.lit(75.0),
        "Solar_Radiation_MJm2": F.lit(18.5), "MJO_Phase": F.lit(3), "MJO_Amplitude": F.lit(None).cast("double"),
        "Nino34_Anomaly": F.lit(-0.25), "Dry_Spell_Days_Streak": F.lit(0),
        "Rolling_Rainfall_7d_mm": F.lit(1.5), "Rolling_Rainfall_30d_mm": F.lit(2.5),
        "Target_Crops": F.lit("rice; jute, tea"),
    }
    return rows.select(*[v.alias(n) for n, v in values.items()])


@query("zone_files_read_back", """
with ag as (select l_suppkey as district, cast(l_shipdate as date) as dt, sum(l_quantity) as rain, min(l_quantity) as tx from lineitem group by 1, 2),
z as (select s_suppkey, r_name from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey)
select case r_name when 'AFRICA' then 'af' when 'AMERICA' then 'am' when 'ASIA' then 'as' when 'EUROPE' then 'eu' else 'me' end as zone_id,
  cast(district as varchar) as district, cast(dt as varchar) as day, cast(rain as bigint) as rain, cast(tx as bigint) as tmax,
  'rice; jute, tea' as crops, 1 as amplitude_missing, case when r_name = 'ASIA' then cast(rain as bigint) * 2 end as index_value
from ag join z on s_suppkey = district
""")
def zone_files_read_back(spark, sf_dir):
    """Zone CSV files, one with a last column of its own, as one panel.

    The rainy days are aggregated once and staged; each zone is a filter of them, so that no
    writer sorts its rows by zone and a zone without rows has its file, too.
    """
    folder = new_folder(spark)
    rows = staged(_zone_rows(spark, sf_dir), "zone-rows")
    files = {ZONE_IDS[z]: f"{folder}/{ZONE_IDS[z]}" for z in ZONE_IDS}
    for zone, name in ZONE_IDS.items():
        days = _zone_file(rows.where(F.col("Zone") == zone))
        if zone == "ASIA":  # wet regions carry one more column
            days = days.withColumn("Drought_Stress_Index", F.col("Rainfall_Observed_mm") * 2)
        days.write.option("header", True).csv(files[name])
    panel = T.read_zone_files(spark, files, {"as": ("Drought_Stress_Index", "double")})
    return tidy(
        panel.select(
            "zone_id", F.col("District").alias("district"), F.col("Date").alias("day"),
            big("Rainfall_Observed_mm").alias("rain"), big("Tmax_C").alias("tmax"),
            F.col("Target_Crops").alias("crops"), F.col("MJO_Amplitude").isNull().alias("amplitude_missing"),
            big("Drought_Stress_Index").alias("index_value"),
        )
    )


@query("parquet_or_csv", """
select 'parquet' as source, c_custkey, c_name, cast(round(c_acctbal * 100) as bigint) as balance from customer
union all select 'csv', s_suppkey, s_name, cast(round(s_acctbal * 100) as bigint) from supplier
""")
def parquet_or_csv(spark, sf_dir):
    """Customers are there as Parquet, suppliers as CSV only; one reader takes what exists."""
    folder = new_folder(spark)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    customers.write.parquet(f"{folder}/customer")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option(
        "header", True
    ).csv(f"{folder}/supplier-csv")
    schema = "{0}_custkey long, {0}_name string, {0}_acctbal double"
    first = T.read_table(spark, f"{folder}/customer", f"{folder}/none", schema.format("c"))
    second = T.read_table(
        spark, f"{folder}/supplier", f"{folder}/supplier-csv", schema.format("c")
    )
    both = first.withColumn("source", F.lit("parquet")).unionByName(second.withColumn("source", F.lit("csv")))
    return tidy(both.select("source", "c_custkey", "c_name", S.scaled("c_acctbal", 2).alias("balance")))


REGISTRY = ["code", "name", "body", "size"]


@query("registry_read_back", """
select cast(p_partkey as varchar) as code, replace(p_name, 'a', 'a,') as name, case when p_size > 5 then p_brand end as body,
  case when p_size > 5 then cast(p_size as varchar) end as size from part
""")
def registry_read_back(spark, sf_dir):
    """A registry export: two title lines, the header, and rows with quoted and empty cells."""
    folder = new_folder(spark)
    heads = spark.createDataFrame(
        [("Register of units, second edition",), ("Title without any separator",), (",".join(REGISTRY),)],
        "value string",
    )
    quoted = F.concat(F.lit('"'), F.replace(F.col("p_name"), F.lit("a"), F.lit("a,")), F.lit('"'))
    size = F.when(F.col("p_size") > 5, F.col("p_size").cast("string")).otherwise("")
    body = F.when(F.col("p_size") > 5, F.col("p_brand")).otherwise("")
    rows = table(spark, sf_dir, "part").select(
        F.concat_ws(",", F.col("p_partkey").cast("string"), quoted, body, size).alias("value")
    )
    heads.unionByName(rows).write.text(folder)
    return tidy(T.read_registry(spark, folder, REGISTRY))


@query("written_panel", """
with ag as (select l_suppkey as district, cast(l_shipdate as date) as dt, sum(l_quantity) as rain from lineitem group by 1, 2)
select source, district, year(dt) as year, count(*) as days, cast(sum(rain) as bigint) as rain, 1 as refused
from ag, (select unnest(['csv', 'parquet']) as source) group by 1, 2, 3
""")
def written_panel(spark, sf_dir):
    """The master panel as Parquet by year and as CSV; a second run must not replace it."""
    folder = new_folder(spark)
    panel = sparse_weather(spark, sf_dir).select("District", "Date", "Rainfall_Observed_mm")
    T.write_panel(panel, f"{folder}/panel", csv=f"{folder}/panel-csv")
    try:
        T.write_panel(spark.read.parquet(f"{folder}/panel").drop("year"), f"{folder}/panel")
        refused = 0
    except AnalysisException:
        refused = 1
    schema = "District long, Date date, Rainfall_Observed_mm double"
    back = spark.read.parquet(f"{folder}/panel").select(
        F.lit("parquet").alias("source"), "District", "year", "Rainfall_Observed_mm"
    ).unionByName(
        T.read_table(spark, f"{folder}/absent", f"{folder}/panel-csv", schema).select(
            F.lit("csv").alias("source"), "District", F.year("Date").alias("year"), "Rainfall_Observed_mm"
        )
    )
    return tidy(
        back.groupBy("source", F.col("District").alias("district"), "year").agg(
            F.count(F.lit(1)).alias("days"), F.sum("Rainfall_Observed_mm").cast("bigint").alias("rain")
        ).withColumn("refused", F.lit(refused))
    )


@query("written_reports", """
select 'report' as kind, l_returnflag as name, count(*) as n, cast(sum(l_quantity) as bigint) as total from lineitem group by 2
union all select 'metrics', l_linestatus, count(*), cast(sum(l_quantity) as bigint) from lineitem group by 2
""")
def written_reports(spark, sf_dir):
    """An audit table as CSV and a metric table as JSON lines."""
    folder, lines = new_folder(spark), table(spark, sf_dir, "lineitem")

    def totals(column):
        return lines.groupBy(F.col(column).alias("name")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total")
        )

    T.write_report(totals("l_returnflag"), f"{folder}/report")
    T.write_metrics(totals("l_linestatus"), f"{folder}/metrics")
    schema = "name string, n long, total double"
    report = spark.read.csv(f"{folder}/report", header=True, schema=schema)
    metrics = spark.read.json(f"{folder}/metrics", schema=schema)
    both = report.withColumn("kind", F.lit("report")).unionByName(metrics.withColumn("kind", F.lit("metrics")))
    return tidy(both.select("kind", "name", "n", big("total").alias("total")))


@query("column_order", """
select unnest(['l_orderkey', 'l_suppkey', 'l_partkey', 'absent']) as "column", unnest([0, 1, 2, 3]) as expected,
  unnest([0, 2, 1, null]) as actual, (select count(*) from lineitem) as rows
""")
def column_order(spark, sf_dir):
    """Where the columns of the lines stand, against an order that is not theirs."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    checked = Q.column_order_check(lines, ["l_orderkey", "l_suppkey", "l_partkey", "absent"])
    return tidy(checked.withColumn("rows", lines.agg(F.count(F.lit(1))).scalar()))


@query("duplicate_copies", """
select c_custkey, c_nationkey, c_mktsegment, copies from (
  select *, count(*) over (partition by c_nationkey, c_mktsegment, c_custkey % 40) as copies from customer) where copies > 1
""")
def duplicate_copies(spark, sf_dir):
    """All rows, not only the keys, of customers that agree on three properties."""
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", (F.col("c_custkey") % 40).alias("code")
    )
    return tidy(Q.duplicate_copies(rows, ["c_nationkey", "c_mktsegment", "code"]).drop("code"))


@query("replay_output_order", """
select l_suppkey as district, cast(dt as varchar) as day, row_number() over (order by dt, l_suppkey) - 1 as position
from (select distinct l_suppkey, cast(l_shipdate as date) as dt from lineitem)
""")
def replay_output_order(spark, sf_dir):
    """Position of every record in the output: by date, then by key."""
    records = sparse_weather(spark, sf_dir).select("District", "Date")
    placed = row_positions(replay_order(records), "position")
    return tidy(
        placed.select(F.col("District").alias("district"), F.col("Date").alias("day"), "position")
    )
