"""Queries for risk classes, advisories, head status, outlooks and area layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.config import CORE_MONTHS, HEAD_ROUTES, HORIZON_MONTHS, HORIZONS
from panelwright.functions import scalars as S
from panelwright.operators import advisory as V
from panelwright.operators import forecast as O
from panelwright.operators import quality as Q
from panelwright.plans.area_tables import FORECAST_SQL, month_forecasts
from panelwright.plans.catalog import query, tidy
from panelwright.plans.tables import panel_sql, table, weather_panel
from panelwright.sources.tables import feature_json, parse_nested

def keys():
    return [F.col("District").alias("district"), F.col("month_start").alias("month")]


KEYS_SQL = "district, cast(ms as varchar) as month"


def _class_sql(p: str, edges) -> str:
    a, b, c = edges
    return (
        f"case when {p} is null then 'UNAVAILABLE' when {p} >= {c} then 'VERY_HIGH'"
        f" when {p} >= {b} then 'HIGH' when {p} >= {a} then 'MODERATE' else 'LOW' end"
    )


RISK_SQL = FORECAST_SQL + f""",
rk as (select *, {_class_sql('p_heavy_rain', (0.25, 0.5, 0.75))} as heavy_rain_risk,
  {_class_sql('p_severe_break_7d', (0.25, 0.5, 0.75))} as severe_break_risk,
  {_class_sql('p_dry_spell_5d', (0.25, 0.5, 0.75))} as dry_spell_risk,
  {_class_sql('p_false_onset', (0.2, 0.4, 0.65))} as false_onset_risk from fc),
rl as (select *, ['UNAVAILABLE', 'LOW', 'MODERATE', 'HIGH', 'VERY_HIGH'][greatest(
  list_position(['UNAVAILABLE', 'LOW', 'MODERATE', 'HIGH', 'VERY_HIGH'], heavy_rain_risk),
  list_position(['UNAVAILABLE', 'LOW', 'MODERATE', 'HIGH', 'VERY_HIGH'], severe_break_risk),
  list_position(['UNAVAILABLE', 'LOW', 'MODERATE', 'HIGH', 'VERY_HIGH'], dry_spell_risk),
  list_position(['UNAVAILABLE', 'LOW', 'MODERATE', 'HIGH', 'VERY_HIGH'], false_onset_risk))] as risk_level from rk),
rc as (select *, case risk_level when 'LOW' then '#22c55e' when 'MODERATE' then '#eab308' when 'HIGH' then '#f97316'
  when 'VERY_HIGH' then '#ef4444' else '#94a3b8' end as risk_color from rl)"""

RISK_COLUMNS = [
    "heavy_rain_risk", "severe_break_risk", "dry_spell_risk", "false_onset_risk", "risk_level", "risk_color",
]


@query("risk_classes", f"""
with {RISK_SQL} select {KEYS_SQL}, {', '.join(RISK_COLUMNS)} from rc
""")
def risk_classes(spark, sf_dir):
    return tidy(O.risk_columns(month_forecasts(spark, sf_dir)).select(*keys(), *RISK_COLUMNS))


HEADLINE_SQL = f"""case
  when p_onset is null or p_false_onset is null or p_dry_spell_5d is null or p_severe_break_7d is null
    or p_heavy_rain is null or p_revival is null then '{O.HEADLINES['unavailable']}'
  when p_heavy_rain >= 0.6 then '{O.HEADLINES['heavy']}'
  when p_severe_break_7d >= 0.6 or p_dry_spell_5d >= 0.7 then '{O.HEADLINES['dry']}'
  when p_false_onset >= 0.4 and p_onset >= 0.5 then '{O.HEADLINES['false']}'
  when p_onset >= 0.6 then '{O.HEADLINES['onset']}'
  when p_revival >= 0.5 then '{O.HEADLINES['revival']}' else '{O.HEADLINES['normal']}' end"""


@query("headline_advisories", f"""
with {FORECAST_SQL}, h as (select *, {HEADLINE_SQL} as headline from fc)
select {KEYS_SQL}, headline, (case headline {' '.join(f"when '{O.HEADLINES[k]}' then '{O.ACTIONS[k]}'" for k in O.HEADLINES)} end) as action from h
""")
def headline_advisories(spark, sf_dir):
    return tidy(
        O.headline_advisory(month_forecasts(spark, sf_dir)).select(
            *keys(), F.col("advisory_headline").alias("headline"),
            F.col("recommended_action").alias("action"),
        )
    )


def advisory_inputs(spark, sf_dir):
    """Forecasts with a crop and the 7-14 day outlook, unknown out of season."""
    c = F.col
    season = S.in_months("reference_date", HORIZON_MONTHS["dry_spell"])
    return month_forecasts(spark, sf_dir).withColumns(
        {
            "crop": F.when(c("n") != 7, F.when(c("n") == 8, " Aman_Rice ").otherwise("aman_rice")),
            "outlook_dry_spell": F.when(season, c("p_dry_spell_5d") * 0.875),
            "outlook_severe_break": F.when(season & (c("n") != 9), c("p_severe_break_7d")),
        }
    )


@query("crop_advisories", f"""
with {FORECAST_SQL}, i as (select *, case when n <> 7 then 'aman_rice' end as crop,
  case when month(rd) between 6 and 10 then p_dry_spell_5d * 0.875 end as od,
  case when month(rd) between 6 and 10 and n <> 9 then p_severe_break_7d end as os from fc),
r as (select *, case when crop is null then 'AGRI-WAIT-CROP-CONTEXT-001'
  when strftime(rd, '%m%d') not between '0520' and '0807' then 'AGRI-WAIT-WINDOW-001'
  when od is null or os is null then 'AGRI-WAIT-APPLICABILITY-001'
  when p_heavy_rain is null or p_onset is null or p_false_onset is null or p_dry_spell_5d is null then 'AGRI-WAIT-APPLICABILITY-002'
  when p_heavy_rain >= 0.5 then 'AGRI-DRAINAGE-001'
  when p_false_onset >= 0.4 then 'AGRI-WAIT-FALSE-ONSET-001'
  when p_onset < 0.6 then 'AGRI-WAIT-ONSET-001'
  when p_dry_spell_5d >= 0.7 or os >= 0.7 then 'AGRI-WAIT-DRY-SPELL-001'
  when p_dry_spell_5d >= 0.5 or od >= 0.5 or os >= 0.5 then 'AGRI-IRRIGATION-001'
  else 'AGRI-SOW-001' end as rule_id from i)
select {KEYS_SQL}, rule_id, case rule_id when 'AGRI-SOW-001' then 'SOW' when 'AGRI-IRRIGATION-001' then 'PREPARE_IRRIGATION' else 'WAIT' end as action,
  case rule_id when 'AGRI-DRAINAGE-001' then 2 when 'AGRI-WAIT-DRY-SPELL-001' then 2 when 'AGRI-IRRIGATION-001' then 2 when 'AGRI-SOW-001' then 3 else 1 end as reasons,
  case when rule_id in ('AGRI-WAIT-DRY-SPELL-001', 'AGRI-IRRIGATION-001', 'AGRI-SOW-001') then 8 else 6 end as factors,
  cast(round(p_onset * 1e6) as bigint) as onset_factor from r
""")
def crop_advisories(spark, sf_dir):
    df = V.crop_advisory(advisory_inputs(spark, sf_dir))
    return tidy(
        df.select(
            *keys(), "advisory.rule_id", "advisory.action",
            F.size("advisory.reason_keys").alias("reasons"), F.size("risk_factors").alias("factors"),
            S.scaled(F.element_at("risk_factors", F.lit("onset_probability")), 6).alias("onset_factor"),
        )
    )


@query("advisory_input_errors", """
select event_id, case when event_type not in ('click', 'view') then 'unknown_crop' else 'probability_out_of_bounds' end as input_error
from events where event_type not in ('click', 'view') or value > 20
""")
def advisory_input_errors(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", "aman_rice").when(F.col("event_type") == "view", "")
        .otherwise(F.col("event_type")).alias("crop"),
        (F.col("value") / 20.0).alias("p"),
    )
    return tidy(V.advisory_input_errors(events, probabilities=["p"]).select("event_id", "input_error"))


@query("logit_downscaling", f"""
with {FORECAST_SQL}, s as (select s_suppkey, s_nationkey, s_acctbal / 10 as el, (s_suppkey % 41 - 20) / 10e0 as tw from supplier),
n as (select s_nationkey, cast(round(avg(el) * 100) as bigint) / 100e0 as ne from s group by 1),
j as (select fc.*, greatest(-1.5e0, least(1.5e0, 0.45e0 * ((el - ne) / greatest(10e0, ne)) + 0.50e0 * tw)) as s1,
  greatest(-1.5e0, least(1.5e0, 0.35e0 * ((el - ne) / greatest(10e0, ne)) - 0.40e0 * tw)) as s2
  from fc join s on s_suppkey = district join n using (s_nationkey)),
q as (select *, greatest(1e-4, least(1 - 1e-4, p_heavy_rain)) as a, greatest(1e-4, least(1 - 1e-4, p_dry_spell_5d)) as b, greatest(1e-4, least(1 - 1e-4, p_severe_break_7d)) as c from j)
select {KEYS_SQL}, case when p_heavy_rain is not null then cast(floor(1 / (1 + exp(-(ln(a / (1 - a)) + s1))) * 1e4 + 0.5) as bigint) end as heavy,
  cast(floor(1 / (1 + exp(-(ln(b / (1 - b)) + s2))) * 1e4 + 0.5) as bigint) as dry,
  cast(floor(c * 1e4 + 0.5) as bigint) as severe from q
""")
def logit_downscaling(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("District"), "s_nationkey",
        (F.col("s_acctbal") / 10).alias("elevation_mean_m"),
        ((F.col("s_suppkey") % 41 - 20) / 10.0).alias("delta_twi"),
    )
    mean = supplier.groupBy("s_nationkey").agg(
        (S.scaled(F.avg("elevation_mean_m"), 2) / 100.0).alias("district_mean_elevation_m")
    )
    df = month_forecasts(spark, sf_dir).join(supplier.join(mean, "s_nationkey"), "District")
    events = {"heavy_rain": "p_heavy_rain", "dry_spell_5d": "p_dry_spell_5d", "severe_break_7d": "p_severe_break_7d"}
    out = O.downscale(df, events)
    return tidy(
        out.select(
            *keys(), S.scaled("heavy_rain_downscaled", 4).alias("heavy"),
            S.scaled("dry_spell_5d_downscaled", 4).alias("dry"),
            S.scaled("severe_break_7d_downscaled", 4).alias("severe"),
        )
    )


def _missing_sql(schema: str) -> str:
    return {
        "baseline": "p_onset is null", "iod": "p_onset is null or p_heavy_rain is null",
        "atmospheric": "p_onset is null or p_heavy_rain is null or p_revival is null",
    }[schema]


def _heads_sql() -> str:
    parts = []
    for head, (version, schema, n) in HEAD_ROUTES.items():
        months = ", ".join(str(m) for m in CORE_MONTHS[head])
        status = (
            f"case when month(rd) not in ({months}) then 'OUT_OF_SEASON'"
            f" when {_missing_sql(schema)} then 'UNAVAILABLE' else 'APPLICABLE' end"
        )
        parts.append(
            f"select district, ms, '{head}' as head, '{version}' as model_version, {n} as fn,"
            f" {status} as applicability, p_{head} as p from fc"
        )
    return "\nunion all ".join(parts)


@query("head_results", f"""
with {FORECAST_SQL}, h as ({_heads_sql()})
select {KEYS_SQL}, head, model_version, case when applicability = 'APPLICABLE' then fn else 0 end as features_evaluated, applicability,
 case when applicability = 'APPLICABLE' then cast(round(p * 1e4) as bigint) end as p4,
 case when applicability = 'APPLICABLE' then cast(round(p * 1e4) as bigint) end as pct from h
""")
def head_results(spark, sf_dir):
    obs = month_forecasts(spark, sf_dir).withColumn("Date", F.col("reference_date"))
    obs = O.with_missing(
        obs,
        {
            "baseline": ("p_onset",), "iod": ("p_onset", "p_heavy_rain"),
            "atmospheric": ("p_onset", "p_heavy_rain", "p_revival"),
        },
    )
    rows = O.head_results(obs, ["District", "month_start"], {h: f"p_{h}" for h in HEAD_ROUTES})
    return tidy(
        rows.select(
            *keys(), "head", "model_version", "features_evaluated", "applicability",
            S.scaled("probability", 4).alias("p4"), S.scaled("probability_pct", 2).alias("pct"),
        )
    )


def outlook_rows(spark, sf_dir):
    """Long outlook: horizon and event per forecast; short groups miss one horizon.

    A forecast grows into twelve rows that later aggregates hold in memory. A fixed partition
    number keeps the adaptive planner from merging partitions by the size of the forecasts;
    it is by district (a row per month each), as Spark drops a second shuffle by both keys.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fc = month_forecasts(spark, sf_dir).repartition(partitions, "District")
    source = {"dry_spell": "p_dry_spell_5d", "severe_break": "p_severe_break_7d",
              "heavy_rain": "p_heavy_rain", "revival": "p_revival"}
    cells = []
    for i, horizon in enumerate(HORIZONS):
        for event, column in source.items():
            season = S.in_months("month_start", HORIZON_MONTHS[event])
            p = F.when(season & S.finite(column), F.round(F.col(column) / 2**i, 4))
            status = (
                F.when(~season, "OUT_OF_SEASON").when(S.finite(column), "APPLICABLE").otherwise("UNAVAILABLE")
            )
            cells.append(
                F.struct(
                    F.lit(horizon).alias("horizon"), F.lit(event).alias("event"),
                    p.alias("probability"), status.alias("applicability"),
                )
            )
    rows = fc.select("District", "month_start", "n", F.explode(F.array(*cells)).alias("c"))
    return rows.select("District", "month_start", "n", "c.*").where(
        ~((F.col("n") == 1) & (F.col("horizon") == "22_30d"))
    ).drop("n")


OUTLOOK_SQL = FORECAST_SQL + """,
ol as (select district, ms, n, horizon, event, case when season and p is not null then cast(round(p / dv * 1e4) as bigint) end as p4,
   case when not season then 'OUT_OF_SEASON' when p is null then 'UNAVAILABLE' else 'APPLICABLE' end as applicability from (
  select district, ms, n, h.horizon, h.dv, e.event, e.event = 'heavy_rain' or month(ms) between 6 and 10 as season,
    case e.event when 'dry_spell' then p_dry_spell_5d when 'severe_break' then p_severe_break_7d when 'heavy_rain' then p_heavy_rain else p_revival end as p
  from fc, (values ('7_14d', 1), ('15_21d', 2), ('22_30d', 4)) h(horizon, dv),
   (values ('dry_spell'), ('severe_break'), ('heavy_rain'), ('revival')) e(event))
  where not (n = 1 and horizon = '22_30d'))"""


@query("outlook_nesting", f"""
with {OUTLOOK_SQL}
select {KEYS_SQL}, count(distinct horizon) as horizons, cast(count(*) = 12 as bigint) as complete,
  max(case when horizon = '7_14d' and event = 'dry_spell' then p4 end) as near_dry,
  max(case when horizon = '22_30d' and event = 'heavy_rain' then p4 end) as far_heavy,
  max(case when horizon = '15_21d' and event = 'revival' then applicability end) as mid_revival
from ol group by district, ms
""")
def outlook_nesting(spark, sf_dir):
    nested = O.nest_outlook(outlook_rows(spark, sf_dir), ["District", "month_start"])

    def cell(horizon, event, field):
        events = F.try_element_at("outlook", F.lit(horizon))
        return F.try_element_at(events, F.lit(event))[field]

    return tidy(
        nested.select(
            *keys(), F.size("outlook").alias("horizons"), "complete",
            S.scaled(cell("7_14d", "dry_spell", "probability"), 4).alias("near_dry"),
            S.scaled(cell("22_30d", "heavy_rain", "probability"), 4).alias("far_heavy"),
            cell("15_21d", "revival", "applicability").alias("mid_revival"),
        )
    )


@query("horizon_trend", f"""
with {OUTLOOK_SQL}
select {KEYS_SQL}, horizon, max(case when event = 'dry_spell' then p4 end) as dry_spell,
 max(case when event = 'severe_break' then p4 end) as severe_break, max(case when event = 'heavy_rain' then p4 end) as heavy_rain,
 max(case when event = 'revival' then p4 end) as revival from ol group by district, ms, horizon
""")
def horizon_trend(spark, sf_dir):
    trend = O.horizon_trend(outlook_rows(spark, sf_dir), ["District", "month_start"])
    return tidy(trend.select(*keys(), "horizon", *[S.scaled(e, 2).alias(e) for e in HORIZON_MONTHS]))


# --- area layers ---------------------------------------------------------------------

def region_forecasts(spark, sf_dir):
    """Head probabilities per region from all its lines; the key is the region name."""
    c = F.col
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey")
    )
    supplier = table(spark, sf_dir, "supplier").join(nation, c("s_nationkey") == c("n_nationkey"))
    tests = {
        "p_onset": c("l_returnflag") != "R", "p_false_onset": c("l_quantity") >= 38,
        "p_dry_spell_5d": c("l_quantity") <= 25, "p_severe_break_7d": c("l_quantity") <= 15,
        "p_heavy_rain": c("l_linenumber") >= 6, "p_revival": c("l_linestatus") == "O",
    }
    per_supplier = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(p) for p, t in tests.items()]
    )
    joined = per_supplier.join(supplier, c("l_suppkey") == c("s_suppkey"))
    return joined.groupBy(c("r_name").alias("District")).agg(
        *[(F.sum(p) / F.sum("n")).alias(p) for p in tests]
    )


def crosswalk(spark, sf_dir):
    """Region to its code; one region is restricted to two of its nations."""
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("District"), F.col("r_regionkey").cast("string").alias("district_code"),
        F.when(F.col("r_name") == "ASIA", F.array(F.lit("2"), F.lit("12"))).alias("blocks"),
    )


def customer_layer(spark, sf_dir):
    """Customers as child units with the inherited region forecast and elevation."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("string").alias("region_code")
    )
    units = table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        "c_custkey", F.col("c_name").alias("unit_name"), "region_code",
        F.col("c_nationkey").cast("string").alias("block_code"), "c_acctbal",
    )
    units = O.valid_units(units, "block_code", "unit_name")
    layer = O.inherit_down(
        units, crosswalk(spark, sf_dir), region_forecasts(spark, sf_dir),
        child_district="region_code", child_block="block_code",
    )
    elevation = table(spark, sf_dir, "nation").where(F.col("n_nationkey") < 20).select(
        F.col("n_nationkey").cast("string").alias("code"), (F.col("n_nationkey") * 1.26).alias("elevation_m")
    )
    layer = O.attach_elevation(layer, elevation, "block_code")
    return O.headline_advisory(O.risk_columns(layer))


LAYER_SQL = """
rg as (select r_name, r_regionkey, count(*) filter (l_returnflag <> 'R') / count(*) as p_onset,
    count(*) filter (l_quantity >= 38) / count(*) as p_false_onset, count(*) filter (l_quantity <= 25) / count(*) as p_dry_spell_5d,
    count(*) filter (l_quantity <= 15) / count(*) as p_severe_break_7d, count(*) filter (l_linenumber >= 6) / count(*) as p_heavy_rain,
    count(*) filter (l_linestatus = 'O') / count(*) as p_revival
  from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by 1, 2),
ly as (select c_custkey, c_name, c_acctbal, c_nationkey, rg.* from customer join nation on n_nationkey = c_nationkey join rg on r_regionkey = n_regionkey
  where c_nationkey <> 0 and trim(c_name) <> '' and (r_name <> 'ASIA' or c_nationkey in (2, 12)))"""


def risk_level_sql() -> str:
    """Overall risk over the probability columns of a layer."""
    order = "['UNAVAILABLE', 'LOW', 'MODERATE', 'HIGH', 'VERY_HIGH']"
    edges = {"heavy_rain": (0.25, 0.5, 0.75), "severe_break_7d": (0.25, 0.5, 0.75),
             "dry_spell_5d": (0.25, 0.5, 0.75), "false_onset": (0.2, 0.4, 0.65)}
    ranks = [f"list_position({order}, {_class_sql(f'p_{h}', e)})" for h, e in edges.items()]
    return f"{order}[greatest({', '.join(ranks)})]"


@query("inherited_unit_forecasts", f"""
with {LAYER_SQL}
select c_custkey, r_name as district, cast(round(p_onset * 1e6) as bigint) as onset, cast(round(p_heavy_rain * 1e6) as bigint) as heavy,
  case when c_nationkey < 20 then cast(round(c_nationkey * 1.26e0 * 10) as bigint) end as elevation10,
  'NONE_DISTRICT_INHERITED' as method, {_class_sql('p_false_onset', (0.2, 0.4, 0.65))} as false_onset_risk, {HEADLINE_SQL} as headline from ly
""")
def inherited_unit_forecasts(spark, sf_dir):
    return tidy(
        customer_layer(spark, sf_dir).select(
            "c_custkey", F.col("District").alias("district"), S.scaled("p_onset", 6).alias("onset"),
            S.scaled("p_heavy_rain", 6).alias("heavy"), S.scaled("elevation_m", 1).alias("elevation10"),
            F.col("downscaling_method").alias("method"), "false_onset_risk",
            F.col("advisory_headline").alias("headline"),
        )
    )


@query("forecast_run_totals", f"""
with {LAYER_SQL}, u as (select c_nationkey, any_value(r_name) as d, count(*) as c from ly group by 1)
select count(distinct d) as districts, cast(sum(c) as bigint) as features, count(*) as unique_units, cast(sum(c) - count(*) as bigint) as excess_features,
  count(*) filter (c > 1) as units_with_several_features, cast((select count(*) from customer) - sum(c) as bigint) as unsupported_units from u
""")
def forecast_run_totals(spark, sf_dir):
    return tidy(
        O.run_totals(customer_layer(spark, sf_dir), "block_code", table(spark, sf_dir, "customer"))
    )


@query("district_diagnostic", f"""
with {LAYER_SQL} select r_name as district, count(distinct c_nationkey) as blocks, count(*) as units,
 cast(round(max(p_dry_spell_5d) * 1e6) as bigint) as dry, {_class_sql('max(p_heavy_rain)', (0.25, 0.5, 0.75))} as heavy_rain_risk, 1 as states from ly group by 1
""")
def district_diagnostic(spark, sf_dir):
    layer = customer_layer(spark, sf_dir)
    summary = layer.groupBy("District").agg(
        F.countDistinct("block_code").alias("blocks"), F.count(F.lit(1)).alias("units"),
        S.scaled(F.max("p_dry_spell_5d"), 6).alias("dry"), F.max("heavy_rain_risk").alias("heavy_rain_risk"),
    )
    states = O.distinct_states(layer, "District", [f"p_{h}" for h in O.HEADS])
    return tidy(summary.join(states, "District").withColumnRenamed("District", "district"))


@query("unit_response_views", f"""
with {LAYER_SQL}, b as (select c_nationkey, r_name, c_name, c_acctbal, row_number() over (partition by c_nationkey order by c_custkey) as r from ly)
select 'blk_' || c_nationkey as block_id, replace(r_name, ' ', '_') as district_key, r_name as district_name, c_name as first_unit from b where r = 1
""")
def unit_response_views(spark, sf_dir):
    layer = customer_layer(spark, sf_dir)
    first = layer.groupBy("block_code", "District").agg(F.min_by("unit_name", "c_custkey").alias("first_unit"))
    return tidy(
        first.select(
            S.canonical_block_id(S.unit_id("blk_", "block_code")).alias("block_id"),
            S.model_key("District").alias("district_key"), F.col("District").alias("district_name"), "first_unit",
        ).orderBy("district_name", "block_id")
    )


@query("feature_lines", """
select c_custkey, '{"type":"Feature","properties":{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}}' as line from customer
""")
def feature_lines(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return tidy(df.select("c_custkey", feature_json(["c_custkey", "c_mktsegment"]).alias("line")))


@query("nested_properties", """
select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, length(event_type) as n from events
""")
def nested_properties(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return tidy(
        df.select("event_id", parse_nested("props", "k bigint")["k"].alias("k"), F.length("event_type").alias("n"))
    )


@query("probability_bound_violations", """
select d.doc_id, cast(n_chars as bigint) as chars from documents d left join labels l using (doc_id)
where n_chars > 10000 or (coalesce(toxic, 0) = 1 and n_chars > 0)
""")
def probability_bound_violations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    p = F.col("n_chars") / 10000.0
    shift = F.when(F.coalesce("toxic", F.lit(0)) == 1, F.lit(0.25)).otherwise(F.lit(0.0))
    docs = docs.select("doc_id", "n_chars", p.alias("p"), F.round(p * 100.0 + shift, 2).alias("pct"))
    bad = Q.probability_violations(docs, ["doc_id", "n_chars"], "p", "pct")
    return tidy(bad.select("doc_id", F.col("n_chars").cast("bigint").alias("chars")))


@query("event_names_of_targets", """
select event_id, case when event_type in ('click', 'view') then event_type else '' end as head,
 case when event_type = 'click' then '7_14d' when event_type = 'view' then '22_30d' else '' end as horizon from events
""")
def event_names_of_targets(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", "target_click_7_14d").when(
        F.col("event_type") == "view", "target_view_22_30d"
    ).otherwise(F.concat(F.lit("target_"), F.col("event_type")))
    head, horizon = S.head_of_target(name)
    return tidy(table(spark, sf_dir, "events").select("event_id", head.alias("head"), horizon.alias("horizon")))


@query("observation_features", f"""
with {panel_sql()}, o as (select *, case when rain > 60 then null else rh end as h, case when ph = 8 then null else ph end as p,
  case when rain % 5 = 0 then null else (rain % 21 - 10) / 10e0 end as dmi, tx < tn as sw from pw),
e as (select *, case when sw then tn + 0.5e0 else tx end as hi, case when sw then tx else tn end as lo from o),
v as (select *, 0.61078e0 * exp(17.27e0 * ((hi + lo) / 2e0) / ((hi + lo) / 2e0 + 237.3e0)) as es from e)
select district, cast(dt as varchar) as day, cast(round(greatest(0.5e0, hi - lo) * 10) as bigint) as dtr,
  cast(round(greatest(0e0, es - es * (h / 100e0)) * 1e5) * case when h is null then null else 1 end as bigint) as vpd,
  cast(round(sin(2 * pi() * p / 8e0) * 1e5) as bigint) as ph_sin,
  cast(dmi > 0.4 as bigint) as pos, cast(dmi < -0.4 as bigint) as neg, cast(round(dmi * 10) as bigint) as lag14,
  concat_ws(',', case when h is null then 'vpd_kpa' end, case when p is null then 'mjo_phase_sin' end, case when dmi is null then 'iod_dmi' end) as missing from v
""")
def observation_features(spark, sf_dir):
    rain = F.col("Rainfall_Observed_mm")
    obs = weather_panel(spark, sf_dir).withColumns(
        {
            "Relative_Humidity_pct": F.when(rain <= 60, F.col("Relative_Humidity_pct")),
            "MJO_Phase": F.when(F.col("MJO_Phase") != 8, F.col("MJO_Phase")),
            "iod_dmi": F.when(rain % 5 != 0, (rain % 21 - 10) / 10.0),
        }
    )
    done = O.with_missing(
        O.complete_observation(obs), {"model": ("dtr_c", "vpd_kpa", "mjo_phase_sin", "iod_dmi", "doy_sin")}
    )
    return tidy(
        done.select(
            F.col("District").alias("district"), F.col("Date").alias("day"), S.scaled("dtr_c", 1).alias("dtr"),
            S.scaled("vpd_kpa", 5).alias("vpd"), S.scaled("mjo_phase_sin", 5).alias("ph_sin"),
            F.col("iod_positive_flag").alias("pos"), F.col("iod_negative_flag").alias("neg"),
            S.scaled("iod_dmi_lag14", 1).alias("lag14"), F.array_join("missing_model", ",").alias("missing"),
        )
    )
