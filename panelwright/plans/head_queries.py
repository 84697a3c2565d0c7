"""Feature vectors of the released heads, their training run, and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.config import (
    CORE_MONTHS,
    CORE_TARGETS,
    FEATURE_SCHEMAS,
    GRID_FEATURES,
    HORIZON_MONTHS,
    HORIZONS,
    LOCAL_FEATURES,
    TELECONNECTION_FEATURES,
)
from panelwright.functions import scalars as S
from panelwright.operators import asof as A
from panelwright.operators import baselines as B
from panelwright.operators import forecast as O
from panelwright.operators import heads as H
from panelwright.operators import labels as L
from panelwright.operators import panel as P
from panelwright.operators import training as T
from panelwright.operators import windows as W
from panelwright.plans.asof_queries import (
    GRID_SQL,
    INDEX_SQL,
    MONTHS_SQL,
    WEEKS_SQL,
    grid_days,
    monthly_source,
    order_days,
    weekly_source,
    zone_codes,
)
from panelwright.plans.catalog import query, tidy
from panelwright.plans.panel_queries import V2_LABELS, horizon_sql
from panelwright.plans.released import RELEASED
from panelwright.plans.source_queries import new_folder
from panelwright.plans.tables import TEST_RULES, panel_sql, weather_with_streak

TRAIN_UNTIL = 1998


def national_values(spark, sf_dir, dates):
    """All national series as they were known on each date, in one pass over the dates."""
    daily = order_days(spark, sf_dir).select(
        "day", (F.col("n") % 8 + 1).alias("MJO_Phase"), (F.col("n") * 0.05).alias("MJO_Amplitude")
    )
    grid = A.lagged_circulation(grid_days(spark, sf_dir))
    found = A.asof_many(
        dates, "Date",
        [
            weekly_source(spark, sf_dir),
            monthly_source(spark, sf_dir),
            A.AsOfSource(daily, "day", ("MJO_Phase", "MJO_Amplitude")),
            A.AsOfSource(grid.withColumnRenamed("Date", "_day"), "_day", GRID_FEATURES),
        ],
    )
    return found.withColumns(
        {
            "iod_positive_flag": S.above("iod_dmi", 0.4, null_is_zero=False),
            "iod_negative_flag": S.below("iod_dmi", -0.4, null_is_zero=False),
            "iod_dmi_lag7": F.coalesce("iod_dmi_lag7", "iod_dmi"),
            "iod_dmi_lag14": F.coalesce("iod_dmi_lag14", "iod_dmi"),
            "mjo_phase_sin": F.round(S.cycle_sin("MJO_Phase", 8.0), 5),
            "mjo_phase_cos": F.round(S.cycle_cos("MJO_Phase", 8.0), 5),
        }
    )


def with_vectors(spark, sf_dir, panel, dates):
    """Panel rows of the given dates with the full feature vector of every schema.

    Zone codes and national values are broadcast: a row per zone and per date of the
    calendar, whatever the size of the panel, whose rows stay where their series is.
    """
    rows = P.derive_features(W.trailing_rain(panel)).drop(
        "MJO_Phase", "mjo_phase_sin", "mjo_phase_cos"
    )
    key = F.col("District")
    local = rows.withColumns(
        {
            "Latitude": F.lit(22.0) + key % 50 * 0.1,
            "Longitude": F.lit(86.0) + key % 30 * 0.1,
            "Solar_Radiation_MJm2": F.lit(25.0) - F.col("Relative_Humidity_pct") * 0.1,
            "Rolling_Rainfall_7d_mm": F.col("rain_sum_7"),
            "Rolling_Rainfall_30d_mm": F.col("rain_sum_30"),
            "District_Encoded": key - 1,
        }
    )
    codes = zone_codes(spark, sf_dir).withColumnRenamed("zone_code", "Zone_Encoded")
    coded = local.join(F.broadcast(codes), "Zone")
    return coded.join(F.broadcast(national_values(spark, sf_dir, dates)), "Date")


VECTOR_SQL = f"""
ph as (select cast(o_orderdate as date) as dt, count(*) % 8 + 1 as mjo, count(*) * 0.05e0 as amp from orders group by 1),
gl1 as (select dt, lag(u) over w as u, lag(v) over w as gv, lag(s) over w as ws, lag(p) over w as p, lag(g) over w as g,
  lag(u, 8) over w as u7, lag(p, 8) over w as p7 from gm window w as (order by dt)),
gl2 as (select *, cast(round(avg(u) over w) as bigint) as ur, cast(round(avg(p) over w) as bigint) as pr
  from gl1 window w as (order by dt rows between 6 preceding and current row)),
nn as (select d.dt, n.v as nino from dates d asof left join nin n on n.av <= d.dt),
pp as (select d.dt, p.mjo, p.amp from dates d asof left join ph p on p.dt <= d.dt),
gg as (select d.dt, g.* exclude (dt) from dates d asof left join gl2 g on g.dt <= d.dt),
ii as (select d.dt, r.v, r7.v as v7, r14.v as v14 from dates d asof left join rel r on r.av <= d.dt
  asof left join rel r7 on r7.av + 7 <= d.dt asof left join rel r14 on r14.av + 14 <= d.dt),
tr as (select *, cast(sum(rain) over (w rows between 2 preceding and current row) as bigint) as sum3,
  cast(sum(rain) over (w rows between 6 preceding and current row) as bigint) as sum7,
  cast(sum(rain) over (w rows between 14 preceding and current row) as bigint) as sum15,
  cast(sum(rain) over (w rows between 29 preceding and current row) as bigint) as sum30,
  0.61078e0 * exp(17.27e0 * ((tx + tn) / 2e0) / ((tx + tn) / 2e0 + 237.3e0)) as es
  from ps window w as (partition by district order by dt)),
zc as (select zone, row_number() over (order by zone) - 1 as ze from (select distinct zone from zn)),
fv as (select t.district, t.dt, t.m, t.zone,
  22 + t.district % 50 * 0.1e0 as "Latitude", 86 + t.district % 30 * 0.1e0 as "Longitude",
  t.rain as "Rainfall_Observed_mm", t.tx as "Tmax_C", t.tn as "Tmin_C", t.rh as "Relative_Humidity_pct",
  25 - t.rh * 0.1e0 as "Solar_Radiation_MJm2", pp.mjo as "MJO_Phase", pp.amp as "MJO_Amplitude",
  nn.nino / 100e0 as "Nino34_Anomaly", t.streak as "Dry_Spell_Days_Streak", sum7 as "Rolling_Rainfall_7d_mm",
  sum30 as "Rolling_Rainfall_30d_mm", 0e0 as "Drought_Stress_Index", 0e0 as "Waterlogging_Risk_Index",
  greatest(0.5e0, tx - tn) as dtr_c, round(greatest(0e0, es - es * (rh / 100e0)), 4) as vpd_kpa, t.d as day_of_year,
  round(sin(2 * pi() * t.d / 365.25e0), 5) as doy_sin, round(cos(2 * pi() * t.d / 365.25e0), 5) as doy_cos,
  round(sin(2 * pi() * pp.mjo / 8e0), 5) as mjo_phase_sin, round(cos(2 * pi() * pp.mjo / 8e0), 5) as mjo_phase_cos,
  sum3 as rolling_rain_3d_mm, sum15 as rolling_rain_15d_mm, t.district - 1 as "District_Encoded", zc.ze as "Zone_Encoded",
  ii.v / 100e0 as iod_dmi, cast(ii.v / 100e0 > 0.4 as bigint) as iod_positive_flag,
  cast(ii.v / 100e0 < -0.4 as bigint) as iod_negative_flag, coalesce(ii.v7, ii.v) / 100e0 as iod_dmi_lag7,
  coalesce(ii.v14, ii.v) / 100e0 as iod_dmi_lag14, gg.u / 1e4 as u850_regional, gg.gv / 1e4 as v850_regional,
  gg.ws / 1e4 as wind850_speed, gg.p / 1e2 as mslp_regional, gg.g / 1e2 as regional_slp_gradient, gg.u7 / 1e4 as u850_lag7,
  gg.p7 / 1e2 as mslp_lag7, gg.ur / 1e4 as u850_rolling_7d, gg.pr / 1e2 as mslp_rolling_7d
  from tr t join dates on dates.dt = t.dt join zc on zc.zone = t.zone join nn on nn.dt = t.dt join pp on pp.dt = t.dt
  join gg on gg.dt = t.dt join ii on ii.dt = t.dt)"""


def vectors_sql(dates: str, panel: str) -> str:
    """CTE ``fv`` over the panel CTEs and a query for the wanted ``dates``."""
    return f"{panel}, {WEEKS_SQL}, {MONTHS_SQL}, {GRID_SQL}, dates as ({dates}), {VECTOR_SQL}"


MONTH_ENDS_SQL = "select distinct last_day(o_orderdate) as dt from orders"


def month_ends(spark, sf_dir):
    return order_days(spark, sf_dir).select(F.last_day("day").alias("Date")).distinct()


def month_end_vectors(spark, sf_dir):
    return with_vectors(spark, sf_dir, weather_with_streak(spark, sf_dir), month_ends(spark, sf_dir))


def missing_count_sql(schema: str) -> str:
    names = [f'"{f}"' if f[0].isupper() else f for f in FEATURE_SCHEMAS[schema]]
    return " + ".join(f"({n} is null)::bigint" for n in names)


ALL_FEATURES = FEATURE_SCHEMAS["atmospheric"]


@query("as_of_feature_vectors", f"""
with {vectors_sql(MONTH_ENDS_SQL, panel_sql())}
select district, cast(dt as varchar) as day,
  {', '.join(f'cast(round("{f}" * 1e4) as bigint) as {f.lower()}' for f in ALL_FEATURES)},
  {', '.join(f'{missing_count_sql(s)} as missing_{s}' for s in FEATURE_SCHEMAS)} from fv
""")
def as_of_feature_vectors(spark, sf_dir):
    """All features of every district at every month end, and what each schema lacks."""
    rows = O.with_missing(month_end_vectors(spark, sf_dir), FEATURE_SCHEMAS)
    return tidy(
        rows.select(
            F.col("District").alias("district"), F.col("Date").alias("day"),
            *[S.scaled(F.col(f).cast("double"), 4).alias(f.lower()) for f in ALL_FEATURES],
            *[F.size(f"missing_{s}").alias(f"missing_{s}") for s in FEATURE_SCHEMAS],
        )
    )


# --- labels, baseline rates and training rows of all heads ----------------------------

def labelled_rows(spark, sf_dir):
    """Strictly future core and outlook labels of the whole panel, one row per day."""
    panel = weather_with_streak(spark, sf_dir)
    return L.label_events_and_horizons(panel, rules=TEST_RULES)


BASELINE_HEADS = tuple(h for h in RELEASED if h.status == H.BASELINE)
HORIZON_LABELS = {f"{e}_{w}": f"target_{e}_{w}" for e in HORIZON_MONTHS for w in HORIZONS}


def label_of(head: str) -> str:
    """Label column of a core head or of an outlook head of the nearest window."""
    return CORE_TARGETS.get(head) or f"target_{head.removeprefix('outlook_')}_7_14d"


def baseline_rates(spark, sf_dir):
    """Per district and month: training rate of every head that prefers its baseline.

    The label panel is reduced to one row per district and month; the overall rate stands
    beside each, for months that a district has not seen.
    """
    split = B.with_purged_split(labelled_rows(spark, sf_dir), "Date", train_until=TRAIN_UNTIL)
    counts = B.label_counts(
        split.where("split = 'train'").withColumn("month", F.month("Date")),
        ["District", "month"], {h.name: label_of(h.name) for h in BASELINE_HEADS},
    )
    wide = counts.groupBy("District", "month").agg(
        *[
            F.sum(F.when(F.col("event") == h.name, F.col(c))).alias(f"{c}_{h.name}")
            for h in BASELINE_HEADS for c in ("n", "events")
        ]
    )
    return wide.select(
        "District", "month",
        *[
            F.try_divide(F.col(f"events_{h.name}").cast("double"), F.col(f"n_{h.name}")).alias(f"rate_{h.name}")
            for h in BASELINE_HEADS
        ],
    )


def with_rates(rows, rates):
    """Panel rows with the rates of their district and month.

    The rates stand in one row per district, a map of at most twelve months, so they meet
    the panel by district alone, as it is partitioned, and its rows are not shuffled.
    """
    names = [f"rate_{h.name}" for h in BASELINE_HEADS]
    per_district = rates.groupBy("District").agg(
        F.map_from_entries(F.collect_list(F.struct("month", F.struct(*names)))).alias("_rates")
    )
    found = F.try_element_at("_rates", F.col("month"))
    return rows.join(per_district, "District", "left").withColumns(
        {name: found[name] for name in names}
    ).drop("_rates")


def _sql_name(head: str) -> str:
    """The SQL column of a head's label in ``lv``."""
    return head if head in CORE_TARGETS else f"{head.removeprefix('outlook_')}_7_14d"


LABEL_VIEW_SQL = V2_LABELS + f""",
hz as (select district, dt, {horizon_sql()} from b window w as (partition by district order by dt)),
lv as (select lab.*, hz.* exclude (district, dt), case
   when lab.dt <= date '{TRAIN_UNTIL}-12-31' - 37 then 'train'
   when lab.dt between date '1999-01-01' and date '1999-06-30' then 'calibration'
   when lab.dt >= date '1999-07-01' and lab.dt <= date '1999-12-31' - 37 then 'selection'
   when lab.dt >= date '2000-01-01' and lab.dt <= date '2000-12-31' - 37 then 'test' end as split
  from lab join hz on hz.district = lab.district and hz.dt = lab.dt)"""
RATES_SQL = f"""(with {LABEL_VIEW_SQL.strip().removeprefix('with ')}
  select district, m, {', '.join(f"avg({_sql_name(h.name)}) as rate_{h.name}" for h in BASELINE_HEADS)}
  from lv where split = 'train' group by 1, 2)"""


def raw_sql(head: H.Head) -> str:
    """Calibrated probability of a logistic head over the columns of ``fv``."""
    total = " + ".join([f"({head.intercept!r}e0)"] + [f'{w!r}e0 * "{f}"' for f, w in head.weights.items()])
    total = total.replace("e-05e0", "e-05").replace("e-06e0", "e-06")
    raw = f"1e0 / (1e0 + exp(-({total})))"
    if (head.slope, head.shift) == (1.0, 0.0):
        return raw
    p = f"greatest(1e-6, least(1e0 - 1e-6, {raw}))"
    return f"1e0 / (1e0 + exp(-(ln({p} / (1e0 - {p})) * {head.slope!r}e0 + ({head.shift!r}e0))))"


def _result_sql() -> str:
    parts = []
    for head in RELEASED:
        months = ", ".join(map(str, head.months))
        rate = f"rate_{head.name}" if head.status == H.BASELINE else "null::double"
        status = (
            f"case when fv.m not in ({months}) then 'OUT_OF_SEASON' when {rate} is not null then 'BASELINE_PREFERRED'"
            f" when {missing_count_sql(head.schema)} > 0 or {str(head.status == H.BASELINE).lower()} then 'UNAVAILABLE' else 'APPLICABLE' end"
        )
        parts.append(
            f"select fv.district, fv.dt, '{head.name}' as head, '{head.schema}' as schema, {len(head.features)} as fn,"
            f" {status} as applicability, {rate} as rate, {raw_sql(head)} as p from fv left join rt on rt.district = fv.district and rt.m = fv.m"
        )
    return "\nunion all ".join(parts)


@query("released_head_results", f"""
with {vectors_sql(MONTH_ENDS_SQL, panel_sql())}, rt as {RATES_SQL}, hr as ({_result_sql()})
select district, cast(dt as varchar) as day, head, schema, case when applicability = 'APPLICABLE' then fn else 0 end as features_evaluated,
  applicability, cast(round(round(case applicability when 'BASELINE_PREFERRED' then rate when 'APPLICABLE' then p end, 4) * 1e4) as bigint) as p4 from hr
""")
def released_head_results(spark, sf_dir):
    """Every released head at every month end: written to a store, read back and scored."""
    folder = new_folder(spark)
    H.write_heads(spark, folder, list(RELEASED))
    heads, _ = H.read_heads(spark, folder)
    rows = with_rates(
        month_end_vectors(spark, sf_dir).withColumn("month", F.month("Date")),
        baseline_rates(spark, sf_dir),
    )
    long = H.stacked_results(
        H.score_heads(rows, heads), ["District", "Date"], heads,
        rates={h.name: f"rate_{h.name}" for h in BASELINE_HEADS},
    )
    return tidy(
        long.select(
            F.col("District").alias("district"), F.col("Date").alias("day"), "head", "schema",
            "features_evaluated", "applicability", S.scaled("probability", 4).alias("p4"),
        )
    )


HEAD_SPECS = [
    T.HeadSpec(
        name, label, CORE_MONTHS[name],
        {
            "logistic_local": ("logistic", LOCAL_FEATURES),
            "boosted_local": ("boosted", LOCAL_FEATURES),
            "boosted_teleconnection": ("boosted", TELECONNECTION_FEATURES),
            "boosted_atmospheric": ("boosted", TELECONNECTION_FEATURES + GRID_FEATURES),
            "boosted_full": ("boosted", FEATURE_SCHEMAS["atmospheric"]),
            "boosted_full_no_district": ("boosted", FEATURE_SCHEMAS["horizon"]),
        },
    )
    for name, label in CORE_TARGETS.items()
] + [
    T.HeadSpec(
        name, label, HORIZON_MONTHS[name.rsplit("_", 2)[0]],
        {
            "logistic_local": ("logistic", LOCAL_FEATURES),
            "boosted_atmospheric": ("boosted", TELECONNECTION_FEATURES + GRID_FEATURES),
            "boosted_full": ("boosted", FEATURE_SCHEMAS["atmospheric"]),
        },
    )
    for name, label in HORIZON_LABELS.items()
]


def training_table(spark, sf_dir, dates=None):
    """Features, all labels and split of every head; one row per district and date."""
    dates = month_ends(spark, sf_dir) if dates is None else dates
    rows = with_vectors(spark, sf_dir, labelled_rows(spark, sf_dir), dates)
    return B.with_purged_split(rows, "Date", train_until=TRAIN_UNTIL)


def _spec_sql() -> str:
    parts = []
    for spec in HEAD_SPECS:
        months = ", ".join(map(str, spec.months))
        parts.append(
            f"select '{spec.name}' as head, split, case when m in ({months}) then {spec.name} end as y from lv where split is not null"
        )
    return " union all ".join(parts)


@query("head_training_rows", f"""
{LABEL_VIEW_SQL}, lo as ({_spec_sql()})
select head, split, count(y) as rows, cast(coalesce(sum(y), 0) as bigint) as positives,
  case when split = 'train' then cast(round(least(25e0, greatest(1e0, (count(y) - coalesce(sum(y), 0)) / greatest(1, coalesce(sum(y), 0)))) * 1e6) as bigint) end as weight
from lo group by 1, 2
""")
def head_training_rows(spark, sf_dir):
    """What each of the 18 heads learns from: rows, positives and their weight, by split."""
    rows = B.with_purged_split(labelled_rows(spark, sf_dir), "Date", train_until=TRAIN_UNTIL)
    out = T.training_counts(rows, HEAD_SPECS)
    return tidy(out.withColumn("weight", S.scaled("weight", 6)))
