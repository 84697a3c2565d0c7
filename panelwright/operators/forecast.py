"""Forecast assembly: feature vectors, head status, risk classes, outlooks, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.config import (
    CORE_MONTHS,
    DISTRICTS,
    DOWNSCALE_COEFFICIENTS,
    HEAD_ROUTES,
    HORIZON_MONTHS,
    HORIZONS,
    RISK_CLASSES,
    RISK_COLORS,
    RISK_EDGES,
)
from panelwright.functions import scalars as S
from panelwright.operators.quality import missing_features

HEADS = tuple(CORE_MONTHS)


def district_table(spark) -> DataFrame:
    """The fixed district dimension: zone, coordinates and ordinal codes."""
    zones = sorted({z for z, _, _ in DISTRICTS.values()})
    rows = [
        (name, zone, lat, lon, i, zones.index(zone))
        for i, (name, (zone, lat, lon)) in enumerate(sorted(DISTRICTS.items()))
    ]
    return spark.createDataFrame(
        rows,
        "District string, zone_id string, Latitude double, Longitude double,"
        " District_Encoded int, Zone_Encoded int",
    )


def complete_observation(obs: DataFrame) -> DataFrame:
    """Fill derivable fields of an observation only where they are absent.

    Inverted temperatures are swapped for the derived values; nothing else is guessed,
    so a missing measurement stays null and marks the row UNAVAILABLE later.
    """
    def have(name: str) -> Column:
        return F.col(name) if name in obs.columns else F.lit(None).cast("double")

    tmax, tmin = F.col("Tmax_C"), F.col("Tmin_C")
    swap = tmax < tmin
    hi = F.when(swap, F.greatest(tmax, tmin) + 0.5).otherwise(tmax)
    lo = F.when(swap, F.least(tmax, tmin)).otherwise(tmin)
    doy = F.coalesce(have("day_of_year").cast("int"), F.dayofyear("Date"))
    iod = F.col("iod_dmi")
    both = tmax.isNotNull() & tmin.isNotNull()
    return obs.withColumns(
        {
            "day_of_year": doy,
            "doy_sin": F.coalesce(have("doy_sin"), S.cycle_sin(doy, 365.25)),
            "doy_cos": F.coalesce(have("doy_cos"), S.cycle_cos(doy, 365.25)),
            "dtr_c": F.coalesce(have("dtr_c"), F.when(both, S.diurnal_range(hi, lo))),
            "vpd_kpa": F.coalesce(
                have("vpd_kpa"),
                F.when(
                    both & F.col("Relative_Humidity_pct").isNotNull(),
                    S.vapour_pressure_deficit(hi, lo, "Relative_Humidity_pct"),
                ),
            ),
            "mjo_phase_sin": F.coalesce(have("mjo_phase_sin"), S.cycle_sin("MJO_Phase", 8.0)),
            "mjo_phase_cos": F.coalesce(have("mjo_phase_cos"), S.cycle_cos("MJO_Phase", 8.0)),
            "iod_positive_flag": F.coalesce(
                have("iod_positive_flag").cast("int"), S.above(iod, 0.4, null_is_zero=False)
            ),
            "iod_negative_flag": F.coalesce(
                have("iod_negative_flag").cast("int"), S.below(iod, -0.4, null_is_zero=False)
            ),
            "iod_dmi_lag7": F.coalesce(have("iod_dmi_lag7"), iod),
            "iod_dmi_lag14": F.coalesce(have("iod_dmi_lag14"), iod),
        }
    )


def with_missing(obs: DataFrame, schemas: dict[str, tuple[str, ...]]) -> DataFrame:
    """Add ``missing_<schema>``: the absent features of each model schema."""
    out = obs
    for name, features in schemas.items():
        out = missing_features(out, list(features), f"missing_{name}")
    return out


def route_table(routes=None) -> Column:
    """Head routes as one literal map: head -> (version, schema, feature count)."""
    entries = []
    for head, (version, schema, n) in (routes or HEAD_ROUTES).items():
        entries += [
            F.lit(head),
            F.struct(
                F.lit(version).alias("model_version"), F.lit(schema).alias("schema"),
                F.lit(n).alias("features"),
            ),
        ]
    return F.create_map(*entries)


def head_status(month: Column, head: Column, missing: Column, months=CORE_MONTHS,
                baseline_preferred: Column | None = None) -> Column:
    """OUT_OF_SEASON, BASELINE_PREFERRED, UNAVAILABLE or APPLICABLE, in this order."""
    season = F.lit(False)
    for name, ms in months.items():
        season = season | ((head == name) & month.isin([int(m) for m in ms]))
    status = F.when(~season, "OUT_OF_SEASON")
    if baseline_preferred is not None:
        status = status.when(baseline_preferred, "BASELINE_PREFERRED")
    return status.when(missing, "UNAVAILABLE").otherwise("APPLICABLE")


def head_results(obs: DataFrame, keys: list[str], p_of: dict[str, str]) -> DataFrame:
    """Long table of head results from one raw probability column per head.

    ``obs`` carries ``missing_<schema>`` arrays; a probability is kept only when the
    head applies, clipped and rounded to 4 places, with its percentage to 2 places.
    """
    routes = route_table()
    raw = F.array(
        *[
            F.struct(F.lit(h).alias("head"), F.col(c).cast("double").alias("raw"))
            for h, c in p_of.items()
        ]
    )
    rows = obs.select("*", F.explode(raw).alias("_r")).select("*", "_r.*").drop("_r")
    schema = F.element_at(routes, F.col("head"))
    missing = (
        F.when(schema["schema"] == "atmospheric", F.size("missing_atmospheric") > 0)
        .when(schema["schema"] == "iod", F.size("missing_iod") > 0)
        .otherwise(F.size("missing_baseline") > 0)
    )
    status = head_status(F.month("Date"), F.col("head"), missing)
    rows = rows.withColumn("applicability", status).withColumn(
        "_use", F.when(F.col("applicability") == "APPLICABLE", F.col("raw"))
    )
    p, pct = S.probability_pair("_use")
    return rows.select(
        *keys, "head", schema["model_version"].alias("model_version"),
        F.when(F.col("applicability") == "APPLICABLE", schema["features"]).otherwise(0)
        .alias("features_evaluated"),
        "applicability", p.alias("probability"), pct.alias("probability_pct"),
    )


def risk_class(p: Column | str, edges: tuple[float, float, float]) -> Column:
    """LOW to VERY_HIGH by the edges; UNAVAILABLE for null or non-finite values."""
    value = F.col(p) if isinstance(p, str) else p
    moderate, high, very_high = edges
    return (
        F.when(~S.finite(value), "UNAVAILABLE")
        .when(value >= very_high, "VERY_HIGH")
        .when(value >= high, "HIGH")
        .when(value >= moderate, "MODERATE")
        .otherwise("LOW")
    )


def risk_columns(df: DataFrame, prefix: str = "p_") -> DataFrame:
    """Class per risk head, the overall class (highest available) and its colour."""
    names = {"heavy_rain": "heavy_rain_risk", "severe_break_7d": "severe_break_risk",
             "dry_spell_5d": "dry_spell_risk", "false_onset": "false_onset_risk"}
    out = df.withColumns(
        {col: risk_class(f"{prefix}{head}", RISK_EDGES[head]) for head, col in names.items()}
    )
    ordered = F.array(*[F.lit(c) for c in RISK_CLASSES])
    top = F.greatest(*[F.array_position(ordered, F.col(c)) for c in names.values()])
    out = out.withColumn(
        "risk_level", F.when(top > 0, F.get(ordered, (top - 1).cast("int"))).otherwise("UNAVAILABLE")
    )
    colors = F.create_map(*[F.lit(x) for pair in RISK_COLORS.items() for x in pair])
    return out.withColumn("risk_color", F.element_at(colors, F.col("risk_level")))


# Headline of each advisory state, in rule order.
HEADLINES = {
    "unavailable": "Agronomic Advisory Unavailable",
    "heavy": "Heavy Rainfall & Waterlogging Alert",
    "dry": "Prolonged Dry Spell / Break Warning",
    "false": "False Onset Surge Precaution",
    "onset": "Monsoon Onset Favorable Advisory",
    "revival": "Monsoon Revival & Recovery Advisory",
    "normal": "Normal Seasonal Operations Advisory",
}
# Recommended action of each advisory state.
ACTIONS = {
    "unavailable": "Required forecast probabilities are unavailable; no agronomic action is inferred.",
    "heavy": "High risk of inundation. Clear drainage channels in aman paddy nurseries and vegetable plots. Postpone urea top-dressing and chemical pesticide applications until rainfall intensity subsides.",
    "dry": "Severe monsoon break anticipated. Conserve in-situ soil moisture using organic mulch. Arrange life-saving supplementary irrigation for tillering paddy. Defer transplanting where water storage is depleted.",
    "false": "Early surge likely to collapse into dry hiatus. Avoid direct dry seeding in upland fields. Stagger seedbed sowing and utilize community nursery beds under assured irrigation.",
    "onset": "Monsoon circulation establishment expected within 14 days. Accelerate land preparation, seed priming, and nursery bed sowing for long-duration Kharif rice cultivars.",
    "revival": "Revival of active monsoon trough expected within 7 days. Prepare fields for resumption of transplanting and apply basal fertilizer ahead of anticipated shower activity.",
    "normal": "Normal seasonal monsoon state. Continue standard agronomic intercultural operations, maintain field bunds, and monitor district weather bulletins for localized changes.",
}


def headline_advisory(df: DataFrame, prefix: str = "p_") -> DataFrame:
    """Headline and action: the first rule that holds; unavailable if any head is."""
    p = {h: F.col(f"{prefix}{h}") for h in HEADS}
    known = F.lit(True)
    for h in HEADS:
        known = known & S.finite(p[h])
    state = (
        F.when(~known, "unavailable")
        .when(p["heavy_rain"] >= 0.60, "heavy")
        .when((p["severe_break_7d"] >= 0.60) | (p["dry_spell_5d"] >= 0.70), "dry")
        .when((p["false_onset"] >= 0.40) & (p["onset"] >= 0.50), "false")
        .when(p["onset"] >= 0.60, "onset")
        .when(p["revival"] >= 0.50, "revival")
        .otherwise("normal")
    )
    heads = F.create_map(*[F.lit(x) for pair in HEADLINES.items() for x in pair])
    acts = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return (
        df.withColumn("_state", state)
        .withColumns(
            {
                "advisory_headline": F.element_at(heads, F.col("_state")),
                "recommended_action": F.element_at(acts, F.col("_state")),
            }
        )
        .drop("_state")
    )


def downscale(
    df: DataFrame, events: dict[str, str], *, elevation="elevation_mean_m",
    district_elevation="district_mean_elevation_m", wetness="delta_twi",
    coefficients=DOWNSCALE_COEFFICIENTS,
) -> DataFrame:
    """Shift each district probability on the logit scale by local covariates.

    The shift is bounded by 1.5; heads without coefficients keep their probability.
    """
    unit = F.coalesce(F.col(elevation), F.lit(0.0))
    district = F.coalesce(F.col(district_elevation), unit)
    relative = (unit - district) / F.greatest(F.lit(10.0), district)
    wet = F.coalesce(F.col(wetness), F.lit(0.0))
    shifted = {}
    for event, column in events.items():
        by_elevation, by_wetness = coefficients.get(event, (0.0, 0.0))
        shift = S.clip(relative * by_elevation + wet * by_wetness, -1.5, 1.5)
        shifted[f"{event}_downscaled"] = F.round(
            S.sigmoid(S.logit(F.col(column), 1e-4) + shift), 4
        )
    return df.withColumns(shifted)


def nest_outlook(long: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: map horizon -> map event -> (probability, applicability).

    Twelve rows per key at most are gathered. ``complete`` tells whether every horizon
    and event is there with a valid status and a probability inside [0, 1].
    """
    cell = F.struct("probability", "applicability")
    horizons = long.groupBy(*keys, "horizon").agg(
        F.map_from_entries(F.collect_list(F.struct("event", cell.alias("v")))).alias("events"),
        F.count_if(
            F.col("applicability").isin("APPLICABLE", "OUT_OF_SEASON", "UNAVAILABLE")
            & F.coalesce(F.col("probability").between(0.0, 1.0), F.lit(True))
        ).alias("_ok"),
    )
    wanted = len(HORIZONS) * len(HORIZON_MONTHS)
    return horizons.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("horizon", "events"))).alias("outlook"),
        (F.sum("_ok") == wanted).alias("complete"),
    )


def horizon_trend(long: DataFrame, keys: list[str]) -> DataFrame:
    """Three rows per key (one per horizon) and one percentage column per event.

    One aggregate of three rows per key; a pivot would first hold a row per key and event.
    """
    percent = F.round(F.col("probability") * 100.0, 2)
    return long.groupBy(*keys, "horizon").agg(
        *[F.max(F.when(F.col("event") == e, percent)).alias(e) for e in HORIZON_MONTHS]
    )


def inherit_down(
    children: DataFrame, crosswalk: DataFrame, forecasts: DataFrame, *,
    child_district: str, child_block: str, key: str = "District",
) -> DataFrame:
    """Give every child unit the forecast of its district.

    ``crosswalk`` has ``key``, ``district_code`` and an optional list ``blocks`` that
    restricts the district to some blocks. Units outside the crosswalk drop out.
    """
    walk = crosswalk.select(key, "district_code", "blocks").join(forecasts, key)
    joined = children.join(
        walk, children[child_district] == walk["district_code"]
    ).where(F.col("blocks").isNull() | F.array_contains("blocks", F.col(child_block)))
    return joined.drop("blocks", "district_code").withColumn(
        "downscaling_method", F.lit("NONE_DISTRICT_INHERITED")
    )


def attach_elevation(units: DataFrame, elevation: DataFrame, code: str) -> DataFrame:
    """Elevation by text code, rounded to one place; null where the table has none."""
    values = elevation.select(
        F.col("code").alias(code), F.round("elevation_m", 1).alias("elevation_m")
    )
    return units.join(values, code, "left")


def valid_units(df: DataFrame, code: str, name: str) -> DataFrame:
    return df.where((F.col(code).cast("string") != "0") & (F.trim(name) != ""))


def run_totals(
    units: DataFrame, unit_id: str, all_units: DataFrame, district: str = "District"
) -> DataFrame:
    """One row of layer totals: features, distinct units, duplicates, deficit."""
    per_unit = units.groupBy(unit_id).agg(
        F.count(F.lit(1)).alias("_parts"), F.any_value(district).alias("_d")
    )
    layer = per_unit.agg(
        F.sum("_parts").alias("features"),
        F.count(F.lit(1)).alias("unique_units"),
        F.count_if(F.col("_parts") > 1).alias("units_with_several_features"),
        F.countDistinct("_d").alias("districts"),
    )
    known = all_units.agg(F.count(F.lit(1))).scalar()
    return layer.withColumn("_all", known).select(
        "districts", "features", "unique_units",
        (F.col("features") - F.col("unique_units")).alias("excess_features"),
        "units_with_several_features",
        (F.col("_all") - F.col("features")).alias("unsupported_units"),
    )


def distinct_states(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Number of distinct probability tuples per group (null-safe)."""
    state = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.groupBy(group).agg(F.countDistinct(state).alias("states"))
