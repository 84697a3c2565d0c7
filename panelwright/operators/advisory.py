"""Crop advisory: the first of ten ordered outcomes for a crop and a forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import scalars as S

# Probability limits of the rules.
LIMITS = {
    "onset_favorable": 0.60,
    "false_onset_high": 0.40,
    "dry_elevated": 0.50,
    "severe_elevated": 0.50,
    "heavy_elevated": 0.50,
    "dry_extreme": 0.70,
}

# Supported crops with name and first and last (month, day) of sowing.
CROPS = {"aman_rice": ("Aman rice", (5, 20), (8, 7))}

# Rule id, action, validity, headline and reason keys per outcome.
OUTCOMES = {
    "crop": ("AGRI-WAIT-CROP-CONTEXT-001", "WAIT", "CROP_CONTEXT_REQUIRED",
             "Crop context required", ("reason.crop_context_required",)),
    "window": ("AGRI-WAIT-WINDOW-001", "WAIT", "VALID_FOR_CROP_WINDOW_ONLY",
               "Wait: outside the sourced sowing window", ("reason.outside_sowing_window",)),
    "outlook": ("AGRI-WAIT-APPLICABILITY-001", "WAIT", "INSUFFICIENT_APPLICABLE_FORECAST",
                "Wait: forecast applicability is insufficient",
                ("reason.forecast_not_applicable",)),
    "current": ("AGRI-WAIT-APPLICABILITY-002", "WAIT", "INSUFFICIENT_CURRENT_FORECAST",
                "Wait: current forecast is incomplete", ("reason.current_forecast_missing",)),
    "heavy": ("AGRI-DRAINAGE-001", "WAIT", "VALID_FOR_CROP_WINDOW_ONLY",
              "Wait and prepare drainage",
              ("reason.heavy_rain_elevated", "reason.drainage_priority")),
    "false": ("AGRI-WAIT-FALSE-ONSET-001", "WAIT", "VALID_FOR_CROP_WINDOW_ONLY",
              "Wait: false-onset risk is elevated", ("reason.false_onset_elevated",)),
    "onset": ("AGRI-WAIT-ONSET-001", "WAIT", "VALID_FOR_CROP_WINDOW_ONLY",
              "Wait: onset is not sufficiently reliable", ("reason.onset_insufficient",)),
    "extreme": ("AGRI-WAIT-DRY-SPELL-001", "WAIT", "VALID_FOR_CROP_WINDOW_ONLY",
                "Wait: dry-spell risk is severe",
                ("reason.dry_spell_extreme", "reason.sowing_deferred")),
    "irrigate": ("AGRI-IRRIGATION-001", "PREPARE_IRRIGATION", "VALID_FOR_CROP_WINDOW_ONLY",
                 "Prepare irrigation before sowing",
                 ("reason.dry_spell_elevated", "reason.irrigation_preparedness")),
    "sow": ("AGRI-SOW-001", "SOW", "VALID_FOR_CROP_WINDOW_ONLY",
            "Sowing conditions are favorable",
            ("reason.sowing_window", "reason.onset_favorable", "reason.risk_acceptable")),
}


def _outcome_map() -> Column:
    entries = []
    for state, (rule, action, validity, headline, reasons) in OUTCOMES.items():
        entries += [
            F.lit(state),
            F.struct(
                F.lit(rule).alias("rule_id"),
                F.lit(action).alias("action"),
                F.lit(validity).alias("validity"),
                F.lit(headline).alias("headline"),
                F.array(*[F.lit(r) for r in reasons]).alias("reason_keys"),
            ),
        ]
    return F.create_map(*entries)


def crop_advisory(
    df: DataFrame,
    *,
    date: str = "reference_date",
    crop: str = "crop",
    prefix: str = "p_",
    outlook_dry: str = "outlook_dry_spell",
    outlook_severe: str = "outlook_severe_break",
) -> DataFrame:
    """Add the struct ``advisory`` and the map ``risk_factors``.

    Outlook columns hold the 7-14 day probabilities, null when out of season. Rows with
    an unknown crop or an invalid probability belong to :func:`advisory_input_errors`.
    """
    p = {h: F.col(f"{prefix}{h}") for h in
         ("onset", "false_onset", "dry_spell_5d", "severe_break_7d", "heavy_rain", "revival")}
    dry, severe = F.col(outlook_dry), F.col(outlook_severe)
    name = F.lower(F.trim(crop))
    in_window = F.lit(False)
    for key, (_, first, last) in CROPS.items():
        in_window = in_window | ((name == key) & S.in_season(date, first, last))
    missing_now = p["heavy_rain"].isNull() | p["onset"].isNull() | p["false_onset"].isNull() \
        | p["dry_spell_5d"].isNull()
    state = (
        F.when(F.coalesce(F.col(crop), F.lit("")) == "", "crop")
        .when(~in_window, "window")
        .when(dry.isNull() | severe.isNull(), "outlook")
        .when(missing_now, "current")
        .when(p["heavy_rain"] >= LIMITS["heavy_elevated"], "heavy")
        .when(p["false_onset"] >= LIMITS["false_onset_high"], "false")
        .when(p["onset"] < LIMITS["onset_favorable"], "onset")
        .when(
            (p["dry_spell_5d"] >= LIMITS["dry_extreme"]) | (severe >= LIMITS["dry_extreme"]),
            "extreme",
        )
        .when(
            (p["dry_spell_5d"] >= LIMITS["dry_elevated"])
            | (dry >= LIMITS["dry_elevated"])
            | (severe >= LIMITS["severe_elevated"]),
            "irrigate",
        )
        .otherwise("sow")
    )
    base = [x for h, c in p.items() for x in (F.lit(f"{h}_probability"), c)]
    extra = [
        F.lit("outlook_7_14d_dry_spell_probability"), dry,
        F.lit("outlook_7_14d_severe_break_probability"), severe,
    ]
    return (
        df.withColumn("_state", state)
        .withColumns(
            {
                "advisory": F.element_at(_outcome_map(), F.col("_state")),
                "risk_factors": F.when(
                    F.col("_state").isin("extreme", "irrigate", "sow"),
                    F.create_map(*base, *extra),
                ).otherwise(F.create_map(*base)),
            }
        )
        .drop("_state")
    )


def advisory_input_errors(
    df: DataFrame, *, crop: str = "crop", probabilities: list[str]
) -> DataFrame:
    """Rows the advisory must reject: unknown crop or a probability outside [0, 1]."""
    name = F.lower(F.trim(crop))
    unknown = F.coalesce(F.col(crop), F.lit("")).isin("") == F.lit(False)
    bad_crop = unknown & ~name.isin(list(CROPS))
    bad_p = F.lit(False)
    for c in probabilities:
        bad_p = bad_p | F.coalesce(~F.col(c).between(0.0, 1.0), F.lit(False))
    return df.withColumn(
        "input_error",
        F.when(bad_crop, "unknown_crop").when(bad_p, "probability_out_of_bounds"),
    ).where(F.col("input_error").isNotNull())


def crop_catalog(spark) -> DataFrame:
    rows = [(key, name) for key, (name, _, _) in CROPS.items()]
    return spark.createDataFrame(rows, "key string, name string")
