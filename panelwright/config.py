"""Rules, column names and fixed values shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

MONSOON_MONTHS = (6, 7, 8, 9, 10)
ONSET_MONTHS = (5, 6, 7)
ALL_MONTHS = tuple(range(1, 13))


@dataclass(frozen=True)
class PanelColumns:
    """Names of the panel columns an operator reads."""

    key: str = "District"
    ts: str = "Date"
    zone: str = "Zone"
    rain: str = "Rainfall_Observed_mm"
    humidity: str = "Relative_Humidity_pct"
    tmax: str = "Tmax_C"
    tmin: str = "Tmin_C"
    phase: str = "MJO_Phase"
    streak: str = "Dry_Spell_Days_Streak"


@dataclass(frozen=True)
class EventRules:
    """Thresholds of the rain events, in millimetres, rows and calendar units."""

    dry_below: float = 2.5
    revival_first: float = 5.0
    revival_next: float = 2.5
    heavy_day: float = 64.5
    heavy_three_day: float = 150.0
    surge_total: float = 25.0
    surge_total_wet_zone: float = 40.0
    wet_zone_token: str = "terai"
    surge_humidity: float = 70.0
    surge_first_day_of_year: int = 135
    surge_months: tuple[int, ...] = ONSET_MONTHS
    dry_months: tuple[int, ...] = MONSOON_MONTHS
    short_run: int = 5
    long_run: int = 7
    active_streak: int = 3


PANEL = PanelColumns()
RULES = EventRules()

# The six core heads, their label columns and applicable months.
CORE_TARGETS = {
    "onset": "target_onset_window_14d",
    "false_onset": "target_false_onset_flag",
    "dry_spell_5d": "target_dry_spell_5d_14d",
    "severe_break_7d": "target_dry_spell_7d_21d",
    "heavy_rain": "target_heavy_rain_7d",
    "revival": "target_revival_7d",
}
CORE_MONTHS = {
    "onset": ONSET_MONTHS,
    "false_onset": ONSET_MONTHS,
    "dry_spell_5d": MONSOON_MONTHS,
    "severe_break_7d": MONSOON_MONTHS,
    "heavy_rain": ALL_MONTHS,
    "revival": MONSOON_MONTHS,
}

# The outlook windows (rows ahead), their events and months.
HORIZONS = {"7_14d": (7, 14), "15_21d": (15, 21), "22_30d": (22, 30)}
HORIZON_FOLLOW_UP = 7
HORIZON_MONTHS = {
    "dry_spell": MONSOON_MONTHS,
    "severe_break": MONSOON_MONTHS,
    "heavy_rain": ALL_MONTHS,
    "revival": MONSOON_MONTHS,
}

# Publication delays in days.
WEEKLY_RELEASE_DELAY = 3
GRID_DELAY = 1
FRESH_DAYS = 14

# Purged temporal split.
SPLIT_GAP_DAYS = 37

# Risk class edges (moderate, high, very high) and map colours.
RISK_EDGES = {
    "heavy_rain": (0.25, 0.50, 0.75),
    "severe_break_7d": (0.25, 0.50, 0.75),
    "dry_spell_5d": (0.25, 0.50, 0.75),
    "false_onset": (0.20, 0.40, 0.65),
}
RISK_CLASSES = ("LOW", "MODERATE", "HIGH", "VERY_HIGH")
RISK_COLORS = {
    "LOW": "#22c55e",
    "MODERATE": "#eab308",
    "HIGH": "#f97316",
    "VERY_HIGH": "#ef4444",
    "UNAVAILABLE": "#94a3b8",
}

# Logit shift per unit of relative elevation and of wetness index.
DOWNSCALE_COEFFICIENTS = {
    "heavy_rain": (0.45, 0.50),
    "dry_spell_5d": (0.35, -0.40),
    "dry_spell_7d": (0.40, -0.45),
    "onset": (0.15, 0.10),
    "false_onset": (0.20, -0.20),
    "revival": (-0.10, 0.30),
}

# Which trained variant serves which head, and its feature count.
HEAD_ROUTES = {
    "onset": ("iod_enhanced", "iod", 31),
    "false_onset": ("atmospheric_enhanced", "atmospheric", 40),
    "revival": ("atmospheric_enhanced", "atmospheric", 40),
    "heavy_rain": ("atmospheric_enhanced", "atmospheric", 40),
    "dry_spell_5d": ("baseline_v1", "baseline", 26),
    "severe_break_7d": ("baseline_v1", "baseline", 26),
}

# Feature schemas, in model order.
BASE_FEATURES = (
    "Latitude", "Longitude", "Rainfall_Observed_mm", "Tmax_C", "Tmin_C",
    "Relative_Humidity_pct", "Solar_Radiation_MJm2", "MJO_Phase", "MJO_Amplitude",
    "Nino34_Anomaly", "Dry_Spell_Days_Streak", "Rolling_Rainfall_7d_mm",
    "Rolling_Rainfall_30d_mm", "Drought_Stress_Index", "Waterlogging_Risk_Index",
    "dtr_c", "vpd_kpa", "day_of_year", "doy_sin", "doy_cos", "mjo_phase_sin",
    "mjo_phase_cos", "rolling_rain_3d_mm", "rolling_rain_15d_mm",
    "District_Encoded", "Zone_Encoded",
)
INDEX_FEATURES = (
    "iod_dmi", "iod_positive_flag", "iod_negative_flag", "iod_dmi_lag7", "iod_dmi_lag14",
)
GRID_FEATURES = (
    "u850_regional", "v850_regional", "wind850_speed", "mslp_regional",
    "regional_slp_gradient", "u850_lag7", "mslp_lag7", "u850_rolling_7d", "mslp_rolling_7d",
)
FEATURE_SCHEMAS = {
    "baseline": BASE_FEATURES,
    "iod": BASE_FEATURES + INDEX_FEATURES,
    "horizon": BASE_FEATURES[:-2] + INDEX_FEATURES + GRID_FEATURES,
    "atmospheric": BASE_FEATURES + INDEX_FEATURES + GRID_FEATURES,
}

# What the candidates of a training run see: local state, and with it the ocean indices.
LOCAL_FEATURES = tuple(
    f for f in BASE_FEATURES[:-2]
    if f not in ("MJO_Phase", "MJO_Amplitude", "Nino34_Anomaly", "mjo_phase_sin", "mjo_phase_cos")
)
TELECONNECTION_FEATURES = LOCAL_FEATURES + (
    "MJO_Phase", "MJO_Amplitude", "Nino34_Anomaly", "mjo_phase_sin", "mjo_phase_cos", *INDEX_FEATURES,
)

# Districts with their zone and coordinates (latitude, longitude).
DISTRICTS = {
    "Alipurduar": ("terai_teesta", 26.49, 89.53),
    "Bankura": ("red_laterite", 23.23, 87.07),
    "Birbhum_Suri": ("red_laterite", 23.91, 87.53),
    "Cooch_Behar": ("terai_teesta", 26.32, 89.45),
    "Hooghly": ("gangetic_alluvial", 22.88, 87.78),
    "Jalpaiguri": ("terai_teesta", 26.54, 88.72),
    "Jhargram": ("red_laterite", 22.45, 86.98),
    "Murshidabad": ("gangetic_alluvial", 24.10, 88.25),
    "Nadia": ("gangetic_alluvial", 23.40, 88.50),
    "Purba_Bardhaman": ("gangetic_alluvial", 23.25, 87.85),
    "Purulia": ("red_laterite", 23.33, 86.36),
    "Siliguri_Foothill": ("terai_teesta", 26.71, 88.43),
}
