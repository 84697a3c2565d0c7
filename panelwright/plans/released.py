"""Released heads: sparse logistic heads, trained by ``train_heads`` on the small test tables.

Weights are per unit of a feature; features of a schema that are not named have no weight.
"""

from __future__ import annotations

from panelwright.config import CORE_MONTHS, FEATURE_SCHEMAS, HORIZON_MONTHS
from panelwright.operators.heads import BASELINE, MODEL, Head


def _head(name, schema, months, status, intercept, slope, shift, weights):
    return Head(
        name, schema, tuple(months), FEATURE_SCHEMAS[schema], intercept=intercept, weights=weights,
        slope=slope, shift=shift, status=status,
    )


RELEASED = (
    _head(
        "onset", "iod", CORE_MONTHS["onset"], MODEL, -2.726516, 0.872205, -0.260186,
        {"Rolling_Rainfall_30d_mm": -0.00284293, "doy_sin": 1.74292, "doy_cos": -0.664142, "rolling_rain_15d_mm": -0.000658339, "Zone_Encoded": 0.0380114},
    ),
    _head(
        "false_onset", "atmospheric", CORE_MONTHS["false_onset"], BASELINE, -6.409861, 4.092882, 3.792567,
        {"Tmin_C": -0.00189994, "Nino34_Anomaly": 0.0579248, "Dry_Spell_Days_Streak": -0.00555182, "day_of_year": -0.0168788, "doy_sin": 1.29888, "doy_cos": -8.37125, "Zone_Encoded": -0.0145647, "iod_positive_flag": 0.0204362},
    ),
    _head(
        "dry_spell_5d", "baseline", CORE_MONTHS["dry_spell_5d"], MODEL, 1.936798, 1.0, 0.0,
        {},
    ),
    _head(
        "severe_break_7d", "baseline", CORE_MONTHS["severe_break_7d"], BASELINE, 0.511969, 5.947189, -6.152245,
        {"Latitude": 0.0289222, "Nino34_Anomaly": -0.00261841},
    ),
    _head(
        "heavy_rain", "atmospheric", CORE_MONTHS["heavy_rain"], BASELINE, -2.930492, 1.0, 0.0,
        {},
    ),
    _head(
        "revival", "atmospheric", CORE_MONTHS["revival"], MODEL, -1.805428, 2.562561, 2.731702,
        {"Latitude": -0.00657986, "Dry_Spell_Days_Streak": 0.0224379, "vpd_kpa": 0.2447, "mjo_phase_sin": 0.00671842, "rolling_rain_3d_mm": -0.0574403},
    ),
    _head(
        "outlook_dry_spell", "horizon", HORIZON_MONTHS["dry_spell"], BASELINE, 0.820285, 10.958086, -9.163887,
        {"Tmin_C": 0.001667, "iod_dmi": 0.0674366},
    ),
    _head(
        "outlook_severe_break", "horizon", HORIZON_MONTHS["severe_break"], BASELINE, -0.291308, 6.395874, 0.886552,
        {"Tmin_C": 0.00518966},
    ),
)
