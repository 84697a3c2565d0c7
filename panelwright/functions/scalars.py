"""Column expressions for dates, weather numbers, codes and probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.config import FRESH_DAYS


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- dates -----------------------------------------------------------------

def yyyymmdd(col: Column | str) -> Column:
    """Integer-coded date to DATE, null when unparsable."""
    return F.try_to_timestamp(_c(col).cast("string"), F.lit("yyyyMMdd")).cast("date")


def day_of_index(year: Column | str, index: Column | str) -> Column:
    """DATE of a zero-based day index within a year."""
    return F.date_add(F.make_date(_c(year), F.lit(1), F.lit(1)), _c(index).cast("int"))


def days_in_year(year: Column | str) -> Column:
    return F.dayofyear(F.make_date(_c(year), F.lit(12), F.lit(31)))


def month_published(year: Column | str, month: Column | str) -> Column:
    """A monthly value is published on the first day of the following month."""
    return F.add_months(F.make_date(_c(year), _c(month), F.lit(1)), 1)


def month_day(col: Column | str) -> Column:
    return F.month(_c(col)) * 100 + F.dayofmonth(_c(col))


def in_season(col: Column | str, first: tuple[int, int], last: tuple[int, int]) -> Column:
    """Whether the (month, day) of a date lies in an inclusive window."""
    return month_day(col).between(first[0] * 100 + first[1], last[0] * 100 + last[1])


def in_months(col: Column | str, months) -> Column:
    return F.month(_c(col)).isin([int(m) for m in months])


def freshness(reference: Column | str, now: Column | str, days: int = FRESH_DAYS) -> Column:
    """CURRENT within ``days`` of ``now``, STALE when older, else UNAVAILABLE."""
    age = F.datediff(_c(now), _c(reference))
    return (
        F.when(age.isNull() | (age < 0), "UNAVAILABLE")
        .when(age <= days, "CURRENT")
        .otherwise("STALE")
    )


def available_at(observed: Column | str, latency: Column) -> Column:
    return _c(observed) + latency


def usable_as_of(observed, available, reference) -> Column:
    """Published by the reference time; null if publication precedes observation."""
    return F.when(_c(available) >= _c(observed), _c(available) <= _c(reference))


# --- weather numbers ---------------------------------------------------------

def diurnal_range(tmax, tmin) -> Column:
    return F.greatest(F.lit(0.5), _c(tmax) - _c(tmin))


def vapour_pressure_deficit(tmax, tmin, humidity) -> Column:
    """kPa, by the Tetens formula at the mean temperature."""
    mean = (_c(tmax) + _c(tmin)) / F.lit(2.0)
    saturated = F.lit(0.61078) * F.exp(F.lit(17.27) * mean / (mean + F.lit(237.3)))
    actual = saturated * (_c(humidity) / F.lit(100.0))
    return F.greatest(F.lit(0.0), saturated - actual)


def cycle_sin(col, period: float) -> Column:
    return F.sin(F.lit(2 * math.pi) * _c(col) / F.lit(float(period)))


def cycle_cos(col, period: float) -> Column:
    return F.cos(F.lit(2 * math.pi) * _c(col) / F.lit(float(period)))


def above(col, limit: float, *, null_is_zero: bool) -> Column:
    """1/0 flag; the batch path turns a null into 0, the as-of path keeps it null."""
    flag = (_c(col) > F.lit(limit)).cast("int")
    return F.coalesce(flag, F.lit(0)) if null_is_zero else flag


def below(col, limit: float, *, null_is_zero: bool) -> Column:
    flag = (_c(col) < F.lit(limit)).cast("int")
    return F.coalesce(flag, F.lit(0)) if null_is_zero else flag


def finite(col) -> Column:
    """Not null, not NaN and not infinite."""
    value = _c(col).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def clip(col, low: float, high: float) -> Column:
    """Bound a value, keeping nulls."""
    return F.when(_c(col).isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), _c(col))))


# --- probabilities -----------------------------------------------------------

def logit(col, margin: float = 1e-6) -> Column:
    p = clip(_c(col), margin, 1.0 - margin)
    return F.ln(p / (F.lit(1.0) - p))


def sigmoid(col) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))


def probability_pair(col) -> tuple[Column, Column]:
    """Clipped probability rounded to 4 places and its percentage to 2 places."""
    p = clip(_c(col), 0.0, 1.0)
    return F.round(p, 4), F.round(p * 100.0, 2)


# --- strings and codes -------------------------------------------------------

def clean_code(col) -> Column:
    """Code as trimmed text: blanks and spelled-out nulls to null, no trailing ``.0``."""
    text = F.trim(_c(col).cast("string"))
    # only short texts can be a spelled-out null, and only those with ".0" can end in it
    empty = (F.length(text) <= 4) & F.lower(text).isin("", "nan", "none")
    bare = F.when(F.contains(text, F.lit(".0")), F.regexp_replace(text, r"\.0$", "")).otherwise(text)
    return F.when(~empty, bare)


def clean_name(col) -> Column:
    return F.trim(F.coalesce(_c(col).cast("string"), F.lit("")))


def same_text(left, right) -> Column:
    """Equality that ignores case and outer blanks; null counts as empty."""
    return F.lower(clean_name(left)) == F.lower(clean_name(right))


def is_text(col, upper_value: str) -> Column:
    return F.upper(F.trim(_c(col))) == upper_value


def replace_values(col, mapping: dict[str, str]) -> Column:
    """Replace whole values by a small fixed map."""
    out = _c(col)
    result = out
    for old, new in mapping.items():
        result = F.when(out == old, new).otherwise(result)
    return result


def canonical_block_id(col) -> Column:
    """``blk_0NNN`` to ``blk_NNN`` when the tail is all digits, else unchanged."""
    text = _c(col).cast("string")
    digits = F.regexp_extract(text, r"^blk_([0-9]+)$", 1)
    return F.when(
        digits != "", F.concat(F.lit("blk_"), F.coalesce(
            F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), F.lit("0")))
    ).otherwise(text)


def model_key(col) -> Column:
    """Display name of a district to its key in the model tables."""
    # Display names whose key is not just the name with underscores.
    special = {
        "Birbhum (Suri)": "Birbhum_Suri",
        "Purba Bardhaman": "Purba_Bardhaman",
        "Darjeeling (Siliguri Foothills)": "Siliguri_Foothill",
    }
    text = _c(col)
    return F.coalesce(
        *[F.when(text == name, key) for name, key in special.items()],
        F.replace(text, F.lit(" "), F.lit("_")),
    )


def unit_id(prefix: str, col) -> Column:
    return F.concat(F.lit(prefix), F.trim(_c(col).cast("string")))


def valid_unit_id(col, prefix: str) -> Column:
    return _c(col).rlike(f"^{prefix}[0-9]+$")


def head_of_target(col) -> tuple[Column, Column]:
    """Event and horizon encoded in a label column name such as ``target_x_7_14d``."""
    pattern = r"^target_(.+)_((?:7_14|15_21|22_30)d)$"
    return F.regexp_extract(_c(col), pattern, 1), F.regexp_extract(_c(col), pattern, 2)


def ordinal(col, classes) -> Column:
    """Zero-based position of a value in a fixed list, null if absent."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), _c(col))
    return F.when(position > 0, (position - 1).cast("int"))


def scaled(col, digits: int = 6) -> Column:
    """A double as a whole number of ``10**-digits`` (exact comparison across engines)."""
    return F.round(_c(col).cast("double") * F.lit(10.0**digits)).cast("bigint")
