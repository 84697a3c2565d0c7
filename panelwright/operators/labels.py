"""Event labels over future rows: two generations of core labels and the outlook.

The two generations differ on purpose. The first counts the current row for onset
and false onset, keeps 0 out of season and at the end of a series, and lets windows
cross year ends. The second is strictly future, null where it cannot be observed,
and evaluates onsets inside each year.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.config import (
    CORE_TARGETS,
    HORIZON_FOLLOW_UP,
    HORIZON_MONTHS,
    HORIZONS,
    PANEL,
    RULES,
    EventRules,
    PanelColumns,
)
from panelwright.functions.scalars import in_months
from panelwright.operators.windows import (
    YEAR,
    ahead,
    any_ahead,
    any_near,
    dry_streak,
    length,
    position,
    run_starts,
    running,
    series,
    series_in_year,
    with_year,
)

WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def _byte(flag: Column) -> Column:
    return flag.cast("tinyint")


def _base(df: DataFrame, cols: PanelColumns, rules: EventRules, **more: Column) -> DataFrame:
    """Row position, series length, run starts, row-level events and running counts.

    Two passes: the first looks at the next rows, the second counts what they tell.
    ``more``: further columns over run starts and row-level events, found in the second.
    A panel without the dry streak gets it here, in windows that are needed anyway.
    """
    w = series(cols.key, cols.ts)
    rain = F.col(cols.rain)
    # what a surge asks of its own day is settled first: no later window carries zone or humidity
    out = with_year(df, cols.ts).withColumn("_surge_total", _surge_total(cols, rules)).withColumns(
        {
            "_pos": position(w),
            "_n": length(w),
            **{
                f"_rain{rows}": ahead(cols.rain, rows, w)
                for rows in range(1, max(3, rules.short_run, rules.long_run))
            },
            "_year3": ahead(YEAR, 3, w),
            "_year_end": ahead(YEAR, rules.short_run - 1, w),
        }
    )

    def wet(day: Column) -> Column:
        return F.coalesce(day >= F.lit(rules.dry_below), F.lit(True))

    def dry_run(rows: int) -> Column:
        return run_starts([wet(rain), *[wet(F.col(f"_rain{k}")) for k in range(1, rows)]])

    out = out.withColumns(
        {
            "_next": F.col("_rain1"),
            "_sum3": rain + F.col("_rain1") + F.col("_rain2"),
            "_short": dry_run(rules.short_run),
            "_long": dry_run(rules.long_run),
            "_room": F.coalesce(F.col("_year3") == F.col(YEAR), F.lit(False)),
        }
    )
    # the year of a run that ends in the year it starts in
    out = out.withColumn("_short_year", F.when(F.col("_short") & (F.col("_year_end") == F.col(YEAR)), F.col(YEAR)))
    heavy_day = F.coalesce(rain >= rules.heavy_day, F.lit(False))
    heavy_sum = F.coalesce(F.col("_sum3") >= rules.heavy_three_day, F.lit(False))
    revival = F.coalesce(
        (rain >= rules.revival_first) & (F.col("_next") >= rules.revival_next), F.lit(False)
    )
    streak = {} if cols.streak in df.columns else {cols.streak: dry_streak(wet(rain), "_pos", w)}
    return out.withColumns(
        {
            "_shorts": running(F.col("_short"), w),
            "_longs": running(F.col("_long"), w),
            "_days": running(heavy_day, w),
            "_sums": running(heavy_sum, w),
            "_heavies": running(heavy_day | heavy_sum, w),
            "_revivals": running(revival, w),
            **streak,
            **more,
        }
    )


def _surge_total(cols: PanelColumns, rules: EventRules) -> Column:
    """Three-day rain that makes a surge of a day; null where the day itself rules it out."""
    zone = F.lower(F.coalesce(F.col(cols.zone).cast("string"), F.lit("")))
    day = (
        in_months(cols.ts, rules.surge_months)
        & (F.dayofyear(cols.ts) >= rules.surge_first_day_of_year)
        & (F.col(cols.rain) >= rules.dry_below)
        & (F.col(cols.humidity) >= rules.surge_humidity)
    )
    total = F.when(
        F.contains(zone, F.lit(rules.wet_zone_token)), rules.surge_total_wet_zone
    ).otherwise(rules.surge_total)
    return F.when(day, total)


def _surge(rules: EventRules, room: Column) -> Column:
    """Surge candidate; ``room``: the three rows after it exist in the same series (or year)."""
    return F.coalesce(
        room & (F.col("_next") >= rules.dry_below) & (F.col("_sum3") >= F.col("_surge_total")),
        F.lit(False),
    )


def _with_onset(df: DataFrame, cols: PanelColumns, **more: Column) -> DataFrame:
    """Position of the year's onset: first lasting surge, else the middle June row.

    ``more``: further columns over windows of the year, found in the same pass.
    """
    year = series_in_year(cols.key, cols.ts).rowsBetween(*WHOLE)
    june = F.month(cols.ts) == 6
    return df.withColumns(
        {
            "_strict": F.min(
                F.when(F.col("_surge") & ~F.col("_collapse"), F.col("_pos"))
            ).over(year),
            "_june": F.min(F.when(june, F.col("_pos"))).over(year)
            + F.floor(F.count(F.when(june, 1)).over(year) / 2),
            **more,
        }
    ).withColumn("_onset", F.coalesce("_strict", "_june"))


def _drop_work(df: DataFrame, original: list[str], added: list[str]) -> DataFrame:
    return df.select(*[c for c in original if c not in added], *added)


def _first_generation_state(df, cols, rules) -> DataFrame:
    w = series(cols.key, cols.ts)
    # a dry run inside rows 2..9 ahead starts on rows 2..5 ahead
    out = _base(df, cols, rules, _collapse=any_near(F.col("_short"), 2, 5, w)).withColumn(
        "_surge", _surge(rules, F.col("_pos") + 3 < F.col("_n"))
    )
    return _with_onset(out, cols)


def label_events_v1(
    df: DataFrame, cols: PanelColumns = PANEL, rules: EventRules = RULES
) -> DataFrame:
    """First-generation core labels, 0/1 on every row."""
    w = series(cols.key, cols.ts)
    state = _first_generation_state(df, cols, rules)
    distance = F.col("_onset") - F.col("_pos")
    early_false = F.col("_surge") & F.col("_collapse") & (
        F.col("_strict").isNull() | (F.col("_pos") < F.col("_strict"))
    )
    dry_season = in_months(cols.ts, rules.dry_months)
    left = F.col("_n") - F.col("_pos")
    # three-day sums stay inside the seven rows ahead
    heavy = any_ahead("_days", 1, 7, w) | any_ahead("_sums", 1, 5, w)
    labels = {
        "onset": F.coalesce(distance.between(0, 14), F.lit(False)),
        "false_onset": any_near(early_false, 0, 2, w),
        "dry_spell_5d": dry_season & (left > 19) & any_ahead("_shorts", 1, 14, w),
        "severe_break_7d": dry_season & (left > 28) & any_ahead("_longs", 1, 21, w),
        "heavy_rain": (left > 7) & heavy,
        "revival": (F.col(cols.streak) >= rules.active_streak)
        & (left > 7)
        & any_ahead("_revivals", 1, 7, w),
    }
    out = state.withColumns({CORE_TARGETS[h]: _byte(c) for h, c in labels.items()})
    return _drop_work(out, df.columns, list(CORE_TARGETS.values()))


def _second_generation_state(df, cols, rules) -> DataFrame:
    w, y = series(cols.key, cols.ts), series_in_year(cols.key, cols.ts)
    # runs count only when they end inside the year they start in, which is the year of the row
    collapse = [F.coalesce(ahead("_short_year", rows, w) == F.col(YEAR), F.lit(False)) for rows in range(2, 6)]
    out = _base(df, cols, rules, _collapse=reduce(operator.or_, collapse)).withColumn(
        "_surge", _surge(rules, F.col("_room"))
    )
    collapsed = F.col("_surge") & F.col("_collapse")
    # collapsed surges after the row in its year: their number falls in a range that holds one
    falses = F.count_if(collapsed)
    return _with_onset(
        out, cols,
        _falses=falses.over(y.rowsBetween(*WHOLE)) - falses.over(y.rowsBetween(Window.unboundedPreceding, 0)),
    )


def label_events_v2(
    df: DataFrame, cols: PanelColumns = PANEL, rules: EventRules = RULES
) -> DataFrame:
    """Second-generation core labels: strictly future, null when not observable."""
    state = _second_generation_state(df, cols, rules)
    added = _second_generation_labels(cols, rules)
    return _drop_work(state.withColumns(added), df.columns, list(added))


def _second_generation_labels(cols: PanelColumns, rules: EventRules) -> dict[str, Column]:
    """Label columns over the state of the second generation."""
    w = series(cols.key, cols.ts)
    left = F.col("_n") - F.col("_pos")
    distance = F.col("_onset") - F.col("_pos")
    onset_season = in_months(cols.ts, rules.surge_months)
    dry_season = in_months(cols.ts, rules.dry_months)
    # where the year ends before the last row of the range, all that is left of it counts
    same_year = F.coalesce(ahead(YEAR, 14, w) == F.col(YEAR), F.lit(False))
    false_ahead = F.col("_falses") > F.when(same_year, ahead("_falses", 14, w)).otherwise(0)
    labels = {
        "onset": F.when(
            onset_season & (left > 24), F.coalesce(distance.between(1, 14), F.lit(False))
        ),
        "false_onset": F.when(onset_season & (left > 24), false_ahead),
        "dry_spell_5d": F.when(dry_season & (left > 19), any_ahead("_shorts", 1, 14, w)),
        "severe_break_7d": F.when(dry_season & (left > 28), any_ahead("_longs", 1, 21, w)),
        "heavy_rain": F.when(left > 10, any_ahead("_heavies", 1, 7, w)),
        "revival": F.when(
            dry_season & (left > 8),
            (F.col(cols.streak) >= rules.active_streak) & any_ahead("_revivals", 1, 7, w),
        ),
    }
    return {CORE_TARGETS[h]: _byte(c) for h, c in labels.items()}


def label_horizons(
    df: DataFrame,
    cols: PanelColumns = PANEL,
    rules: EventRules = RULES,
    horizons: dict[str, tuple[int, int]] = HORIZONS,
) -> DataFrame:
    """Outlook labels per event and window, with availability and season flags."""
    added = _horizon_labels(cols, rules, horizons)
    return _drop_work(_base(df, cols, rules).withColumns(added), df.columns, list(added))


def label_events_and_horizons(
    df: DataFrame, cols: PanelColumns = PANEL, rules: EventRules = RULES
) -> DataFrame:
    """Second-generation core labels and outlook labels over one state of the series."""
    state = _second_generation_state(df, cols, rules)
    added = _second_generation_labels(cols, rules) | _horizon_labels(cols, rules, HORIZONS)
    return _drop_work(state.withColumns(added), df.columns, list(added))


def _horizon_labels(
    cols: PanelColumns, rules: EventRules, horizons: dict[str, tuple[int, int]]
) -> dict[str, Column]:
    """Outlook label columns over the running counts of a series."""
    w = series(cols.key, cols.ts)
    counts = {"dry_spell": "_shorts", "severe_break": "_longs", "heavy_rain": "_heavies",
              "revival": "_revivals"}
    added: dict[str, Column] = {}
    for window, (first, last) in horizons.items():
        known = F.col("_pos") + last + HORIZON_FOLLOW_UP < F.col("_n")
        added[f"label_available_{window}"] = known
        for event, count in counts.items():
            season = known & in_months(cols.ts, HORIZON_MONTHS[event])
            value = any_ahead(count, first, last, w)
            if event == "revival":
                value = (F.col(cols.streak) >= rules.active_streak) & value
            added[f"target_applicable_{event}_{window}"] = season
            added[f"target_{event}_{window}"] = _byte(F.when(season, value))
    return added


def onset_events(
    df: DataFrame, cols: PanelColumns = PANEL, rules: EventRules = RULES,
    *, within_year: bool = False,
) -> DataFrame:
    """Per key and year: onset date, whether it is the fallback, and false-onset count.

    ``within_year=False`` counts the collapsed surges before the onset only (first
    generation); ``True`` counts all of the year (second generation).
    """
    if within_year:
        state = _second_generation_state(df, cols, rules)
        counted = F.col("_surge") & F.col("_collapse")
    else:
        state = _first_generation_state(df, cols, rules)
        counted = F.col("_surge") & F.col("_collapse") & (
            F.col("_strict").isNull() | (F.col("_pos") < F.col("_strict"))
        )
    return state.groupBy(cols.key, F.col(YEAR).alias("year")).agg(
        F.max(F.when(F.col("_pos") == F.col("_onset"), F.col(cols.ts))).alias("onset_date"),
        F.max(F.col("_strict").isNull().cast("int")).alias("is_fallback"),
        F.count_if(counted).alias("false_onsets"),
    )
