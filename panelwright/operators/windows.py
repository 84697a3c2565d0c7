"""Trailing and forward window expressions over one series per key.

A series holds one row per key and calendar day, so its length is bounded by the
calendar. All frames are built on one (partition, order) pair: ``year, date`` sorts
exactly like ``date`` and lets per-key and per-(key, year) windows share one sort.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelwright.config import PANEL, PanelColumns

YEAR = "_year"


def series(key: str, ts: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(YEAR, ts)


def series_in_year(key: str, ts: str) -> WindowSpec:
    return Window.partitionBy(key, YEAR).orderBy(ts)


def with_year(df: DataFrame, ts: str) -> DataFrame:
    """Add the year column; chained operators keep it so that they share one sort."""
    return df if YEAR in df.columns else df.withColumn(YEAR, F.year(ts))


def _restore(df: DataFrame, before: DataFrame, *work: str) -> DataFrame:
    return df.drop(*work, *([] if YEAR in before.columns else [YEAR]))


def position(w: WindowSpec) -> Column:
    """Zero-based row position in the series."""
    return F.row_number().over(w) - 1


def length(w: WindowSpec) -> Column:
    return F.count(F.lit(1)).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )


def trailing_sum(col: str, rows: int, w: WindowSpec) -> Column:
    return F.sum(col).over(w.rowsBetween(-(rows - 1), 0))


def trailing_mean(col: str, rows: int, w: WindowSpec) -> Column:
    return F.avg(col).over(w.rowsBetween(-(rows - 1), 0))


def ahead(col: str, rows: int, w: WindowSpec) -> Column:
    return F.lead(col, rows).over(w)


def running(flag: Column, w: WindowSpec) -> Column:
    """Number of rows up to and including this one on which the flag holds.

    Differences of running counts answer every question about a range of rows, so the
    work per row does not grow with the length of the range.
    """
    return F.sum(flag.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def run_starts(broken: list[Column]) -> Column:
    """Whether a run starts here and ends inside the series.

    ``broken`` says of this row and each that the run needs after it whether it breaks a run;
    it must hold for rows behind the end. Runs of few rows need no running count this way.
    """
    return ~reduce(operator.or_, broken)


def any_ahead(count: str, first: int, last: int, w: WindowSpec) -> Column:
    """Whether a flag with running count ``count`` holds ``first`` to ``last`` rows ahead.

    False when the series ends before row ``last``: callers label such rows unavailable
    anyway. ``first`` is at least 1.
    """
    before = F.lead(count, first - 1).over(w) if first > 1 else F.col(count)
    return F.coalesce(F.lead(count, last).over(w) > before, F.lit(False))


def any_near(flag: Column, first: int, last: int, w: WindowSpec) -> Column:
    """The same straight from the flag, for ranges of few rows.

    It saves the pass that builds a running count, and a range cut short by the end of
    the series is searched as far as it goes. One look ahead per row of the range: a sliding
    frame would copy every row and go through the whole range again for each.
    """
    near = [F.coalesce(F.lead(flag, rows).over(w), F.lit(False)) for rows in range(max(first, 1), last + 1)]
    here = [F.coalesce(flag, F.lit(False))] if first == 0 else []
    return reduce(operator.or_, here + near)


def backfilled(col: str, w: WindowSpec) -> Column:
    """Leading nulls take the next known value; this looks ahead in time."""
    return F.first(col, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def dry_streak(wet: Column, pos: str, w: WindowSpec) -> Column:
    """Rows since the last wet one, from the row position ``pos``: its distance to that row."""
    last_wet = F.max(F.when(wet, F.col(pos))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (F.col(pos) - F.coalesce(last_wet, F.lit(-1))).cast("int")


def with_dry_streak(
    df: DataFrame, limit: float, cols: PanelColumns = PANEL, name: str | None = None
) -> DataFrame:
    """Count of consecutive rows below ``limit`` up to and including each row.

    Each row's distance to the last wet row: two functions over the same window, no
    grouping by run and hence no second sort. A row without a measured value ends the run,
    as a wet row does.
    """
    w = series(cols.key, cols.ts)
    wet = F.coalesce(F.col(cols.rain) >= F.lit(limit), F.lit(True))
    out = (
        with_year(df, cols.ts)
        .withColumn("_pos", position(w))
        .withColumn(name or cols.streak, dry_streak(wet, "_pos", w))
    )
    return _restore(out, df, "_pos")


def trailing_rain(df: DataFrame, rows=(3, 7, 15, 30), cols: PanelColumns = PANEL) -> DataFrame:
    """Trailing sums over the last rows, partial at the start of a series."""
    w = series(cols.key, cols.ts)
    sums = {f"rain_sum_{n}": F.round(trailing_sum(cols.rain, n, w), 2) for n in rows}
    return _restore(with_year(df, cols.ts).withColumns(sums), df)


def lag_features(
    df: DataFrame, lags: dict[str, tuple[str, int]], *, key: str | None, ts: str,
    backfill: bool = False,
) -> DataFrame:
    """Add lagged columns ``{new: (source, rows)}``; optional backfill of leading nulls."""
    w = series(key, ts) if key else Window.partitionBy(F.lit(0)).orderBy(YEAR, ts)
    out = with_year(df, ts).withColumns(
        {new: F.lag(source, rows).over(w) for new, (source, rows) in lags.items()}
    )
    if backfill:
        out = out.withColumns({new: backfilled(new, w) for new in lags})
    return _restore(out, df)


def drop_first_rows(df: DataFrame, rows: int, cols: PanelColumns = PANEL) -> DataFrame:
    """Remove the first rows of every series (warm-up or boundary rows)."""
    w = series(cols.key, cols.ts)
    out = with_year(df, cols.ts).withColumn("_pos", position(w)).where(F.col("_pos") >= rows)
    return _restore(out, df, "_pos")


def every_kth_row(df: DataFrame, k: int, cols: PanelColumns = PANEL) -> DataFrame:
    """Down-sample each series to every k-th row for a timeline view."""
    w = series(cols.key, cols.ts)
    out = with_year(df, cols.ts).withColumn("_pos", position(w)).where(F.col("_pos") % k == 0)
    return _restore(out, df, "_pos")
