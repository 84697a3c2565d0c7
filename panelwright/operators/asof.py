"""Point-in-time joins: the latest value published at or before each date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.config import GRID_DELAY, PANEL, WEEKLY_RELEASE_DELAY, PanelColumns
from panelwright.functions import scalars as S
from panelwright.operators.staging import durable
from panelwright.operators.windows import lag_features


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    left_ts: str,
    right_ts: str,
    by: list[str],
    cols: list[str],
    block: str = "day",
    tie: list[str] | None = None,
    cuts: DataFrame | None = None,
) -> DataFrame:
    """Left rows with ``cols`` of the latest right row of the same key at or before them.

    Each key's timeline is cut into blocks (``date_trunc`` units) so that a key with a
    very large share of the rows spreads over many tasks. Per block, one row carries
    in the newest earlier value; the rest is one running window inside (key, block).
    No range join, no pairs, and the right side is never broadcast. Right rows with
    equal key and time are resolved to the greatest ``tie`` columns (default: ``cols``).
    A null key or a null time matches nothing: such left rows get nulls and take no part in
    the shuffle, such right rows are left out.

    With ``cuts`` of :func:`row_cuts` blocks hold equal numbers of rows instead: only keys
    with many rows are cut, every block gets its carry-in from the right side alone, and the
    left side is read once. ``block`` is ignored then.
    """
    known = F.lit(True)
    for column in by:
        known = known & F.col(column).isNotNull()
    right = right.where(known)
    unmatched = left.where(~known | F.col(left_ts).isNull()) if by else left.where(
        F.col(left_ts).isNull()
    )
    left = left.where(known & F.col(left_ts).isNotNull())
    value = F.struct(*cols)
    rank = F.struct(*[F.col(c) for c in (tie or cols)])
    latest = (
        right.where(F.col(right_ts).isNotNull())
        .groupBy(*by, F.col(right_ts).alias("_at"))
        .agg(F.max_by(value, rank).alias("_value"))
    )
    if cuts is None:
        carry, inside, queries = _time_blocks(left, latest, left_ts, by, block)
    else:
        carry, inside, queries = _row_blocks(left, latest, left_ts, by, cuts)
    running = (
        Window.partitionBy(*by, "_block")
        .orderBy("_at", "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    merged = (
        carry.withColumn("_at", F.col("_at").cast(latest.schema["_at"].dataType))
        .unionByName(inside)
        .unionByName(queries, allowMissingColumns=True)
        .withColumn("_found", F.last("_value", ignorenulls=True).over(running))
        .where("_side = 2")
    )
    found = merged.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in cols])
    types = {f.name: f.dataType for f in right.schema.fields}
    return found.unionByName(
        unmatched.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in cols])
    )


def _time_blocks(left, latest, left_ts, by, block):
    """Carry-ins, right rows and left rows in blocks of equal time."""
    latest = latest.withColumn("_block", F.date_trunc(block, "_at"))
    lefts = left.withColumns(
        {"_at": F.col(left_ts), "_block": F.date_trunc(block, F.col(left_ts))}
    )
    # newest value of each block, and for each block with left rows the carry-in
    summary = latest.groupBy(*by, "_block").agg(F.max_by("_value", "_at").alias("_value"))
    wanted = lefts.select(*by, "_block").distinct().withColumn("_wanted", F.lit(True))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = (
        summary.unionByName(wanted, allowMissingColumns=True)
        .groupBy(*by, "_block")
        .agg(F.max("_value").alias("_value"), F.max("_wanted").alias("_wanted"))
        .withColumn("_value", F.last("_value", ignorenulls=True).over(earlier))
        .where(F.col("_wanted") & F.col("_value").isNotNull())
        .select(*by, "_block", F.col("_block").alias("_at"), "_value", F.lit(0).alias("_side"))
    )
    inside = latest.select(*by, "_block", "_at", "_value", F.lit(1).alias("_side"))
    queries = lefts.withColumn("_row", F.struct(*left.columns)).select(
        *by, "_block", "_at", F.lit(2).alias("_side"), "_row"
    )
    return carry, inside, queries


MOST_BLOCKS = 8_192


def row_cuts(
    left: DataFrame, right: DataFrame, *, left_ts: str, right_ts: str, by: list[str],
    blocks: int | None = None,
) -> DataFrame:
    """Times that cut the keys with more than a ``blocks``-th of all rows into equal pieces.

    One row per such key: the key columns and ``_cuts``, ascending times as microseconds; a
    time that holds several pieces' worth of rows is repeated. There are fewer than ``blocks``
    keys and than ``2 * blocks`` cuts (default: eight per shuffle partition, ``MOST_BLOCKS`` at
    most), whatever the data, so the table may be broadcast. Only keys and times are read:
    counts per key, then quantiles of the keys that need them. The result is staged.
    """
    if blocks is None:
        blocks = 8 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(2, min(blocks, MOST_BLOCKS))
    rows = left.select(*by, F.col(left_ts).cast("timestamp").alias("_at")).unionByName(
        right.select(*by, F.col(right_ts).cast("timestamp").alias("_at"))
    ).dropna()
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    hot = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * blocks > total)
    grid = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    pieces = F.ceil(F.col("_n") * blocks / total).cast("int")
    cut = rows.join(F.broadcast(hot), by).groupBy(*by).agg(
        F.percentile_approx(F.unix_micros("_at"), grid, F.lit(20 * blocks)).alias("_grid"),
        F.first("_n").alias("_n"),
    ).withColumn("_pieces", pieces).where("_pieces > 1")
    return durable(
        cut.select(
            *by,
            F.transform(
                F.sequence(F.lit(1), F.col("_pieces") - 1),
                lambda i: F.get("_grid", F.floor(i * blocks / F.col("_pieces")).cast("int") - 1),
            ).alias("_cuts"),
        )
    )


def _below(cuts: Column, at: Column, equal: bool = False) -> Column:
    """Number of ascending cuts before a time (or at it), by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(MOST_BLOCKS.bit_length() - 1, -1, -1)])

    def step(found, width):
        value = F.get(cuts, found + width - 1)
        passed = value <= at if equal else value < at
        return F.when(F.coalesce(passed, F.lit(False)), found + width).otherwise(found)

    return F.when(cuts.isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), step))


def _row_blocks(left, latest, left_ts, by, cuts):
    """Carry-ins, right rows and left rows in blocks of equal row counts.

    A right row stands in the block of the cuts before its time. A left row whose time equals
    cuts may stand in any block that these bound; a hash of the row chooses one, so that a
    time with very many rows spreads (whole-row copies stay together).
    """
    cuts = F.broadcast(cuts)
    at = F.unix_micros(F.col("_at").cast("timestamp"))
    inside = latest.join(cuts, by, "left").select(
        *by, _below(F.col("_cuts"), at).alias("_block"), "_at", "_value", F.lit(1).alias("_side")
    )
    lefts = left.select(*by, F.col(left_ts).alias("_at"), F.struct(*left.columns).alias("_row"))
    first, last = _below(F.col("_cuts"), at), _below(F.col("_cuts"), at, equal=True)
    queries = (
        lefts.join(cuts, by, "left")
        .withColumns({"_first": first, "_last": last})
        .select(
            *by,
            (F.col("_first") + F.pmod(F.xxhash64("_row"), F.col("_last") - F.col("_first") + 1))
            .cast("int").alias("_block"),
            "_at", F.lit(2).alias("_side"), "_row",
        )
    )
    every = cuts.select(*by, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_block"))
    newest = latest.join(cuts, by).groupBy(*by, _below(F.col("_cuts"), at).alias("_block")).agg(
        F.max_by("_value", "_at").alias("_value")
    )
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        every.join(newest, [*by, "_block"], "left")
        .withColumn("_value", F.last("_value", ignorenulls=True).over(earlier))
        .where("_value is not null")
        .select(*by, "_block", F.lit(None).alias("_at"), "_value", F.lit(0).alias("_side"))
    )
    return carry, inside, queries


@dataclass(frozen=True)
class AsOfSource:
    """A source of point-in-time values: its rows, when they are known, and what they give.

    ``offsets`` are days: the value that was known so many days before a probe. Offset 0
    gives the columns under their own names, offset 7 of ``x`` gives ``x_lag7``.
    """

    rows: DataFrame
    ts: str
    cols: tuple[str, ...]
    offsets: tuple[int, ...] = (0,)

    def name(self, col: str, offset: int) -> str:
        return f"{col}_lag{offset}" if offset else col


def asof_many(
    probes: DataFrame, at: str, sources: list[AsOfSource], by: list[str] = ()
) -> DataFrame:
    """Probes with the last known values of all sources, by one shuffle and one sort.

    Probes and source rows are stacked and tagged. A row that counts for several offsets is
    repeated with its time moved forward, so that all offsets are answered by the same
    probe row; one running window per (source, offset) then carries the last value. Every
    source is read once. A source row with equal time and key gives way to the one with
    the greatest values. Null times of probes and keys without source rows get nulls; null
    keys match nothing. ``by`` empty means one series, as for national indices: it is bounded
    by its days and handled in one task. For tables of events per key use ``asof_join``.
    """
    parts = [
        probes.select(
            *by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*probes.columns).alias("_row")
        )
    ]
    for i, source in enumerate(sources):
        known = F.col(source.ts).isNotNull()
        for key in by:
            known = known & F.col(key).isNotNull()
        moved = source.rows.where(known).withColumn(
            "_offset", F.explode(F.array(*[F.lit(o) for o in source.offsets]))
        )
        value = F.struct(*source.cols)
        parts.append(
            moved.select(
                *by, (F.col(source.ts) + F.make_interval(days=F.col("_offset"))).cast(
                    probes.schema[at].dataType
                ).alias("_at"),
                F.lit(0).alias("_side"),
                *[
                    F.when(F.col("_offset") == o, value).alias(f"_{i}_{o}")
                    for o in source.offsets
                ],
            )
        )
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    values = [f"_{i}_{o}" for i, source in enumerate(sources) for o in source.offsets]
    running = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("_at", "_side", *values)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = stacked.withColumns(
        {v: F.last(v, ignorenulls=True).over(running) for v in values}
    ).where("_side = 1")
    return found.select(
        "_row.*",
        *[
            F.col(f"_{i}_{o}.{col}").alias(source.name(col, o))
            for i, source in enumerate(sources)
            for o in source.offsets
            for col in source.cols
        ],
    )


def weekly_releases(raw: DataFrame, delay: int = WEEKLY_RELEASE_DELAY) -> DataFrame:
    """Add the availability date of releases with a ``period_end`` column."""
    return raw.withColumn("available_date", F.date_add("period_end", delay))


def daily_release_values(
    days: DataFrame, releases: DataFrame, *, cols: list[str], ts: str = "Date",
    available: str = "available_date", tie: list[str] | None = None,
) -> DataFrame:
    """For each day of a calendar, the newest release published by then.

    Both inputs are one series for the whole panel (one row per day or release), so
    the calendar bounds them; join the result to the panel on the date.
    """
    return asof_join(
        days, releases, left_ts=ts, right_ts=available, by=[], cols=cols, block="year",
        tie=tie,
    )


def index_features(
    daily: DataFrame, *, value: str = "iod_dmi", ts: str = "Date", limit: float = 0.4,
    null_is_zero: bool = True,
) -> DataFrame:
    """Sign flags and 7/14-day lags of a daily index series."""
    flagged = daily.withColumns(
        {
            "iod_positive_flag": S.above(value, limit, null_is_zero=null_is_zero),
            "iod_negative_flag": S.below(value, -limit, null_is_zero=null_is_zero),
        }
    )
    lags = {f"{value}_lag7": (value, 7), f"{value}_lag14": (value, 14)}
    return lag_features(flagged, lags, key=None, ts=ts)


def attach_daily(panel: DataFrame, daily: DataFrame, ts: str = "Date") -> DataFrame:
    """Left join one row per day onto the panel; Spark broadcasts it if small enough."""
    return panel.join(daily, ts, "left")


def lagged_circulation(
    daily: DataFrame, *, delay: int = GRID_DELAY, backfill: bool = False, ts: str = "Date"
) -> DataFrame:
    """Circulation features usable ``delay`` days later: lags and 7-row means.

    ``backfill`` fills the leading nulls from later rows, which leaks and is off.
    """
    shifted = {
        "u850_regional": ("u850_raw", delay),
        "v850_regional": ("v850_raw", delay),
        "wind850_speed": ("wind850_speed_raw", delay),
        "mslp_regional": ("mslp_raw", delay),
        "regional_slp_gradient": ("regional_slp_gradient_raw", delay),
    }
    out = lag_features(daily, shifted, key=None, ts=ts, backfill=backfill)
    weekly = {"u850_lag7": ("u850_regional", 7), "mslp_lag7": ("mslp_regional", 7)}
    out = lag_features(out, weekly, key=None, ts=ts, backfill=backfill)
    last7 = Window.partitionBy(F.lit(0)).orderBy(ts).rowsBetween(-6, 0)
    out = out.withColumns(
        {
            "u850_rolling_7d": F.round(F.avg("u850_regional").over(last7), 4),
            "mslp_rolling_7d": F.round(F.avg("mslp_regional").over(last7), 2),
        }
    )
    return out.select(ts, *shifted, *weekly, "u850_rolling_7d", "mslp_rolling_7d")


def release_violations(
    df: DataFrame, *, ts: str = "Date", period_end: str = "period_end",
    available: str = "available_date", delay: int = WEEKLY_RELEASE_DELAY,
) -> DataFrame:
    """Rows that break the release rule: published too early, or used before."""
    early = F.col(available) < F.date_add(period_end, delay)
    ahead = F.col(available) > F.col(ts)
    return df.withColumn(
        "violation",
        F.when(early, "published_before_delay").when(ahead, "used_before_publication"),
    ).where(F.col("violation").isNotNull())


def publication_violations(df: DataFrame, *, observed: str, available: str) -> DataFrame:
    """Rows whose publication precedes the observation."""
    return df.where(F.col(available) < F.col(observed))


def complete_dates(
    panel: DataFrame, required: list[str], n_keys: int | Column | None = None,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """Dates on which all keys have every required value.

    Without ``n_keys`` the number of keys is counted in the panel.
    """
    if n_keys is None:
        n_keys = panel.agg(F.countDistinct(cols.key)).scalar()
    valid = panel.dropna(subset=required)
    return (
        valid.groupBy(cols.ts)
        .agg(F.countDistinct(cols.key).alias("keys"))
        .where(F.col("keys") == n_keys)
    )


def latest_common_date(
    panel: DataFrame,
    *,
    required: list[str],
    releases: DataFrame,
    daily: DataFrame,
    fallback: str,
    n_keys: int | Column | None = None,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """One row: the last date on which the panel and both index sources are usable.

    The newest complete panel date needs a release published by then; when the daily
    index misses it, the newest complete date that the index has; else ``fallback``.
    """
    dates = complete_dates(panel, required, n_keys, cols).select(cols.ts)
    in_daily = daily.select(F.col(cols.ts)).distinct().withColumn("_both", F.lit(True))
    newest = dates.join(in_daily, cols.ts, "left").agg(
        F.max(cols.ts).alias("newest"),
        F.max(F.when(F.col("_both"), F.col(cols.ts))).alias("newest_both"),
    )
    first_release = releases.agg(F.min("available_date")).scalar()
    return newest.withColumn("_first", first_release).select(
        F.coalesce(
            F.when(F.col("_first") <= F.col("newest"), F.col("newest_both")),
            F.to_date(F.lit(fallback)),
        ).alias("common_date")
    )
