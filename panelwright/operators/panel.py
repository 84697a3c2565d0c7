"""Daily panels: densify, repair, derive, merge, project and split by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.config import CORE_TARGETS, HORIZON_MONTHS, HORIZONS, PANEL, PanelColumns
from panelwright.functions import scalars as S


def _day(value: str | Column) -> Column:
    """A date given as text, or as a column such as a scalar subquery over the data."""
    return value if isinstance(value, Column) else F.to_date(F.lit(value))


def calendar(spark: SparkSession, start: str | Column, end: str | Column, ts: str = "Date") -> DataFrame:
    """One row per day, both ends included."""
    days = F.sequence(_day(start), _day(end))
    return spark.range(1).select(F.explode(days).alias(ts))


def densify_daily(
    sparse: DataFrame,
    *,
    key: str,
    ts: str,
    measures: dict[str, Column],
    start: str | Column,
    end: str | Column,
    keys: DataFrame | None = None,
) -> DataFrame:
    """One row per key and calendar day with every measure at its default on empty days.

    ``sparse`` holds at most one row per (key, day) and ``measures`` maps each
    measure to its value on a day without a row. ``keys`` (one row per key) adds full
    series for keys that never occur and hands its other columns to every row of the
    key, without a join against the dense panel. The gaps are filled from each row up
    to the next row of the key, so only the sparse rows are shuffled; the dense rows
    are created after that shuffle and stay partitioned by key for later windows.
    """
    first, last = _day(start), _day(end)
    rows = sparse.where(F.col(ts).between(first, last)).select(
        key, ts, F.lit(True).alias("_real"), *measures
    )
    seeds = keys if keys is not None else sparse.select(key).distinct()
    attributes = [c for c in seeds.columns if c != key]
    seeds = seeds.withColumn(ts, F.date_sub(first, 1)).withColumn("_real", F.lit(False))
    series = Window.partitionBy(key).orderBy(ts)
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    # A fixed partition number keeps the adaptive planner from merging partitions by
    # the size of the sparse rows: every row is about to grow into a gap of days.
    partitions = int(sparse.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = rows.unionByName(seeds, allowMissingColumns=True).repartition(partitions, key)
    stacked = together.withColumns(
        {
            "_next": F.coalesce(F.date_sub(F.lead(ts).over(series), 1), last),
            **{a: F.first(a, ignorenulls=True).over(so_far) for a in attributes},
        }
    )
    filled = stacked.withColumn(
        "_day",
        F.explode(
            F.when(F.col("_next") >= F.col(ts), F.sequence(ts, "_next")).otherwise(
                F.array(ts)
            )
        ),
    ).where(F.col("_day") >= first)
    on_row = F.col("_real") & (F.col("_day") == F.col(ts))
    return filled.select(
        key,
        F.col("_day").alias(ts),
        *attributes,
        *[
            F.when(on_row, F.col(name)).otherwise(default).alias(name)
            for name, default in measures.items()
        ],
    )


def with_zone_of_file(df: DataFrame, zones: dict[str, str], column: str = "zone_id") -> DataFrame:
    """Tag rows read from several files with the zone of their file name."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    zone = F.coalesce(*[F.when(name == file, value) for file, value in zones.items()])
    return df.withColumn(column, zone)


def stack_panels(frames: list[DataFrame], defaults: dict[str, float]) -> DataFrame:
    """Union frames by name; columns absent from some or null get their default."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return with_defaults(out, defaults)


def with_defaults(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
            for name, value in defaults.items()
        }
    )


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first under ``order``.

    The rank filter lets Spark cut every input partition to one row per key before
    the shuffle, so a key with very many copies does not pile up in one task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merge_observations(
    history: DataFrame, current: DataFrame, *, since: str, columns: list[str],
    cols: PanelColumns = PANEL, sequence: str | None = None,
) -> DataFrame:
    """History from ``since`` on plus the current file; the current file wins.

    Two rows of one file with the same key and date are settled by the larger ``sequence``,
    or, without such a column, by the larger values of ``columns`` in their order.
    """
    tail = history.where(F.col(cols.ts) >= F.to_date(F.lit(since))).select(*columns)
    both = tail.withColumn("_source", F.lit(0)).unionByName(
        current.withColumn("_source", F.lit(1)), allowMissingColumns=True
    )
    ties = [sequence] if sequence else columns
    order = [F.col("_source").desc(), *[F.col(c).desc_nulls_last() for c in ties]]
    return keep_last(both, [cols.key, cols.ts], *order).drop("_source")


def _repair_steps(df: DataFrame, cols: PanelColumns) -> DataFrame:
    tmax, tmin = F.col(cols.tmax), F.col(cols.tmin)
    low = (tmax < 10.0) & (F.col(cols.rain) > 50.0) & S.in_months(cols.ts, (5, 6, 7, 8, 9))
    step = df.withColumn("_low", F.coalesce(low, F.lit(False))).withColumn(
        "_tmax1", F.when(F.col("_low"), F.round(tmin + 1.2, 2)).otherwise(tmax)
    )
    swapped = F.coalesce(F.col("_tmax1") < tmin, F.lit(False))
    return step.withColumns(
        {
            "_swap": swapped,
            "_tmax2": F.when(
                swapped, F.round(F.greatest("_tmax1", tmin) + 0.5, 2)
            ).otherwise(F.col("_tmax1")),
            "_tmin2": F.when(swapped, F.round(F.least("_tmax1", tmin), 2)).otherwise(tmin),
        }
    )


def repair_temperatures(
    df: DataFrame, cols: PanelColumns = PANEL
) -> tuple[DataFrame, DataFrame]:
    """Repaired panel and the log of every change.

    A maximum below 10 on a very wet warm-season day becomes the minimum plus 1.2;
    after that an inverted pair is swapped and the maximum raised by 0.5. The second
    rule sees the value written by the first, and both changes are logged.
    """
    steps = _repair_steps(df, cols)
    repaired = steps.withColumns(
        {cols.tmax: F.col("_tmax2"), cols.tmin: F.col("_tmin2")}
    ).drop("_low", "_swap", "_tmax1", "_tmax2", "_tmin2")

    def entry(issue: str, old_max: str, new_max: str, new_min: str) -> Column:
        return F.struct(
            F.lit(issue).alias("issue"),
            F.col(old_max).alias("old_tmax"),
            F.col(cols.tmin).alias("old_tmin"),
            F.col(new_max).alias("new_tmax"),
            F.col(new_min).alias("new_tmin"),
        )

    changes = F.array_compact(
        F.array(
            F.when(F.col("_low"), entry("low_tmax_heavy_rain", cols.tmax, "_tmax1", cols.tmin)),
            F.when(F.col("_swap"), entry("tmax_below_tmin", "_tmax1", "_tmax2", "_tmin2")),
        )
    )
    log = (
        steps.where(F.col("_low") | F.col("_swap"))
        .select(cols.key, cols.ts, F.explode(changes).alias("change"))
        .select(cols.key, cols.ts, "change.*")
    )
    return repaired, log


def derive_features(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Thermal, humidity, seasonal and trailing-rain features of each panel row."""
    doy = F.dayofyear(cols.ts)
    # where the panel has its year, in the order of the other windows: one sort for all
    order = [c for c in ("_year",) if c in df.columns]
    series = Window.partitionBy(cols.key).orderBy(*order, cols.ts)
    phase = F.col(cols.phase).cast("int")

    def trailing(days: int) -> Column:
        return F.round(F.sum(cols.rain).over(series.rowsBetween(-(days - 1), 0)), 2)

    out = df.withColumns(
        {
            "dtr_c": S.diurnal_range(cols.tmax, cols.tmin),
            "vpd_kpa": F.round(
                S.vapour_pressure_deficit(cols.tmax, cols.tmin, cols.humidity), 4
            ),
            "day_of_year": doy,
            "doy_sin": F.round(S.cycle_sin(doy, 365.25), 5),
            "doy_cos": F.round(S.cycle_cos(doy, 365.25), 5),
            "mjo_phase_sin": F.round(S.cycle_sin(phase, 8.0), 5),
            "mjo_phase_cos": F.round(S.cycle_cos(phase, 8.0), 5),
            "rolling_rain_3d_mm": trailing(3),
            "rolling_rain_15d_mm": trailing(15),
        }
    )
    return with_defaults(out, {"Drought_Stress_Index": 0.0, "Waterlogging_Risk_Index": 0.0})


# --- schema rules ------------------------------------------------------------

# Columns that never are features, beside labels and their flags.
NON_FEATURES = (
    "Date", "Target_Crops", "Active_Crop_Cycle", "Zone", "District", "zone_id",
    *CORE_TARGETS.values(),
    *[f"label_available_{window}" for window in HORIZONS],
    *[f"target_{e}_{w}" for e in HORIZON_MONTHS for w in HORIZONS],
    *[f"target_applicable_{e}_{w}" for e in HORIZON_MONTHS for w in HORIZONS],
)
LEAKY_PREFIXES = ("target_", "label_available_")
LEAKY_COLUMNS = ("Target_Crops", "Active_Crop_Cycle")


def feature_columns(schema: T.StructType, exclude=NON_FEATURES) -> list[str]:
    """Numeric columns usable as features, by name and type alone."""
    names = [
        f.name
        for f in schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name not in exclude
        and not f.name.startswith("_")
        and "future" not in f.name.lower()
        and "target" not in f.name.lower()
    ]
    if not names:
        raise ValueError("no numeric leakage-safe feature columns")
    return names


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def prediction_frame(df: DataFrame, features) -> DataFrame:
    """Drop every label-like column; fail when a needed feature is absent."""
    leaky = [
        c for c in df.columns if c.startswith(LEAKY_PREFIXES) or c in LEAKY_COLUMNS
    ]
    return require_columns(df.drop(*leaky), features)


def ordered_features(df: DataFrame, keys: list[str], features) -> DataFrame:
    """Keys followed by exactly the model's features in the model's order."""
    return require_columns(df, features).select(*keys, *features)


def deduped_left_join(
    left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]
) -> DataFrame:
    """Left rows with the first right row, under ``order``, of the same composite key.

    Left rows are neither lost nor multiplied, whatever the copies on the right; a null key
    matches nothing.
    """
    return left.join(keep_last(right, keys, *order), keys, "left")
