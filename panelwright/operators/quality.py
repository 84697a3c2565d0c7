"""Data-quality checks. Each returns the violating rows or a small count table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.config import PANEL, PanelColumns
from panelwright.functions import scalars as S


def null_and_duplicate_counts(
    df: DataFrame, columns: list[str], cols: PanelColumns = PANEL
) -> DataFrame:
    """One row: rows, nulls per column, duplicated (key, date) pairs and extra copies.

    The pairs are counted per key and date first, so the totals need no distinct.
    """
    per_key = df.groupBy(cols.key, cols.ts).agg(
        F.count(F.lit(1)).alias("_copies"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
    )
    return per_key.agg(
        F.sum("_copies").alias("total_rows"),
        F.count_if(F.col("_copies") > 1).alias("duplicate_keys"),
        F.sum(F.col("_copies") - 1).alias("extra_copies"),
        *[F.sum(f"null_{c}").alias(f"null_{c}") for c in columns],
    )


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of copies."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )


def duplicate_copies(df: DataFrame, keys: list[str], name: str = "copies") -> DataFrame:
    """All rows whose keys occur more than once, with the number of copies as ``name``.

    The counts are joined back, so the rows of a hot key need not meet in one task. Null
    keys are equal to each other.
    """
    repeated = duplicate_rows(df, keys).select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("copies").alias("_copies")
    )
    same = reduce(
        lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    )
    return df.join(repeated, same).select(*df.columns, F.col("_copies").alias(name))


def calendar_gaps(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Missing stretches between consecutive dates of a key."""
    days = df.groupBy(cols.key, cols.ts).agg(F.lit(1).alias("_one")).drop("_one")
    w = Window.partitionBy(cols.key).orderBy(cols.ts)
    return (
        days.withColumn("gap_from", F.date_add(F.lag(cols.ts).over(w), 1))
        .where(F.col("gap_from") < F.col(cols.ts))
        .select(
            cols.key,
            "gap_from",
            F.date_sub(cols.ts, 1).alias("gap_to"),
            F.datediff(cols.ts, "gap_from").alias("missing_days"),
        )
    )


def mismatch_counts(df: DataFrame, pairs: dict[str, tuple[str, str]], tolerance: float) -> DataFrame:
    """One row: how many rows differ between stored and recomputed columns."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[
            F.count_if(
                ~F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, F.lit(False))
                & ~(F.col(a).isNull() & F.col(b).isNull())
            ).alias(name)
            for name, (a, b) in pairs.items()
        ],
    )


def join_preservation(
    before: DataFrame, after: DataFrame, columns: list[str], ts: str
) -> DataFrame:
    """One row: row counts before and after a join, nulls, first and last date."""
    return after.agg(
        F.count(F.lit(1)).alias("rows_after"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns],
        F.min(ts).alias("first_date"),
        F.max(ts).alias("last_date"),
    ).withColumn("rows_before", before.agg(F.count(F.lit(1))).scalar())


def column_order_check(df: DataFrame, expected: list[str]) -> DataFrame:
    """One row per expected column: present, and at the expected position."""
    spark = df.sparkSession
    rows = [
        (name, i, df.columns.index(name) if name in df.columns else None)
        for i, name in enumerate(expected)
    ]
    return spark.createDataFrame(rows, "column string, expected int, actual int")


def missing_features(df: DataFrame, features: list[str], name: str = "missing_features") -> DataFrame:
    """Per row, the features that are null or not finite, in model order."""
    listed = F.array_compact(
        F.array(*[F.when(~S.finite(f), F.lit(f)) for f in features])
    )
    return df.withColumn(name, listed)


def out_of_range(df: DataFrame, ranges: dict[str, tuple[float, float]], keys: list[str]) -> DataFrame:
    """Rows with a value outside its physical range, one line per column."""
    checks = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(c).between(low, high),
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")),
                )
                for c, (low, high) in ranges.items()
            ]
        )
    )
    return df.select(*keys, F.explode(checks).alias("v")).select(*keys, "v.*")


def blank_identifiers(df: DataFrame, row_id: str, required: list[str]) -> DataFrame:
    """One line per row and required identifier that is null or blank."""
    blanks = F.array_compact(
        F.array(*[F.when(S.clean_name(c) == "", F.lit(c)) for c in required])
    )
    return df.select(row_id, F.explode(blanks).alias("property"))


def parent_conflicts(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Children that are mapped to more than one parent."""
    both = df.where(
        F.col(child).isNotNull() & F.col(parent).isNotNull()
    ).select(child, parent).distinct()
    return (
        both.groupBy(child)
        .agg(F.count(F.lit(1)).alias("parents"), F.min(parent).alias("first_parent"))
        .where(F.col("parents") > 1)
    )


def probability_violations(df: DataFrame, keys: list[str], p: str, pct: str) -> DataFrame:
    """Probabilities outside [0, 1] or percentages that are not 100 times them."""
    bad = ~F.col(p).between(0.0, 1.0) | (F.abs(F.col(pct) - F.col(p) * 100.0) > 0.0051)
    return df.where(bad).select(*keys, p, pct)


def check_summary(violations: dict[str, DataFrame]) -> DataFrame:
    """One row per check with PASSED or FAILED and its number of violations."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        for name, df in violations.items()
    ]
    return reduce(DataFrame.unionByName, counts).withColumn(
        "status", F.when(F.col("violations") == 0, "PASSED").otherwise("FAILED")
    )


