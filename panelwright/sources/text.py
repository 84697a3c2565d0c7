"""Parsers for whitespace index files, gridded text and GeoJSON.

Each parser takes a DataFrame with a ``value`` line column, so the same code serves
``spark.read.text`` over many files and lines that come from any other table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.config import WEEKLY_RELEASE_DELAY
from panelwright.functions import scalars as S

MISSING = -9999.0


def _tokens(min_tokens: int, lines: DataFrame) -> DataFrame:
    """Split lines on blanks; keep those that start with a four-digit year."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.withColumn("_t", parts).where(
        (F.size("_t") >= min_tokens) & F.get("_t", F.lit(0)).rlike(r"^[0-9]{4}$")
    )


def _num(i: int, kind: str) -> Column:
    return F.get("_t", F.lit(i)).try_cast(kind)


def parse_daily_index(lines: DataFrame) -> DataFrame:
    """``year month day rmm1 rmm2 phase amplitude``; unparsable lines are skipped."""
    rows = _tokens(7, lines).select(
        F.try_to_date(
            F.concat_ws("-", F.get("_t", F.lit(0)), F.get("_t", F.lit(1)), F.get("_t", F.lit(2))),
            "y-M-d",
        ).alias("Date"),
        _num(3, "double").alias("RMM1"),
        _num(4, "double").alias("RMM2"),
        _num(5, "int").alias("MJO_Phase"),
        _num(6, "double").alias("MJO_Amplitude"),
    )
    return rows.dropna()


def parse_monthly_index(lines: DataFrame, column: int = 9) -> DataFrame:
    """``year month ...`` with the anomaly in one column, published next month."""
    rows = _tokens(column, lines).select(
        _num(0, "int").alias("year"), _num(1, "int").alias("month"),
        _num(column, "double").alias("Nino34_Anomaly"),
    ).where(F.col("month").between(1, 12) & F.col("Nino34_Anomaly").isNotNull())
    return rows.withColumn("available_date", S.month_published("year", "month"))


def parse_wide_years(lines: DataFrame, missing: float = MISSING) -> DataFrame:
    """One line per year with twelve monthly values to long rows, sentinel to null."""
    rows = _tokens(13, lines).select(
        _num(0, "int").alias("year"),
        F.posexplode(F.slice("_t", 2, 12)).alias("_i", "_v"),
    )
    value = F.col("_v").try_cast("double")
    return rows.select(
        "year", (F.col("_i") + 1).alias("month"),
        F.when(value > missing, value).alias("value"),
    )


def parse_releases(lines: DataFrame, delay: int = WEEKLY_RELEASE_DELAY) -> DataFrame:
    """``yyyymmdd,yyyymmdd,value`` lines to releases with their availability date."""
    t = F.split("value", ",")
    rows = lines.select(
        S.yyyymmdd(F.trim(F.get(t, F.lit(0)))).alias("period_start"),
        S.yyyymmdd(F.trim(F.get(t, F.lit(1)))).alias("period_end"),
        F.trim(F.get(t, F.lit(2))).try_cast("double").alias("iod_dmi"),
    ).dropna()
    return rows.withColumn("available_date", F.date_add("period_end", delay))


# Fixed format: a line of a gridded text file, [time][level][latitude], values.
GRID_LINE = r"^\s*\[(\d+)\](?:\[(\d+)\])?\[(\d+)\],\s*(.*)$"


def parse_grid(lines: DataFrame, year: Column) -> DataFrame:
    """``[time][level?][lat], v, v, ...`` lines to (Date, lat, values by longitude)."""
    v = F.col("value")
    values = F.filter(
        F.split(F.regexp_extract(v, GRID_LINE, 4), ","), lambda x: F.trim(x) != ""
    )
    return lines.where(v.rlike(GRID_LINE)).select(
        S.day_of_index(year, F.regexp_extract(v, GRID_LINE, 1).cast("int")).alias("Date"),
        F.regexp_extract(v, GRID_LINE, 3).cast("int").alias("lat"),
        F.transform(values, lambda x: F.trim(x).try_cast("double")).alias("values"),
    )


def read_lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path)


def read_grid_text(spark: SparkSession, path) -> DataFrame:
    """Grid files whose four-digit year is part of the file name."""
    lines = spark.read.text(path).withColumn("_file", F.col("_metadata.file_name"))
    year = F.regexp_extract("_file", r"(?:^|_)(\d{4})(?:_|\.)", 1).cast("int")
    return parse_grid(lines, year)


def grid_daily_means(u: DataFrame, v: DataFrame, slp: DataFrame) -> DataFrame:
    """Daily regional means, wind speed and north-minus-south pressure gradient.

    The three fields are stacked and aggregated once instead of being joined.
    """
    def cells(df: DataFrame, field: str) -> DataFrame:
        return df.select("Date", "lat", F.lit(field).alias("field"), F.explode("values").alias("x"))

    stacked = cells(u, "u").unionByName(cells(v, "v")).unionByName(cells(slp, "slp"))

    def mean(cond: Column, scale: float = 1.0) -> Column:
        return F.avg(F.when(cond, F.col("x") / F.lit(scale)))

    f = F.col("field")
    day = stacked.groupBy("Date").agg(
        mean(f == "u").alias("_u"), mean(f == "v").alias("_v"),
        mean(f == "slp", 100.0).alias("_p"),
        mean((f == "slp") & (F.col("lat") == 0), 100.0).alias("_north"),
        mean((f == "slp") & (F.col("lat") == 2), 100.0).alias("_south"),
    )
    return day.select(
        "Date",
        F.round("_u", 4).alias("u850_raw"),
        F.round("_v", 4).alias("v850_raw"),
        F.round(F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v")), 4).alias("wind850_speed_raw"),
        F.round("_p", 2).alias("mslp_raw"),
        F.round(F.col("_north") - F.col("_south"), 2).alias("regional_slp_gradient_raw"),
    )


POINT = "array<double>"
FEATURE = f"""struct<type:string, properties:map<string,string>,
  geometry:struct<type:string, coordinates:string>>"""


def parse_features(collections: DataFrame, column: str = "value") -> DataFrame:
    """GeoJSON FeatureCollections (one JSON text per row) to one row per polygon part.

    Texts of another type give no rows; see :func:`wrong_collections`. Coordinates become
    rings of ``struct<x, y>``; each polygon of a multi-polygon is a row with its number.
    """
    doc = F.from_json(column, f"struct<type:string, features:array<{FEATURE}>>")
    feats = (
        collections.select(doc.alias("d"))
        .where("d.type = 'FeatureCollection'")
        .select(F.posexplode_outer("d.features").alias("feature_no", "f"))
        .where("f is not null")
    )
    coords = F.col("f.geometry.coordinates")
    polygons = F.when(
        F.col("f.geometry.type") == "MultiPolygon",
        F.from_json(coords, f"array<array<array<{POINT}>>>"),
    ).when(
        F.col("f.geometry.type") == "Polygon",
        F.array(F.from_json(coords, f"array<array<{POINT}>>")),
    )
    return feats.select(
        "feature_no",
        F.col("f.properties").alias("properties"),
        F.col("f.geometry.type").alias("geom_type"),
        F.posexplode_outer(polygons).alias("part_no", "_rings"),
    ).select(
        "feature_no", "properties", "geom_type", "part_no",
        F.transform(
            "_rings",
            lambda ring: F.transform(
                ring, lambda pt: F.struct(F.get(pt, F.lit(0)).alias("x"), F.get(pt, F.lit(1)).alias("y"))
            ),
        ).alias("rings"),
    )


def wrong_collections(collections: DataFrame, column: str = "value") -> DataFrame:
    """Rows that are not GeoJSON FeatureCollections."""
    kind = F.get_json_object(column, "$.type")
    return collections.where(F.coalesce(kind, F.lit("")) != "FeatureCollection")


def read_features(spark: SparkSession, path) -> DataFrame:
    """GeoJSON files as features; an absent file or a wrong type is an error."""
    docs = spark.read.text(path, wholetext=True)
    if not wrong_collections(docs).isEmpty():
        raise ValueError(f"not a FeatureCollection: {path}")
    return parse_features(docs)


def read_feature_lines(spark: SparkSession, path) -> DataFrame:
    """Newline-delimited features (one JSON feature per line), splittable at any size."""
    line = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("value"), F.lit("]}"))
    return parse_features(spark.read.text(path).select(line.alias("value")))
