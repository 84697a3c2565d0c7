"""CSV and Parquet readers, and the writers of every output."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.panel import with_zone_of_file

# Columns of a zone file, as DDL types.
ZONE_FILE = {
    "Date": "date", "Zone": "string", "District": "string", "Latitude": "double",
    "Longitude": "double", "Rainfall_Observed_mm": "double", "Tmax_C": "double",
    "Tmin_C": "double", "Relative_Humidity_pct": "double", "Solar_Radiation_MJm2": "double",
    "MJO_Phase": "int", "MJO_Amplitude": "double", "Nino34_Anomaly": "double",
    "Dry_Spell_Days_Streak": "int", "Rolling_Rainfall_7d_mm": "double",
    "Rolling_Rainfall_30d_mm": "double", "Target_Crops": "string",
}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


def read_zone_files(
    spark: SparkSession, files: dict[str, str], extra: dict[str, tuple[str, str]]
) -> DataFrame:
    """Union zone CSV files; ``extra`` names each file's own last column and type.

    ``files`` maps zone id to path. Columns that a file lacks are null after the union.
    """
    out = None
    for zone, path in files.items():
        columns = dict(ZONE_FILE)
        if zone in extra:
            name, kind = extra[zone]
            columns[name] = kind
        frame = spark.read.csv(path, header=True, schema=ddl(columns), enforceSchema=False)
        frame = frame.withColumn("zone_id", F.lit(zone))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def read_zone_folder(spark: SparkSession, folder: str, zones: dict[str, str], columns=None) -> DataFrame:
    """One scan over a folder of equal CSV files, tagged by file name."""
    frame = spark.read.csv(folder, header=True, schema=ddl(columns or ZONE_FILE))
    return with_zone_of_file(frame, zones)


def read_table(spark: SparkSession, parquet: str, csv: str, schema: str) -> DataFrame:
    """Parquet when it exists, else CSV with the given schema; other errors are raised."""
    try:
        return spark.read.parquet(parquet)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.read.csv(csv, header=True, schema=schema)


def read_registry(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Registry export with title lines and a header line: all columns as text.

    ``names`` are the header names. A row has as many fields as there are names, quoted
    separators not counted; title lines have fewer, also when they hold separators. The
    header line is the one that repeats all names. Every other line is a row, whatever
    columns it leaves empty.
    """
    fields = F.from_csv("value", ", ".join(f"`{n}` string" for n in names))
    separators = F.length(F.regexp_replace("value", r'"[^"]*"|[^,"]', ""))
    lines = spark.read.text(path).where(separators == len(names) - 1)
    header = F.lit(True)
    for name in names:
        header = header & F.coalesce(F.trim(F.col(f"r.`{name}`")) == name, F.lit(False))
    return lines.select(fields.alias("r")).where(~header).select("r.*")


def read_elevation(spark: SparkSession, path: str) -> DataFrame:
    """Elevation per unit; codes stay text because they have zeros and letters."""
    return spark.read.csv(path, header=True, schema="code string, elevation_m double")


# --- writers -------------------------------------------------------------------

def write_panel(df: DataFrame, path: str, ts: str = "Date", csv: str | None = None) -> None:
    """Parquet partitioned by year; rows of a year spread over several files.

    The output folder must be new: a derived table never overwrites its input.
    """
    out = df.withColumn("year", F.year(ts))
    out.write.mode("errorifexists").partitionBy("year").parquet(path)
    if csv:
        df.write.mode("errorifexists").option("header", True).csv(csv)


def write_report(df: DataFrame, path: str) -> None:
    """Audit and log tables as CSV with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric and run-summary tables as JSON lines."""
    df.write.mode("errorifexists").json(path)


def feature_json(properties: list[str], rings: Column | str | None = None) -> Column:
    """One GeoJSON Feature text per row from property columns and polygon rings."""
    props = F.struct(*properties)
    if rings is None:
        return F.to_json(
            F.struct(F.lit("Feature").alias("type"), props.alias("properties"))
        )
    r = F.col(rings) if isinstance(rings, str) else rings
    coords = F.transform(r, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    geometry = F.when(
        r.isNotNull(),
        F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")),
    )
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            props.alias("properties"),
            geometry.alias("geometry"),
        )
    )


def write_features(df: DataFrame, path: str, properties: list[str], rings: str | None) -> None:
    """Newline-delimited GeoJSON features, one file per task."""
    df.select(feature_json(properties, rings).alias("value")).write.mode(
        "errorifexists"
    ).text(path)


def parse_nested(column: str, schema: str) -> Column:
    """A nested value stored as JSON text, null when it does not parse."""
    return F.from_json(column, schema)
