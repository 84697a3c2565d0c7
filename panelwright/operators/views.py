"""Response views of a forecast layer: what a client asks for, as nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators.forecast import HEADS

# Support status of units whose geometry is verified.
SUPPORTED = "SUPPORTED_VERIFIED_SAFE_LAYER"
RISKS = {
    "overall": "risk_level", "heavy_rain": "heavy_rain_risk", "severe_break": "severe_break_risk",
    "dry_spell": "dry_spell_risk", "false_onset": "false_onset_risk",
}


def district_view(layer: DataFrame) -> DataFrame:
    """Supported districts: one row each, with the key of the model tables."""
    named = layer.where(F.coalesce(F.col("district_name"), F.lit("")) != "")
    return named.groupBy("district_name").agg(
        F.min("district_id").alias("district_id")
    ).withColumn("meteorological_key", S.model_key("district_name"))


def block_view(layer: DataFrame) -> DataFrame:
    """Supported blocks: one row per canonical id, the first feature of each."""
    canonical = layer.withColumn("block_id", S.canonical_block_id("block_id"))
    kept = ["block_name", "district_id", "district_name", "block_lgd_code", "centroid_lat", "centroid_lon", "risk_level"]
    return canonical.groupBy("block_id").agg(
        F.min_by(F.struct(*kept), F.struct("district_name", "block_name", "unit_id")).alias("first")
    ).select("block_id", "first.*")


def find_unit(layer: DataFrame, unit_id: str) -> DataFrame:
    return layer.where(F.col("unit_id") == unit_id)


def units_of_block(layer: DataFrame, block_id: str) -> DataFrame:
    """Units of one block, by its id as it stands in the layer."""
    return layer.where(F.col("block_id") == block_id)


def _identity() -> list[Column]:
    return [
        F.col("unit_id").alias("panchayat_id"), F.col("unit_name").alias("panchayat_name"),
        F.col("block_id"), F.col("block_name"), F.col("district_id"), F.col("district_name"),
    ]


def unit_view(layer: DataFrame) -> DataFrame:
    """One nested response per unit: identity, codes (blank as null), geometry and its facts."""
    codes = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("district_lgd_code", "block_lgd_code", "gp_lgd_code")]
    facts = F.struct(
        F.coalesce(F.col("geometry.type"), F.lit("")).alias("geometry_type"), "centroid_lat", "centroid_lon"
    )
    return layer.select(
        "unit_id",
        F.struct(
            *_identity(), *codes, F.col("geometry"), facts.alias("geometry_metadata"),
            F.lit(SUPPORTED).alias("support_status"),
        ).alias("response"),
    )


def unit_list_view(layer: DataFrame) -> DataFrame:
    """The short form of a unit, as it stands in lists."""
    identity = [c for c, name in zip(_identity(), ("id", "name", "block", "block_name", "district_id", "district"))
                if name != "district_id"]
    return layer.select(
        "unit_id",
        F.struct(
            *identity, F.nullif(F.col("gp_lgd_code"), F.lit("")).alias("gp_lgd_code"),
            "centroid_lat", "centroid_lon", "geometry",
        ).alias("response"),
    )


def forecast_view(layer: DataFrame, now: Column, prefix: str = "p_") -> DataFrame:
    """The forecast of a unit: probabilities, risks, advisory, versions and freshness."""
    reference = F.col("forecast_reference_date")
    return layer.select(
        "unit_id",
        F.struct(
            *_identity(), reference, F.coalesce("data_as_of", reference).alias("data_as_of"),
            S.freshness(reference, now).alias("data_freshness_status"),
            *[F.col(f"{prefix}{h}").alias(f"{h}_probability") for h in HEADS],
            F.struct(*[F.col(c).alias(n) for n, c in RISKS.items()]).alias("risk_levels"),
            F.struct(
                F.col("advisory_headline").alias("headline"), F.col("recommended_action").alias("action")
            ).alias("advisory"),
            F.struct(
                F.col("model_version").alias("engine"), F.col("model_version").alias("forecast_artifact")
            ).alias("model_versions"),
        ).alias("response"),
    )
