"""Reconciliation of a polygon-side and a registry-side administrative code table.

Polygon side: ``vill_code, block_code, dist_code, district, sub_dist, vill_name,
subdis_typ``. Registry side: ``vill_code, dist_code, dist_census_code, dist_name,
block_code, block_name, body_code, body_name, vill_name``. Codes are strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators.panel import keep_last

# Spelling repairs of block names.
BLOCK_NAME_REPAIRS = {"Kalna - l": "Kalna - I", "Nax<lbari": "Naxalbari"}


def normalise(df: DataFrame, codes: list[str], names: list[str] = ()) -> DataFrame:
    """Clean code columns to text or null and trim name columns to text."""
    return df.withColumns(
        {**{c: S.clean_code(c) for c in codes}, **{n: S.clean_name(n) for n in names}}
    )


def _joined(values: Column) -> Column:
    """Distinct non-empty values of a group in order, as one text."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(values, F.lit("")))), "; ")


def code_membership(left: DataFrame, right: DataFrame, code: str) -> DataFrame:
    """Each distinct code of either side with its row counts on both sides.

    One full outer join of two per-code aggregates answers intersection, both
    differences and matched rows together.
    """
    a = left.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.where(F.col(code).isNotNull()).groupBy(code).agg(
        F.count(F.lit(1)).alias("right_rows")
    )
    return a.join(b, code, "full").fillna(0, ["left_rows", "right_rows"])


def match_stats(left: DataFrame, right: DataFrame, code: str) -> DataFrame:
    """One row of key counts: nulls, distinct, matched, one-sided, matched rows."""
    rows = (
        left.select(F.lit(0).alias("side"), F.col(code).alias("c"))
        .unionByName(right.select(F.lit(1).alias("side"), F.col(code).alias("c")))
        .agg(
            F.count_if((F.col("side") == 0) & F.col("c").isNull()).alias("left_null"),
            F.count_if((F.col("side") == 1) & F.col("c").isNull()).alias("right_null"),
            F.count_if(F.col("side") == 0).alias("left_total"),
        )
    )
    l, r = F.col("left_rows") > 0, F.col("right_rows") > 0
    codes = code_membership(left, right, code).agg(
        F.count_if(l).alias("left_unique"),
        F.count_if(r).alias("right_unique"),
        F.count_if(l & r).alias("matched_codes"),
        F.count_if(l & ~r).alias("left_only_codes"),
        F.count_if(r & ~l).alias("right_only_codes"),
        F.coalesce(F.sum(F.when(r, F.col("left_rows"))), F.lit(0)).alias("left_matched_rows"),
    )
    return (
        codes.withColumn("_rows", rows.select(F.struct(*rows.columns)).scalar())
        .select(*codes.columns, "_rows.*")
        .withColumn("left_unmatched_rows", F.col("left_total") - F.col("left_matched_rows"))
    )


def village_facts(registry: DataFrame) -> DataFrame:
    """Per registry village: number of rows and of distinct bodies."""
    return (
        registry.where(F.col("vill_code").isNotNull())
        .groupBy("vill_code")
        .agg(
            F.count(F.lit(1)).alias("registry_rows"),
            F.countDistinct("body_code").alias("n_bodies"),
        )
    )


def classify_rows(polygons: DataFrame, registry: DataFrame) -> DataFrame:
    """Add the class of each polygon row, checked in this order.

    UNMATCHED: no code or not registered. ADMINISTRATIVE_MISMATCH: its block is not one
    of the village's blocks. REQUIRES_SPLIT_GEOMETRY: several bodies share the village.
    Otherwise SAFE_TO_DISSOLVE. Rows without a code skip the joins, so a large share of
    nulls does not meet in one task; block membership is an equality join on the pair.
    """
    pairs = registry.where(
        F.col("vill_code").isNotNull() & F.col("block_code").isNotNull()
    ).select("vill_code", "block_code").distinct().withColumn("_same_block", F.lit(True))
    coded = (
        polygons.where(F.col("vill_code").isNotNull())
        .join(village_facts(registry), "vill_code", "left")
        .join(pairs, ["vill_code", "block_code"], "left")
        .withColumn(
            "row_class",
            F.when(F.col("registry_rows").isNull(), "UNMATCHED")
            .when(F.col("_same_block").isNull(), "ADMINISTRATIVE_MISMATCH")
            .when(F.col("n_bodies") > 1, "REQUIRES_SPLIT_GEOMETRY")
            .otherwise("SAFE_TO_DISSOLVE"),
        )
        .drop("_same_block")
    )
    uncoded = polygons.where(F.col("vill_code").isNull()).withColumn(
        "row_class", F.lit("UNMATCHED")
    )
    return coded.unionByName(uncoded, allowMissingColumns=True)


def class_samples(classified: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """First ``k`` rows of each class; Spark keeps k per input partition before shuffling."""
    rank = F.row_number().over(Window.partitionBy("row_class").orderBy(*order))
    return classified.withColumn("sample_no", rank).where(F.col("sample_no") <= k)


def duplicate_cases(polygons: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry villages with several rows: their names, bodies and geometry case."""
    dup = (
        registry.where(F.col("vill_code").isNotNull())
        .groupBy("vill_code")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            _joined(F.col("vill_name")).alias("village_names"),
            _joined(F.col("dist_name")).alias("districts"),
            _joined(F.col("block_name")).alias("blocks"),
            F.countDistinct("body_code").alias("n_bodies"),
            _joined(F.col("body_code")).alias("body_codes"),
            _joined(F.col("body_name")).alias("body_names"),
        )
        .where(F.col("_rows") > 1)
        .drop("_rows")
    )
    shapes = polygons.where(F.col("vill_code").isNotNull()).groupBy("vill_code").agg(
        F.count(F.lit(1)).alias("geometry_count")
    )
    n = F.coalesce("geometry_count", F.lit(0))
    return dup.join(shapes, "vill_code", "left").withColumns(
        {
            "geometry_count": n,
            "case": F.when(n > 1, "A: several geometries")
            .when(n == 1, "B: one geometry, several bodies")
            .otherwise("C: no geometry"),
        }
    )


def first_names(df: DataFrame, code: str, name: str, order: list[str]) -> DataFrame:
    """The first non-null name per code, under an explicit order."""
    named = df.where(F.col(code).isNotNull() & F.col(name).isNotNull())
    return named.groupBy(code).agg(F.min_by(name, F.struct(*order)).alias(name))


def name_differences(left: DataFrame, right: DataFrame, code: str, left_name: str, right_name: str) -> DataFrame:
    """Codes on both sides whose names differ beyond case and blanks."""
    return left.join(right, code).where(~S.same_text(left_name, right_name)).select(
        code, left_name, right_name
    )


def block_pairs(polygons: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First block name per block code on both sides (polygon side: CD blocks only)."""
    cd = polygons.where(S.is_text("subdis_typ", "CD_BLOCK"))
    left = first_names(cd, "block_code", "sub_dist", ["sub_dist"]).withColumnRenamed(
        "sub_dist", "polygon_name"
    )
    right = first_names(registry, "block_code", "block_name", ["block_name"]).withColumnRenamed(
        "block_name", "registry_name"
    )
    return left, right


def align_on_alternate(polygons: DataFrame, registry: DataFrame) -> DataFrame:
    """Polygon district codes matched to the registry's census code."""
    left = first_names(polygons, "dist_code", "district", ["district"])
    right = first_names(registry, "dist_census_code", "dist_name", ["dist_name"])
    return left.join(
        right, left["dist_code"] == right["dist_census_code"], "left"
    ).select("dist_code", "district", "dist_name")


def safe_rows(polygons: DataFrame, registry: DataFrame) -> DataFrame:
    """Polygon rows whose village is registered exactly once and in the same block,
    with the registry's hierarchy attributes.

    A village of one row has one value of each attribute, so every attribute is picked on
    its own and those that nobody asks for are neither shuffled nor sorted.
    """
    attributes = {
        "reg_dist_code": "dist_code", "reg_dist_name": "dist_name",
        "reg_dist_census_code": "dist_census_code", "reg_block_code": "block_code",
        "reg_block_name": "block_name", "body_code": "body_code", "body_name": "body_name",
    }
    once = (
        registry.where(F.col("vill_code").isNotNull())
        .groupBy("vill_code")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.any_value(c).alias(name) for name, c in attributes.items()],
        )
        .where(F.col("_rows") == 1)
        .drop("_rows")
    )
    return polygons.join(once, "vill_code").where(
        F.col("block_code") == F.col("reg_block_code")
    )


def dissolve_summary(rows: DataFrame, keys: list[str], box: list[str] | None = None,
                     area: str | None = None) -> DataFrame:
    """One row per unit: number of member rows, joint bounding box and total area."""
    aggs = [F.count(F.lit(1)).alias("village_count")]
    if box:
        x0, x1, y0, y1 = box
        aggs += [F.min(x0).alias("min_x"), F.max(x1).alias("max_x"),
                 F.min(y0).alias("min_y"), F.max(y1).alias("max_y")]
    if area:
        aggs.append(F.sum(area).alias("area"))
    return rows.groupBy(*keys).agg(*aggs)


def dissolve_parts(rows: DataFrame, keys: list[str], geometry: str, **kwargs) -> DataFrame:
    """One row per member polygon carrying its unit's summary.

    A unit is the set of its parts; they are not gathered into one value, so a unit
    that owns a large share of the polygons needs no large row.
    """
    return rows.select(*keys, geometry).join(dissolve_summary(rows, keys, **kwargs), keys)


def block_units(polygons: DataFrame) -> DataFrame:
    """CD-block units with repaired names and their village counts."""
    cd = polygons.where(S.is_text("subdis_typ", "CD_BLOCK")).withColumn(
        "sub_dist", S.replace_values("sub_dist", BLOCK_NAME_REPAIRS)
    )
    return dissolve_summary(cd, ["dist_code", "district", "block_code", "sub_dist"])


def multi_parent_units(df: DataFrame, unit: str, parent: str) -> DataFrame:
    """Units that span more than one parent."""
    return (
        df.groupBy(unit)
        .agg(F.countDistinct(parent).alias("parents"))
        .where(F.col("parents") > 1)
    )


def coverage_summary(units: DataFrame) -> DataFrame:
    """Per district: distinct blocks, distinct bodies and villages of derived units."""
    return units.groupBy("reg_dist_name").agg(
        F.countDistinct("reg_block_code").alias("blocks"),
        F.countDistinct("body_code").alias("bodies"),
        F.sum("village_count").alias("villages"),
    )


def missing_units(registry: DataFrame, polygons: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """Registered bodies without a derived unit, with counts and the likely reason.

    NO_SURVEY_GEOMETRY: no village has a polygon. FULLY_EXCLUDED_MULTI_GP: all have
    one and all are shared between bodies. ADMINISTRATIVE_MISMATCH: none absent or
    shared, some in another block. Otherwise OTHER. Without ``derived`` the units are those
    of the safe rows (see :func:`safe_rows`).

    Both sides are reduced to distinct codes first, stacked, and meet once per village:
    what is shared, surveyed, in the same block or safe are windows over one shuffle. A
    village then has a row per body and block, however often its rows are repeated.
    """
    names = ["dist_code", "dist_name", "block_name"]
    listed = registry.groupBy("vill_code", "body_code", "block_code", *names).agg(
        F.count(F.lit(1)).alias("_n"), F.min("body_name").alias("body_name")
    )
    surveyed = (
        polygons.where(F.col("vill_code").isNotNull())
        .groupBy("vill_code", "block_code")
        .agg(F.lit(True).alias("_survey"))
    )
    village = Window.partitionBy("vill_code")
    pair = Window.partitionBy("vill_code", "block_code")
    coded = F.col("vill_code").isNotNull()
    rows = (
        listed.unionByName(surveyed, allowMissingColumns=True)
        .withColumns(
            {
                "_rows": F.when(coded, F.sum("_n").over(village)),
                "present": F.coalesce(coded & F.max("_survey").over(village), F.lit(False)),
                "same_block": F.coalesce(
                    coded & F.col("block_code").isNotNull() & F.max("_survey").over(pair), F.lit(False)
                ),
            }
        )
        .where(F.col("_n").isNotNull() & (F.col("body_code") != "0"))
        .withColumn("safe", F.coalesce((F.col("_rows") == 1) & F.col("same_block"), F.lit(False)))
    )
    members = rows.groupBy("body_code", "vill_code").agg(
        F.coalesce(F.min_by("same_block", "block_code"), F.lit(False)).alias("same_block"),
        F.max(F.coalesce(F.col("_rows") > 1, F.lit(False))).alias("shared"),
        F.max("present").alias("present"), F.max("safe").alias("safe"),
        F.min("body_name").alias("body_name"),
        F.collect_set(F.struct("block_code", *names)).alias("_places"),
    )

    def joined(column: str) -> Column:
        values = F.transform("_all", lambda p: F.nullif(p[column], F.lit("")))
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(values))), "; ")

    places = F.flatten(F.collect_set("_places"))
    units = members.groupBy("body_code").agg(
        F.min("body_name").alias("body_name"), places.alias("_all"),
        F.count(F.lit(1)).alias("num_villages"),
        F.count_if("present").alias("num_in_survey"),
        F.count_if("shared").alias("num_shared"),
        F.count_if("safe").alias("num_safe"),
        F.count_if(F.col("present") & ~F.col("shared") & ~F.col("same_block")).alias(
            "num_block_mismatch"
        ),
    )
    # one set of places, not one per column: a group is cheap to open and the order is kept
    lists = ("dist_code", "dist_name", "block_code", "block_name")
    units = units.select(
        "body_code", "body_name", *[joined(c).alias(f"{c}s") for c in lists],
        *[c for c in units.columns if c.startswith("num_")],
    )
    if derived is None:
        lost = units.where("num_safe = 0")
    else:
        known = derived.where(F.col("body_code") != "0").select("body_code").distinct()
        lost = units.join(known, "body_code", "left_anti")
    absent = F.col("num_villages") - F.col("num_in_survey")
    all_shared = (F.col("num_shared") == F.col("num_villages")) & (absent == 0)
    return lost.withColumns(
        {
            "num_absent": absent,
            "is_exclusively_split": all_shared,
            "has_any_safe": F.col("num_safe") > 0,
            "classification": F.when(F.col("num_in_survey") == 0, "NO_SURVEY_GEOMETRY")
            .when(all_shared, "FULLY_EXCLUDED_MULTI_GP")
            .when(
                (F.col("num_block_mismatch") > 0) & (F.col("num_shared") == 0) & (absent == 0),
                "ADMINISTRATIVE_MISMATCH",
            )
            .otherwise("OTHER"),
        }
    )


# Reasons of a missing unit.
MISSING_CLASSES = (
    "NO_SURVEY_GEOMETRY", "FULLY_EXCLUDED_MULTI_GP", "ADMINISTRATIVE_MISMATCH", "OTHER",
)


def count_matrix(df: DataFrame, row: str, column: str, values) -> DataFrame:
    """Group by category count matrix with a row total."""
    out = df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return out.withColumn("total", total)


def unique_units(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """One row per canonical block id, the first under ``order``."""
    return keep_last(
        df.withColumn("canonical_id", S.canonical_block_id(id_col)),
        ["canonical_id"],
        *[F.col(c) for c in order],
    )


def children_of(units: DataFrame, parent: str, name: str) -> DataFrame:
    """Units under one parent, compared without case and outer blanks; null parents are
    nobody's children."""
    return units.where(F.lower(F.trim(parent)) == name.strip().lower())
