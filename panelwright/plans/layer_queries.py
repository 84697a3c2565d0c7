"""Forecast layers with geometry, response views and reference-system checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators import forecast as O
from panelwright.operators import geo as G
from panelwright.operators import views as V
from panelwright.plans.area_tables import SHAPES_SQL, part_shapes
from panelwright.plans.catalog import query, tidy
from panelwright.plans.forecast_queries import (
    HEADLINE_SQL,
    LAYER_SQL,
    crosswalk,
    customer_layer,
    region_forecasts,
    risk_level_sql,
)
from panelwright.plans.source_queries import new_folder
from panelwright.plans.tables import table
from panelwright.sources import tables as T
from panelwright.sources import text as X


def valid_shapes(spark, sf_dir):
    return part_shapes(spark, sf_dir).where("p_size > 6")


SHAPE_SQL = SHAPES_SQL + """,
vs as (select *, case when p_size = 7 then w * w * 15 / 16 else w * w end as a,
  case when p_size = 7 then w * w * (x + w / 2) - w * w / 16 * (x + 3 * w / 8) else w * w * (x + w / 2) end as mx,
  case when p_size = 7 then w * w * (y + w / 2) - w * w / 16 * (y + 3 * w / 8) else w * w * (y + w / 2) end as my from sh where p_size > 6)"""


@query("unit_geometries", f"""
with {SHAPE_SQL}
select p_partkey % 97 as unit, count(*) as parts, cast(round(sum(a) * 1e6) as bigint) as area,
  cast(round(sum(mx) / sum(a) * 1e4) as bigint) as lon, cast(round(sum(my) / sum(a) * 1e4) as bigint) as lat,
  cast(round(min(x) * 64) as bigint) as min_x, cast(round(max(x + w) * 64) as bigint) as max_x,
  cast(round(min(y) * 64) as bigint) as min_y, cast(round(max(y + w) * 64) as bigint) as max_y from vs group by 1
""")
def unit_geometries(spark, sf_dir):
    """Units of several polygons, some with holes: area, centroid and box from their parts."""
    parts = valid_shapes(spark, sf_dir).withColumn("unit", F.col("p_partkey") % 97)
    out = G.unit_geometry(parts, ["unit"], digits=9)
    return tidy(
        out.select(
            "unit", "parts", S.scaled("area", 6).alias("area"),
            S.scaled("centroid_lon", 4).alias("lon"), S.scaled("centroid_lat", 4).alias("lat"),
            *[F.round(F.col(c) * 64).cast("bigint").alias(c) for c in ("min_x", "max_x", "min_y", "max_y")],
        )
    )


@query("polygon_lines_read_back", f"""
with {SHAPE_SQL}
select p_partkey, p_name, case when p_size = 7 then 2 else 1 end as rings, case when p_size = 7 then 10 else 5 end as points,
  cast(round(a * 1e6) as bigint) as area from vs
""")
def polygon_lines_read_back(spark, sf_dir):
    """Polygons as lines of GeoJSON, written, read back and measured."""
    folder = new_folder(spark)
    T.write_features(valid_shapes(spark, sf_dir), folder, ["p_partkey", "p_name"], "rings")
    back = X.read_feature_lines(spark, folder)
    return tidy(
        back.select(
            F.element_at("properties", F.lit("p_partkey")).cast("bigint").alias("p_partkey"),
            F.element_at("properties", F.lit("p_name")).alias("p_name"),
            F.size("rings").alias("rings"), F.size(F.flatten("rings")).alias("points"),
            S.scaled(G.polygon_area(F.col("rings")), 6).alias("area"),
        )
    )


def _square():
    """The polygon of a customer: a square whose place and side follow from the key."""
    key = F.col("c_custkey")
    x, y = F.lit(86.0) + key % 300 * 0.01, F.lit(22.0) + key % 200 * 0.01
    side = F.lit(0.01) + key % 3 * 0.005
    corners = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    return F.array(F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners]))


def panchayat_layer(spark, sf_dir):
    """Customers as units with forecast, geometry and centroid."""
    rows = customer_layer(spark, sf_dir).withColumn("rings", _square())
    lon, lat = G.centroid(F.col("rings"))
    return rows.withColumns(
        {
            "aggregation_level": F.lit("PANCHAYAT"), "unit_id": S.unit_id("gp_", "c_custkey"),
            "centroid_lon": lon, "centroid_lat": lat,
        }
    )


def block_layer(spark, sf_dir):
    """Nations as blocks: forecast of their region, geometry from all their customers."""
    units = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("block_code"), F.col("n_name").alias("unit_name"),
        F.col("n_regionkey").cast("string").alias("region_code"),
    )
    layer = O.inherit_down(
        O.valid_units(units, "block_code", "unit_name"), crosswalk(spark, sf_dir),
        region_forecasts(spark, sf_dir), child_district="region_code", child_block="block_code",
    )
    parts = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("block_code"), _square().alias("rings")
    )
    shaped = layer.join(G.unit_geometry(parts, ["block_code"], digits=9), "block_code")
    return O.headline_advisory(O.risk_columns(shaped)).withColumns(
        {"aggregation_level": F.lit("BLOCK"), "unit_id": S.unit_id("blk_", "block_code")}
    )


LAYERS_SQL = LAYER_SQL + f""",
sq as (select c_custkey, c_nationkey, 86 + c_custkey % 300 * 0.01e0 as x, 22 + c_custkey % 200 * 0.01e0 as y, 0.01e0 + c_custkey % 3 * 0.005e0 as s from customer),
bp as (select c_nationkey, sum(s * s * (x + s / 2)) / sum(s * s) as lon, sum(s * s * (y + s / 2)) / sum(s * s) as lat from sq group by 1),
bl as (select distinct n_nationkey, n_name, rg.* from nation join rg on r_regionkey = n_regionkey
  where n_nationkey <> 0 and (r_name <> 'ASIA' or n_nationkey in (2, 12)))"""


def _layer_columns(prefix_id: str, id_: str, block: str, level: str, source: str) -> str:
    return f"""select '{level}' as aggregation_level, '{prefix_id}' || {id_} as unit_id, 'blk_' || {block} as block_id, r_name as district,
  cast(round(lon * 1e6) as bigint) as lon, cast(round(lat * 1e6) as bigint) as lat,
  cast(round(p_onset * 1e6) as bigint) as onset, cast(round(round(p_heavy_rain * 100, 2) * 100) as bigint) as heavy_pct,
  'NONE_DISTRICT_INHERITED' as method, {risk_level_sql()} as risk_level, {HEADLINE_SQL} as headline from {source}"""


@query("forecast_layers", f"""
with {LAYERS_SQL}
{_layer_columns('gp_', 'ly.c_custkey', 'ly.c_nationkey', 'PANCHAYAT', '(select ly.*, x + s / 2 as lon, y + s / 2 as lat from ly join sq on sq.c_custkey = ly.c_custkey) ly')}
union all
{_layer_columns('blk_', 'n_nationkey', 'n_nationkey', 'BLOCK', '(select * from bl join bp on bp.c_nationkey = bl.n_nationkey) bl')}
""")
def forecast_layers(spark, sf_dir):
    """Both layers with their centroids: panchayats of one polygon, blocks of many."""
    def record(layer):
        return layer.select(
            "aggregation_level", "unit_id", S.unit_id("blk_", "block_code").alias("block_id"),
            F.col("District").alias("district"), S.scaled("centroid_lon", 6).alias("lon"),
            S.scaled("centroid_lat", 6).alias("lat"), S.scaled("p_onset", 6).alias("onset"),
            S.scaled(F.round(F.col("p_heavy_rain") * 100, 2), 2).alias("heavy_pct"),
            F.col("downscaling_method").alias("method"), "risk_level",
            F.col("advisory_headline").alias("headline"),
        )

    return tidy(record(panchayat_layer(spark, sf_dir)).unionByName(record(block_layer(spark, sf_dir))))


def response_layer(spark, sf_dir):
    """The panchayat layer under the property names that the views read."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("block_code"), F.col("n_name").alias("block_name")
    )
    key = F.col("c_custkey")
    return panchayat_layer(spark, sf_dir).join(nation, "block_code").withColumns(
        {
            "district_name": F.col("District"), "district_id": F.concat(F.lit("d"), F.col("region_code")),
            "block_id": S.unit_id("blk_0", "block_code"), "district_lgd_code": F.lit(""),
            "block_lgd_code": F.col("block_code"),
            "gp_lgd_code": F.when(key % 5 == 0, "").otherwise(key.cast("string")),
            "geometry": F.when(
                key % 7 != 0, F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates"))
            ),
            "forecast_reference_date": F.date_add(F.to_date(F.lit("2001-07-01")), (key % 40).cast("int")),
            "data_as_of": F.lit(None).cast("date"), "model_version": F.lit("v2"),
        }
    )


@query("response_views", f"""
with {LAYERS_SQL}, q as (select ly.*, n_name, date '2001-07-01' + cast(c_custkey % 40 as int) as rd from ly join nation on n_nationkey = c_nationkey)
select 'gp_' || c_custkey as id, 'blk_0' || c_nationkey as block, n_name as block_name, 'd' || r_regionkey as district_id,
  case when c_custkey % 5 <> 0 then cast(c_custkey as varchar) end as gp_code, case when c_custkey % 7 <> 0 then 'Polygon' else '' end as geometry_type,
  cast(c_custkey % 7 <> 0 as bigint) as listed_geometry, cast(rd as varchar) as data_as_of,
  case when rd > date '2001-07-20' then 'UNAVAILABLE' when date_diff('day', rd, date '2001-07-20') <= 14 then 'CURRENT' else 'STALE' end as freshness,
  cast(round(p_onset * 1e6) as bigint) as onset, {risk_level_sql()} as overall, {HEADLINE_SQL} as headline from q
""")
def response_views(spark, sf_dir):
    """The unit, list and forecast responses of every unit, as the JSON that a client reads."""
    layer = response_layer(spark, sf_dir)
    whole = V.unit_view(layer).select("unit_id", F.to_json("response").alias("unit"))
    listed = V.unit_list_view(layer).select("unit_id", F.to_json("response").alias("item"))
    now = F.to_date(F.lit("2001-07-20"))
    forecast = V.forecast_view(layer, now).select("unit_id", F.to_json("response").alias("forecast"))

    def read(column, path):
        return F.get_json_object(column, f"$.{path}")

    rows = whole.join(listed, "unit_id").join(forecast, "unit_id")
    return tidy(
        rows.select(
            read("unit", "panchayat_id").alias("id"), read("unit", "block_id").alias("block"),
            read("item", "block_name").alias("block_name"), read("forecast", "district_id").alias("district_id"),
            read("unit", "gp_lgd_code").alias("gp_code"),
            read("unit", "geometry_metadata.geometry_type").alias("geometry_type"),
            read("item", "geometry.type").isNotNull().alias("listed_geometry"),
            read("forecast", "data_as_of").alias("data_as_of"),
            read("forecast", "data_freshness_status").alias("freshness"),
            S.scaled(read("forecast", "onset_probability").cast("double"), 6).alias("onset"),
            read("forecast", "risk_levels.overall").alias("overall"),
            read("forecast", "advisory.headline").alias("headline"),
        )
    )


@query("district_and_block_views", f"""
with {LAYERS_SQL}
select 'district' as kind, 'd' || any_value(r_regionkey) as id, r_name as name, replace(r_name, ' ', '_') as key from ly group by r_name
union all
select 'block', 'blk_' || c_nationkey, n_name, cast(count(*) as varchar) from ly join nation on n_nationkey = c_nationkey group by 2, 3
""")
def district_and_block_views(spark, sf_dir):
    """Supported districts, and the blocks with the number of their units."""
    layer = response_layer(spark, sf_dir)
    districts = V.district_view(layer).select(
        F.lit("district").alias("kind"), F.col("district_id").alias("id"), F.col("district_name").alias("name"),
        F.col("meteorological_key").alias("key"),
    )
    units = layer.groupBy(S.canonical_block_id("block_id").alias("block_id")).agg(
        F.count(F.lit(1)).cast("string").alias("key")
    )
    blocks = V.block_view(layer).join(units, "block_id").select(
        F.lit("block").alias("kind"), F.col("block_id").alias("id"), F.col("block_name").alias("name"), "key"
    )
    return tidy(districts.unionByName(blocks))


CRS_CASES = [
    (None, "[[[88.1, 22.5], [88.2, 22.5], [88.2, 22.6], [88.1, 22.5]]]", None),
    ("urn:ogc:def:crs:OGC:1.3:CRS84", "[[[-88.1, 22.5], [1e2, 2.25e1], [88.2, 22.6], [-88.1, 22.5]]]", None),
    ("EPSG:32645", "[[[500000, 2500000], [500100, 2500000], [500100, 2500100], [500000, 2500000]]]", "crs_mismatch"),
    ("EPSG:4326", None, "no_features"),
    ("EPSG:4326", "[[[22.5, 95.0], [22.6, 95.0], [22.6, 95.1], [22.5, 95.0]]]", "swapped_axes"),
    ("WGS 84", "[[[500000, 2500000], [500100, 2500000], [500100, 2500100], [500000, 2500000]]]", "axis_out_of_bounds"),
]


@query("crs_checks", f"""
select s_suppkey, crs, problem from (select s_suppkey, s_suppkey % {len(CRS_CASES)} as k from supplier) join (values {', '.join(
    f"({i}, '{crs or 'EPSG:4326'}', '{problem}')" for i, (crs, _, problem) in enumerate(CRS_CASES) if problem)}) c(k, crs, problem) using (k)
""")
def crs_checks(spark, sf_dir):
    """Reference system and axis bounds of one collection per supplier, six kinds in turn."""
    def text(crs, coordinates):
        named = f'"crs": {{"type": "name", "properties": {{"name": "{crs}"}}}}, ' if crs else ""
        feature = (
            '{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": ' + coordinates + "}}"
            if coordinates else ""
        )
        return F.lit('{"type": "FeatureCollection", ' + named + '"features": [' + feature + "]}")

    texts = F.array(*[text(crs, c) for crs, c, _ in CRS_CASES])
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.get(texts, (F.col("s_suppkey") % len(CRS_CASES)).cast("int")).alias("value")
    )
    return tidy(G.crs_problems(rows, "s_suppkey"))
