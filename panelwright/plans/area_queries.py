"""Queries for registry reconciliation, polygons and spatial validation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators import geo as G
from panelwright.operators import panel as P
from panelwright.operators import quality as Q
from panelwright.operators import registry as R
from panelwright.plans.area_tables import (
    AREA_SQL,
    DEFECTS,
    SHAPES_SQL,
    defect_shapes,
    part_shapes,
    polygon_rows,
    registry_rows,
)
from panelwright.plans.catalog import query, tidy
from panelwright.plans.tables import table
from panelwright.sources import text as X


def sides(spark, sf_dir):
    return polygon_rows(spark, sf_dir), registry_rows(spark, sf_dir)


@query("registry_match_stats", f"""
with {AREA_SQL}, l as (select vill_code, count(*) as c from poly where vill_code is not null group by 1),
r as (select vill_code, count(*) as c from reg group by 1),
j as (select l.c as lc, r.c as rc from l full join r using (vill_code))
select (select count(*) from poly where vill_code is null) as left_null, 0 as right_null,
  (select count(*) from poly) as left_total, count(lc) as left_unique, count(rc) as right_unique,
  count(*) filter (lc > 0 and rc > 0) as matched_codes, count(*) filter (rc is null) as left_only_codes,
  count(*) filter (lc is null) as right_only_codes, cast(sum(lc) filter (rc > 0) as bigint) as left_matched_rows,
  cast((select count(*) from poly) - sum(lc) filter (rc > 0) as bigint) as left_unmatched_rows from j
""")
def registry_match_stats(spark, sf_dir):
    return tidy(R.match_stats(*sides(spark, sf_dir), "vill_code"))


@query("code_set_comparison", f"""
with {AREA_SQL}, l as (select block_code as code, count(*) as c from poly group by 1),
r as (select block_code as code, count(*) as c from reg group by 1)
select code as block_code, coalesce(l.c, 0) as left_rows, coalesce(r.c, 0) as right_rows from l full join r using (code)
""")
def code_set_comparison(spark, sf_dir):
    return tidy(R.code_membership(*sides(spark, sf_dir), "block_code"))


@query("registry_row_classes", f"""
with {AREA_SQL} select poly_id, vill_code, block_code, row_class from cls
""")
def registry_row_classes(spark, sf_dir):
    return tidy(
        R.classify_rows(*sides(spark, sf_dir)).select("poly_id", "vill_code", "block_code", "row_class")
    )


@query("registry_class_samples", f"""
with {AREA_SQL} select row_class, poly_id, sample_no from (
  select *, row_number() over (partition by row_class order by poly_id) as sample_no from cls) where sample_no <= 5
""")
def registry_class_samples(spark, sf_dir):
    out = R.class_samples(R.classify_rows(*sides(spark, sf_dir)), ["poly_id"])
    return tidy(out.select("row_class", "poly_id", "sample_no"))


@query("registry_duplicate_cases", f"""
with {AREA_SQL}, g as (select vill_code, count(*) as c from poly where vill_code is not null group by 1)
select r.vill_code, string_agg(distinct vill_name, '; ' order by vill_name) as village_names,
  string_agg(distinct dist_name, '; ' order by dist_name) as districts,
  string_agg(distinct block_name, '; ' order by block_name) as blocks, count(distinct body_code) as n_bodies,
  string_agg(distinct body_code, '; ' order by body_code) as body_codes,
  string_agg(distinct body_name, '; ' order by body_name) as body_names,
  coalesce(max(g.c), 0) as geometry_count,
  case when coalesce(max(g.c), 0) > 1 then 'A: several geometries' when coalesce(max(g.c), 0) = 1
    then 'B: one geometry, several bodies' else 'C: no geometry' end as "case"
from reg r left join g on g.vill_code = r.vill_code group by 1 having count(*) > 1
""")
def registry_duplicate_cases(spark, sf_dir):
    return tidy(R.duplicate_cases(*sides(spark, sf_dir)))


@query("registry_block_name_differences", f"""
with {AREA_SQL},
l as (select block_code, min(sub_dist) as polygon_name from poly where upper(trim(subdis_typ)) = 'CD_BLOCK' group by 1),
r as (select block_code, min(block_name) as registry_name from reg group by 1)
select block_code, polygon_name, registry_name from l join r using (block_code)
where lower(trim(polygon_name)) <> lower(trim(registry_name))
""")
def registry_block_name_differences(spark, sf_dir):
    left, right = R.block_pairs(*sides(spark, sf_dir))
    return tidy(R.name_differences(left, right, "block_code", "polygon_name", "registry_name"))


@query("registry_district_alignment", f"""
with {AREA_SQL}, l as (select dist_code, min(district) as district from poly group by 1),
r as (select dist_census_code, min(dist_name) as dist_name from reg group by 1)
select l.dist_code, district, dist_name from l left join r on r.dist_census_code = l.dist_code
""")
def registry_district_alignment(spark, sf_dir):
    return tidy(R.align_on_alternate(*sides(spark, sf_dir)))


@query("safe_village_attributes", f"""
with {AREA_SQL} select poly_id, vill_code, reg_dist_code, reg_dist_name, reg_block_code, reg_block_name, body_code, body_name from safe
""")
def safe_village_attributes(spark, sf_dir):
    return tidy(
        R.safe_rows(*sides(spark, sf_dir)).select(
            "poly_id", "vill_code", "reg_dist_code", "reg_dist_name", "reg_block_code",
            "reg_block_name", "body_code", "body_name",
        )
    )


UNIT_KEYS = ["reg_dist_name", "reg_block_code", "body_code"]


def derived_units(spark, sf_dir):
    return R.dissolve_summary(
        R.safe_rows(*sides(spark, sf_dir)), UNIT_KEYS,
        box=["size", "size", "poly_id", "poly_id"], area="size",
    )


@query("dissolved_units", f"""
with {AREA_SQL}
select reg_dist_name, reg_block_code, body_code, count(*) as village_count, min(size) as min_x, max(size) as max_x,
  min(poly_id) as min_y, max(poly_id) as max_y, cast(sum(size) as bigint) as area from safe group by 1, 2, 3
""")
def dissolved_units(spark, sf_dir):
    return tidy(derived_units(spark, sf_dir))


@query("dissolved_parts", f"""
with {AREA_SQL}
select reg_dist_name, reg_block_code, body_code, poly_id, count(*) over (partition by reg_dist_name, reg_block_code, body_code) as village_count from safe
""")
def dissolved_parts(spark, sf_dir):
    return tidy(R.dissolve_parts(R.safe_rows(*sides(spark, sf_dir)), UNIT_KEYS, "poly_id"))


@query("unit_coverage_by_district", f"""
with {AREA_SQL}, u as (select reg_dist_name, reg_block_code, body_code, count(*) as c from safe group by 1, 2, 3)
select reg_dist_name, count(distinct reg_block_code) as blocks, count(distinct body_code) as bodies, cast(sum(c) as bigint) as villages from u group by 1
""")
def unit_coverage_by_district(spark, sf_dir):
    return tidy(R.coverage_summary(derived_units(spark, sf_dir)))


@query("villages_in_several_blocks", f"""
with {AREA_SQL} select vill_code, count(distinct block_code) as parents from reg group by 1 having count(distinct block_code) > 1
""")
def villages_in_several_blocks(spark, sf_dir):
    return tidy(R.multi_parent_units(registry_rows(spark, sf_dir), "vill_code", "block_code"))


MISSING_SQL = AREA_SQL + """,
lost as (select * from reg where body_code <> '0' and body_code not in (select body_code from safe where body_code <> '0')),
mem as (select body_code, vill_code, min(block_code) as mb from lost group by 1, 2),
fl as (select m.*, exists (select 1 from poly p where p.vill_code = m.vill_code) as pres,
   (select registry_rows from vf where vf.vill_code = m.vill_code) > 1 as shared,
   exists (select 1 from poly p where p.vill_code = m.vill_code and p.block_code = m.mb) as sameb,
   exists (select 1 from safe s where s.vill_code = m.vill_code) as sf from mem m),
cn as (select body_code, count(*) as num_villages, count(*) filter (pres) as num_in_survey, count(*) filter (shared) as num_shared,
   count(*) filter (sf) as num_safe, count(*) filter (pres and not shared and not sameb) as num_block_mismatch from fl group by 1),
nm as (select body_code, min(body_name) as body_name, string_agg(distinct dist_code, '; ' order by dist_code) as dist_codes,
   string_agg(distinct dist_name, '; ' order by dist_name) as dist_names, string_agg(distinct block_code, '; ' order by block_code) as block_codes,
   string_agg(distinct block_name, '; ' order by block_name) as block_names from lost group by 1),
mu as (select nm.*, cn.* exclude (body_code), num_villages - num_in_survey as num_absent,
   cast(num_shared = num_villages and num_in_survey = num_villages as bigint) as is_exclusively_split,
   cast(num_safe > 0 as bigint) as has_any_safe,
   case when num_in_survey = 0 then 'NO_SURVEY_GEOMETRY'
     when num_shared = num_villages and num_in_survey = num_villages then 'FULLY_EXCLUDED_MULTI_GP'
     when num_block_mismatch > 0 and num_shared = 0 and num_in_survey = num_villages then 'ADMINISTRATIVE_MISMATCH'
     else 'OTHER' end as classification
   from nm join cn using (body_code))"""


def missing(spark, sf_dir):
    polygons, registry = sides(spark, sf_dir)
    return R.missing_units(registry, polygons)


@query("missing_units", f"with {MISSING_SQL} select * from mu")
def missing_units(spark, sf_dir):
    return tidy(missing(spark, sf_dir))


@query("missing_unit_matrix", f"""
with {MISSING_SQL} select dist_names, count(*) filter (classification = 'NO_SURVEY_GEOMETRY') as "NO_SURVEY_GEOMETRY",
 count(*) filter (classification = 'FULLY_EXCLUDED_MULTI_GP') as "FULLY_EXCLUDED_MULTI_GP",
 count(*) filter (classification = 'ADMINISTRATIVE_MISMATCH') as "ADMINISTRATIVE_MISMATCH",
 count(*) filter (classification = 'OTHER') as "OTHER", count(*) as total from mu group by 1
""")
def missing_unit_matrix(spark, sf_dir):
    return tidy(R.count_matrix(missing(spark, sf_dir), "dist_names", "classification", R.MISSING_CLASSES))


@query("cd_block_units", f"""
with {AREA_SQL} select dist_code, district, block_code, case when sub_dist = 'Kalna - l' then 'Kalna - I' else sub_dist end as sub_dist,
 count(*) as village_count from poly where upper(trim(subdis_typ)) = 'CD_BLOCK' group by 1, 2, 3, 4
""")
def cd_block_units(spark, sf_dir):
    return tidy(R.block_units(polygon_rows(spark, sf_dir)))


@query("composite_key_duplicates", f"""
with {AREA_SQL}, u as (select distinct dist_code, district, block_code, sub_dist from poly where upper(trim(subdis_typ)) = 'CD_BLOCK')
select dist_code, block_code, count(*) as copies from u group by 1, 2 having count(*) > 1
""")
def composite_key_duplicates(spark, sf_dir):
    units = R.block_units(polygon_rows(spark, sf_dir))
    return tidy(Q.duplicate_rows(units, ["dist_code", "block_code"]))


@query("value_frequencies", f"""
with {AREA_SQL} select trim(subdis_typ) as subdis_typ, row_class, count(*) as n from cls group by 1, 2
""")
def value_frequencies(spark, sf_dir):
    out = R.classify_rows(*sides(spark, sf_dir))
    return tidy(out.groupBy(S.clean_name("subdis_typ").alias("subdis_typ"), "row_class").agg(F.count(F.lit(1)).alias("n")))


@query("canonical_block_list", """
with c as (select c_custkey, case when c_acctbal < 0 then 'blk_x' || c_nationkey when c_custkey % 2 = 0 then 'blk_0' || c_nationkey else 'blk_' || c_nationkey end as id, c_name from customer),
k as (select *, case when regexp_full_match(id, 'blk_[0-9]+') then 'blk_' || cast(cast(substr(id, 5) as bigint) as varchar) else id end as canonical_id from c)
select canonical_id, c_custkey as first_custkey, c_name as name, cast(regexp_full_match(canonical_id, 'blk_[0-9]+') as bigint) as valid from (
  select *, row_number() over (partition by canonical_id order by c_custkey) as r from k) where r = 1
""")
def canonical_block_list(spark, sf_dir):
    nation = F.col("c_nationkey").cast("string")
    ids = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name",
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("blk_x"), nation))
        .when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("blk_0"), nation))
        .otherwise(S.unit_id("blk_", nation)).alias("block_id"),
    )
    units = R.unique_units(ids, "block_id", ["c_custkey"])
    return tidy(
        units.select(
            "canonical_id", F.col("c_custkey").alias("first_custkey"), F.col("c_name").alias("name"),
            S.valid_unit_id("canonical_id", "blk_").alias("valid"),
        )
    )


# --- polygons ------------------------------------------------------------------------

@query("polygon_measures", f"""
with {SHAPES_SQL}
select p_partkey,
  cast(round(case when p_size = 1 then null when p_size in (3, 5, 6) then 0 when p_size = 4 then (w * x + 2 * w * w) / 2
    when p_size = 7 then w * w - w * w / 16 else w * w end * 1e6) as bigint) as area,
  cast(round(case when p_size in (1, 3, 4, 5, 6) then null when p_size = 7 then (w * w * (x + w / 2) - w * w / 16 * (x + 3 * w / 8)) / (w * w - w * w / 16)
    else x + w / 2 end * 1e5) as bigint) as cx,
  cast(round(case when p_size in (1, 3, 4, 5, 6) then null when p_size = 7 then (w * w * (y + w / 2) - w * w / 16 * (y + 3 * w / 8)) / (w * w - w * w / 16)
    else y + w / 2 end * 1e5) as bigint) as cy,
  cast(round(case when p_size not in (1, 3) then x end * 64) as bigint) as min_x, cast(round(case when p_size not in (1, 3) then x + w end * 64) as bigint) as max_x,
  cast(round(case when p_size not in (1, 3) then y end * 64) as bigint) as min_y,
  cast(round(case when p_size in (1, 3) then null when p_size = 6 then y else y + w end * 64) as bigint) as max_y from sh
""")
def polygon_measures(spark, sf_dir):
    shapes = part_shapes(spark, sf_dir)
    cx, cy = G.centroid(F.col("rings"))
    is_open = F.coalesce(G.is_open(F.col("rings")), F.lit(False))
    x0, x1, y0, y1 = G.bounding_box(F.col("rings"))
    return tidy(
        shapes.select(
            "p_partkey", S.scaled(G.polygon_area(F.col("rings")), 6).alias("area"),
            F.when(~is_open, S.scaled(cx, 5)).alias("cx"), F.when(~is_open, S.scaled(cy, 5)).alias("cy"),
            *[
                F.round(v * 64).cast("bigint").alias(n)
                for n, v in (("min_x", x0), ("max_x", x1), ("min_y", y0), ("max_y", y1))
            ],
        )
    )


PROBLEMS = """case p_size when 1 then 'null_geometry' when 2 then 'wrong_type' when 3 then 'empty_geometry'
  when 4 then 'open_ring' when 5 then 'self_intersection' when 6 then 'zero_area' end"""


@query("polygon_problems", f"""
select p_partkey, {PROBLEMS} as problem from part where p_size between 1 and 6
""")
def polygon_problems(spark, sf_dir):
    return tidy(G.geometry_problems(part_shapes(spark, sf_dir), "p_partkey", "geom_type", "rings"))


@query("polygon_defects", f"""
select p_partkey, problem from (select p_partkey, case p_partkey % {len(DEFECTS)} {' '.join(
    f"when {i} then '{d}'" for i, d in enumerate(DEFECTS) if d)} end as problem from part) where problem is not null
""")
def polygon_defects(spark, sf_dir):
    return tidy(G.geometry_problems(defect_shapes(spark, sf_dir), "p_partkey", "geom_type", "rings"))


# features of several polygons by part number: corners in eighths, and the problem to find
_SQUARE = [(0, 0), (8, 0), (8, 8), (0, 8)]


def _moved(points, x, y):
    return [(a + x, b + y) for a, b in points]


_SMALL = [(0, 0), (2, 0), (2, 2), (0, 2)]
_DIAMOND = [(0, 1), (2, 2), (4, 1), (2, 0)]
MULTI_SHAPES = [
    ([[_SQUARE, _moved(_SMALL, 1, 1)], [_moved(_SMALL, 20, 3)]], None),
    ([[_SQUARE, [(1, 1), (7, 1), (7, 7), (1, 7)], _moved(_SMALL, 3, 3)]], "nested_holes"),
    ([[_SQUARE], [_moved(_SMALL, 2, 2)]], "overlapping_parts"),
    ([[_SQUARE, [(1, 1), (7, 1), (7, 7), (1, 7)]], [_moved(_SMALL, 3, 3)]], None),
    ([[_SQUARE], [_moved(_SQUARE, 4, 4)]], "self_intersection"),
    ([[_SQUARE, _moved(_SMALL, 10, 3)]], "hole_outside"),
    ([[_SQUARE, [(0, 4), (4, 6), (8, 4), (4, 2)]]], "interior_disconnected"),
    ([[_SQUARE], [_moved(_SQUARE, 8, 8)]], None),
    ([[_SQUARE, _moved(_DIAMOND, 0, 3)]], None),
    ([[_SQUARE, _moved(_DIAMOND, 0, 3), _moved(_DIAMOND, 4, 3)]], "interior_disconnected"),
    ([[_SQUARE, [(0, 4), (4, 8), (8, 4), (4, 0)]], [[(2, 4), (4, 6), (6, 4), (4, 2)]]], "interior_disconnected"),
    ([[_SQUARE, [(2, 2), (6, 2), (6, 6), (2, 6)], [(2, 4), (4, 6), (6, 4), (4, 2)]]], "nested_holes"),
    ([[_moved(_SMALL, 3, 3)], [_SQUARE]], "overlapping_parts"),
    ([[_SQUARE], [_SQUARE]], "self_intersection"),
]


def multi_shapes(spark, sf_dir):
    x = (F.col("p_partkey") % 512).cast("double")
    texts = [
        json.dumps([[[[a / 8, b / 8] for a, b in [*ring, ring[0]]] for ring in part] for part in parts])
        for parts, _ in MULTI_SHAPES
    ]
    chosen = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % len(texts)).cast("int"))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", x.alias("x"), F.from_json(chosen, "array<array<array<array<double>>>>").alias("shape")
    )
    return rows.select(
        "p_partkey",
        F.transform("shape", lambda part: F.transform(part, lambda ring: F.transform(
            ring, lambda p: F.struct((p[0] + F.col("x")).alias("x"), p[1].alias("y"))
        ))).alias("parts"),
    )


@query("multipolygon_defects", f"""
select p_partkey, problem from (select p_partkey, case p_partkey % {len(MULTI_SHAPES)} {' '.join(
    f"when {i} then '{d}'" for i, (_, d) in enumerate(MULTI_SHAPES) if d)} end as problem from part) where problem is not null
""")
def multipolygon_defects(spark, sf_dir):
    return tidy(G.multipolygon_problems(multi_shapes(spark, sf_dir), "p_partkey", "parts"))


@query("polygons_outside_region", "select p_partkey from part where p_size = 8")
def polygons_outside_region(spark, sf_dir):
    return tidy(G.outside_region(part_shapes(spark, sf_dir), "p_partkey", "rings"))


def identified(spark, sf_dir):
    """Parts as features with identifiers, some of them missing or blank."""
    return part_shapes(spark, sf_dir).select(
        "p_partkey",
        F.when(F.col("p_size") != 11, F.concat(F.lit("d"), F.col("p_size") % 4)).alias("district_id"),
        F.when(F.col("p_size") == 12, "  ").otherwise(F.concat(F.lit("b"), F.col("p_size"))).alias("block_id"),
        F.col("p_name").alias("panchayat_id"),
    )


@query("identifier_problems", """
select p_partkey, 'district_id' as property from part where p_size = 11
union all select p_partkey, 'block_id' from part where p_size = 12
""")
def identifier_problems(spark, sf_dir):
    return tidy(Q.blank_identifiers(identified(spark, sf_dir), "p_partkey", ["district_id", "block_id", "panchayat_id"]))


@query("duplicate_identifiers", "select p_name as panchayat_id, count(*) as copies from part group by 1 having count(*) > 1")
def duplicate_identifiers(spark, sf_dir):
    return tidy(Q.duplicate_rows(identified(spark, sf_dir), ["panchayat_id"]))


@query("hierarchy_conflicts", """
select l_orderkey, count(distinct l_linestatus) as parents, min(l_linestatus) as first_parent from lineitem
group by 1 having count(distinct l_linestatus) > 1
""")
def hierarchy_conflicts(spark, sf_dir):
    return tidy(Q.parent_conflicts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus"))


@query("spatial_validation_summary", """
with v as (select 'bounding_box' as "check", count(*) filter (p_size = 8) as violations from part
 union all select 'geometry', count(*) filter (p_size between 1 and 6) from part
 union all select 'identifiers', count(*) filter (p_size in (11, 12)) from part
 union all select 'hierarchy', 0)
select "check", violations, case when violations = 0 then 'PASSED' else 'FAILED' end as status from v
""")
def spatial_validation_summary(spark, sf_dir):
    shapes, ids = part_shapes(spark, sf_dir), identified(spark, sf_dir)
    return tidy(
        Q.check_summary(
            {
                "bounding_box": G.outside_region(shapes, "p_partkey", "rings"),
                "geometry": G.geometry_problems(shapes, "p_partkey", "geom_type", "rings"),
                "identifiers": Q.blank_identifiers(ids, "p_partkey", ["district_id", "block_id"]),
                "hierarchy": Q.parent_conflicts(ids, "block_id", "district_id"),
            }
        )
    )


@query("feature_collection_parts", """
select s_suppkey, s_name, part_no, 'MultiPolygon' as geom_type, 4 as points, s_suppkey % 90 + part_no * 2 as min_x, s_suppkey % 90 + part_no * 2 + 1 as max_x
from (select *, unnest([0, 1]) as part_no from supplier)
union all
select c_custkey, c_name, 0, 'Polygon', 4, c_nationkey, c_nationkey + 1 from customer
""")
def feature_collection_parts(spark, sf_dir):
    def corner(x, y):
        return F.concat(F.lit("["), x, F.lit(", "), y, F.lit("]"))

    def ring(x):
        one = x + 1
        return F.concat(
            F.lit("[["), F.concat_ws(", ", corner(x, F.lit(0)), corner(one, F.lit(0)), corner(one, F.lit(1)), corner(x, F.lit(0))), F.lit("]]")
        )

    def collection(key, name, kind, coordinates):
        return F.concat(
            F.lit('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"key": '),
            key, F.lit(', "name": "'), name, F.lit(f'"}}, "geometry": {{"type": "{kind}", "coordinates": '),
            coordinates, F.lit("}}]}"),
        ).alias("value")

    s, c = F.col("s_suppkey"), F.col("c_nationkey")
    texts = table(spark, sf_dir, "supplier").select(
        collection(s, F.col("s_name"), "MultiPolygon",
                   F.concat(F.lit("["), ring(s % 90), F.lit(", "), ring(s % 90 + 2), F.lit("]")))
    ).unionByName(
        table(spark, sf_dir, "customer").select(
            collection(F.col("c_custkey"), F.col("c_name"), "Polygon", ring(c))
        )
    )
    x0, x1, _, _ = G.bounding_box(F.col("rings"))
    return tidy(
        X.parse_features(texts).select(
            F.element_at("properties", F.lit("key")).cast("bigint").alias("s_suppkey"),
            F.element_at("properties", F.lit("name")).alias("s_name"),
            "part_no", "geom_type", F.size(F.get("rings", F.lit(0))).alias("points"),
            x0.cast("bigint").alias("min_x"), x1.cast("bigint").alias("max_x"),
        )
    )


@query("children_of_parent", """
select n_nationkey, n_name from nation join region on r_regionkey = n_regionkey where r_name = 'ASIA'
""")
def children_of_parent(spark, sf_dir):
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    units = table(spark, sf_dir, "nation").join(region, "n_regionkey")
    return tidy(R.children_of(units, "r_name", " Asia ").select("n_nationkey", "n_name"))


@query("units_with_geometry", "select p_partkey from part where p_size not in (1, 3)")
def units_with_geometry(spark, sf_dir):
    return tidy(G.with_geometry(part_shapes(spark, sf_dir), "rings").select("p_partkey"))


@query("deduped_composite_join", """
select s_suppkey, c_custkey from supplier left join (
  select c_nationkey, c_acctbal >= 0 as solvent, c_custkey, row_number() over (
    partition by c_nationkey, c_acctbal >= 0 order by c_acctbal desc, c_custkey) as r from customer) c
  on c_nationkey = s_nationkey and solvent = (s_acctbal >= 0) and r = 1
""")
def deduped_composite_join(spark, sf_dir):
    left = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") >= 0).alias("solvent")
    )
    right = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"),
        (F.col("c_acctbal") >= 0).alias("solvent"),
    )
    out = P.deduped_left_join(
        left, right, ["nation", "solvent"], [F.col("c_acctbal").desc(), F.col("c_custkey")]
    )
    return tidy(out.select("s_suppkey", "c_custkey"))
