"""Registries, area units and polygons read from the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import registry as R
from panelwright.plans.tables import table


VILLAGE_TYPES = ["PROMO", "ECONOMY", "LARGE", "SMALL", "MEDIUM", "STANDARD"]


def villages(spark, sf_dir):
    """Orders as villages: a size from 1 to 50, one of six types and a district mark."""
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    types = F.array(*map(F.lit, VILLAGE_TYPES))
    return table(spark, sf_dir, "orders").select(
        key.alias("village"),
        (key % 50 + 1).cast("int").alias("size"),
        F.get(types, (owner % 6).cast("int")).alias("type"),
        (owner % 25).alias("mark"),
    )


def registry_rows(spark, sf_dir):
    """Villages (orders) and their bodies (a supplier's fortieth) from all lines."""
    pairs = (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("village"), "l_suppkey")
        .distinct()
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_acctbal", "s_nationkey"
    )
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey"
    )
    region = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), "r_name"
    )
    joined = pairs.join(supplier.join(nation.join(region, "n_regionkey"), "s_nationkey"), "l_suppkey")
    body = F.col("l_suppkey") * 100 + F.col("village") % 40
    raw = joined.select(
        F.col("l_suppkey"),
        F.concat(F.lit(" "), F.col("village").cast("string"), F.lit(".0")).alias("vill_code"),
        F.concat(F.lit("V"), F.col("village")).alias("vill_name"),
        F.concat(F.lit("D"), F.col("n_regionkey")).alias("dist_code"),
        (F.col("n_regionkey") + 100).cast("string").alias("dist_census_code"),
        F.col("r_name").alias("dist_name"),
        F.col("s_nationkey").cast("string").alias("block_code"),
        F.col("n_name").alias("block_name"),
        F.when(F.col("s_acctbal") < 0, "0").otherwise(body.cast("string")).alias("body_code"),
        F.concat_ws("-", "s_name", F.col("village") % 40).alias("body_name"),
    )
    return R.normalise(
        raw, ["vill_code", "dist_code", "dist_census_code", "block_code", "body_code"],
        ["vill_name", "dist_name", "block_name", "body_name"],
    )


def polygon_rows(spark, sf_dir):
    """Villages as polygon rows: missing and dotted codes, second copies, shifted blocks."""
    first = (
        registry_rows(spark, sf_dir)
        .groupBy(F.col("vill_code").cast("bigint").alias("village"))
        .agg(F.min_by(F.col("block_code").cast("int"), "l_suppkey").alias("_block"))
    )
    size = F.col("size")
    block = F.coalesce(
        F.when(size > 45, (F.col("_block") + 1) % 25).otherwise(F.col("_block")), size % 25
    )
    key = F.col("village").cast("string")
    rows = villages(spark, sf_dir).join(first, "village", "left").withColumn("_b", block)
    rows = rows.withColumn(
        "copy", F.explode(F.when(F.col("type") == "PROMO", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    )
    raw = rows.select(
        (F.col("village") * 10 + F.col("copy")).alias("poly_id"),
        F.when(F.col("mark") == 13, "NaN")
        .when(F.col("type") == "ECONOMY", F.concat(key, F.lit(".0")))
        .otherwise(key).alias("vill_code"),
        F.concat(F.lit("V"), key).alias("vill_name"),
        F.col("_b").cast("string").alias("block_code"),
        (F.col("_b") % 5 + 100).cast("string").alias("dist_code"),
        F.concat(F.lit("District "), F.col("_b") % 5).alias("district"),
        F.when(size == 7, "Kalna - l").otherwise(F.concat(F.lit("nation_"), F.col("_b"))).alias("sub_dist"),
        F.when(F.col("type") == "LARGE", "CD_BLOCK").when(F.col("type") == "SMALL", "Municipality")
        .otherwise("CD_Block ").alias("subdis_typ"),
        size.alias("size"),
    )
    return R.normalise(raw, ["vill_code", "block_code", "dist_code"])


AREA_SQL = """
vil as (select o_orderkey as village, o_orderkey % 50 + 1 as size, o_custkey % 25 as mark,
    ['PROMO', 'ECONOMY', 'LARGE', 'SMALL', 'MEDIUM', 'STANDARD'][o_custkey % 6 + 1] as type from orders),
reg as (select distinct l_suppkey, cast(l_orderkey as varchar) as vill_code, 'V' || l_orderkey as vill_name,
    'D' || n_regionkey as dist_code, cast(n_regionkey + 100 as varchar) as dist_census_code, r_name as dist_name,
    cast(s_nationkey as varchar) as block_code, n_name as block_name,
    case when s_acctbal < 0 then '0' else cast(l_suppkey * 100 + l_orderkey % 40 as varchar) end as body_code,
    s_name || '-' || (l_orderkey % 40) as body_name, l_orderkey as village
  from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey
  join region on r_regionkey = n_regionkey),
fb as (select village, arg_min(cast(block_code as int), l_suppkey) as b0 from reg group by 1),
pl as (select *, coalesce(case when size > 45 then (b0 + 1) % 25 else b0 end, size % 25) as b
  from vil left join fb using (village)),
poly as (select village * 10 + copy as poly_id,
    case when mark = 13 then null else cast(village as varchar) end as vill_code,
    'V' || village as vill_name, cast(b as varchar) as block_code, cast(b % 5 + 100 as varchar) as dist_code,
    'District ' || (b % 5) as district,
    case when size = 7 then 'Kalna - l' else 'nation_' || b end as sub_dist,
    case when type = 'LARGE' then 'CD_BLOCK' when type = 'SMALL' then 'Municipality' else 'CD_Block ' end as subdis_typ,
    size
  from (select *, unnest(case when type = 'PROMO' then [1, 2] else [1] end) as copy from pl)),
vf as (select vill_code, count(*) as registry_rows, count(distinct body_code) as n_bodies from reg group by 1),
cls as (select p.*, case when vf.vill_code is null then 'UNMATCHED'
    when not exists (select 1 from reg r where r.vill_code = p.vill_code and r.block_code = p.block_code) then 'ADMINISTRATIVE_MISMATCH'
    when n_bodies > 1 then 'REQUIRES_SPLIT_GEOMETRY' else 'SAFE_TO_DISSOLVE' end as row_class
  from poly p left join vf on vf.vill_code = p.vill_code),
safe as (select p.poly_id, p.vill_code, p.size, r.dist_code as reg_dist_code, r.dist_name as reg_dist_name,
    r.block_code as reg_block_code, r.block_name as reg_block_name, r.body_code, r.body_name
  from poly p join reg r on r.vill_code = p.vill_code and r.block_code = p.block_code
  join vf on vf.vill_code = p.vill_code where vf.registry_rows = 1)"""


def part_shapes(spark, sf_dir):
    """One polygon per part: squares, a few with holes, and every kind of defect."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    x0 = (F.lit(86) + F.col("p_partkey") % 3).cast("double")
    y0 = (F.lit(22) + F.col("p_partkey") % 5).cast("double")
    x0 = F.when(F.col("p_size") == 8, F.lit(80.0)).otherwise(x0)
    p = p.withColumns({"x": x0, "y": y0, "w": F.col("p_size") / 64.0})
    x, y, w = F.col("x"), F.col("y"), F.col("w")

    def ring(*points):
        return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in points])

    square = [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    q, h = w / 4.0, w / 2.0
    hole = [(x + q, y + q), (x + h, y + q), (x + h, y + h), (x + q, y + h), (x + q, y + q)]
    size = F.col("p_size")
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    rings = (
        F.when(size == 1, F.lit(None).cast("array<array<struct<x:double,y:double>>>"))
        .when(size == 3, none)
        .when(size == 4, F.array(ring(*square[:4])))
        .when(size == 5, F.array(ring((x, y), (x + w, y + w), (x + w, y), (x, y + w), (x, y))))
        .when(size == 6, F.array(ring((x, y), (x + w, y), (x, y))))
        .when(size == 7, F.array(ring(*square), ring(*hole)))
        .otherwise(F.array(ring(*square)))
    )
    kind = F.when(size == 2, "Point").otherwise("Polygon")
    return p.select("p_partkey", "p_size", "p_name", "x", "y", "w", kind.alias("geom_type"), rings.alias("rings"))


DEFECTS = [
    None, "hole_outside", "self_intersection", "self_intersection", "self_intersection",
    "self_intersection", None, "self_intersection",
]


def defect_shapes(spark, sf_dir):
    """A polygon per part, in turn: hole inside, hole outside, vertex on an edge, vertex met
    twice, hole across the outline, spike, hole touching the outline in one point, bow-tie."""
    def ring(*points):
        return F.array(
            *[
                F.struct((F.lit(x) + F.col("x")).alias("x"), (F.lit(y) + F.col("y")).alias("y"))
                for x, y in (*points, points[0])
            ]
        )

    square = ring((0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0))
    shapes = [
        F.array(square, ring((1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0))),
        F.array(square, ring((9.0, 1.0), (10.0, 1.0), (10.0, 2.0), (9.0, 2.0))),
        F.array(ring((0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (4.0, 0.0), (0.0, 8.0))),
        F.array(ring((0.0, 0.0), (4.0, 4.0), (8.0, 0.0), (8.0, 8.0), (4.0, 4.0), (0.0, 8.0))),
        F.array(square, ring((6.0, 1.0), (10.0, 1.0), (10.0, 2.0), (6.0, 2.0))),
        F.array(ring((0.0, 0.0), (8.0, 0.0), (12.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0))),
        F.array(square, ring((0.0, 4.0), (2.0, 3.0), (2.0, 5.0))),
        F.array(ring((0.0, 0.0), (8.0, 8.0), (8.0, 0.0), (0.0, 7.0))),
    ]
    p = table(spark, sf_dir, "part").select(
        "p_partkey",
        (F.col("p_partkey") % 97).cast("double").alias("x"),
        (F.col("p_partkey") % 89).cast("double").alias("y"),
    )
    which = F.element_at(F.array(*shapes), (F.col("p_partkey") % len(shapes) + 1).cast("int"))
    return p.select("p_partkey", F.lit("Polygon").alias("geom_type"), which.alias("rings"))


SHAPES_SQL = """
sh as (select p_partkey, p_size, p_name, case when p_size = 8 then 80e0 else cast(86 + p_partkey % 3 as double) end as x,
  cast(22 + p_partkey % 5 as double) as y, p_size / 64e0 as w from part)"""


def month_forecasts(spark, sf_dir):
    """Head probabilities per supplier and month: shares of its lines, some unknown."""
    def share(test):
        return F.count_if(test) / F.count(F.lit(1))

    c = F.col
    lines = table(spark, sf_dir, "lineitem")
    out = lines.groupBy(
        c("l_suppkey").alias("District"), F.date_trunc("month", "l_shipdate").cast("date").alias("month_start")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(c("l_shipdate").cast("date")).alias("reference_date"),
        share(c("l_returnflag") != "R").alias("p_onset"),
        share(c("l_quantity") >= 38).alias("p_false_onset"),
        share(c("l_quantity") <= 25).alias("p_dry_spell_5d"),
        share(c("l_quantity") <= 15).alias("p_severe_break_7d"),
        share(c("l_linenumber") >= 6).alias("p_heavy_rain"),
        share(c("l_linestatus") == "O").alias("p_revival"),
    )
    n = c("n")
    return out.withColumns(
        {
            "p_onset": F.when(n >= 2, c("p_onset")),
            "p_heavy_rain": F.when(n != 5, c("p_heavy_rain")),
            "p_revival": F.when(n == 6, F.lit(float("nan"))).otherwise(c("p_revival")),
        }
    )


FORECAST_SQL = """
fc as (select l_suppkey as district, cast(date_trunc('month', l_shipdate) as date) as ms, count(*) as n,
    min(cast(l_shipdate as date)) as rd,
    case when count(*) >= 2 then count(*) filter (l_returnflag <> 'R') / count(*) end as p_onset,
    count(*) filter (l_quantity >= 38) / count(*) as p_false_onset,
    count(*) filter (l_quantity <= 25) / count(*) as p_dry_spell_5d,
    count(*) filter (l_quantity <= 15) / count(*) as p_severe_break_7d,
    case when count(*) <> 5 then count(*) filter (l_linenumber >= 6) / count(*) end as p_heavy_rain,
    case when count(*) <> 6 then count(*) filter (l_linestatus = 'O') / count(*) end as p_revival
  from lineitem group by 1, 2)"""
