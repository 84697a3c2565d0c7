"""Polygons, spatial checks and registry reconciliation."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators import geo as G
from panelwright.operators import quality as Q
from panelwright.operators import registry as R

RINGS = "id string, geom_type string, rings array<array<struct<x:double,y:double>>>"
UNIT = [(88.0, 23.0), (89.0, 23.0), (89.0, 24.0), (88.0, 24.0), (88.0, 23.0)]


def ccw(a, b, c):
    v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (v > 0) - (v < 0)


def crossings(ring):
    edges = list(zip(ring, ring[1:]))
    n = 0
    for i in range(len(edges)):
        for j in range(i + 1, len(edges)):
            (a, b), (c, d) = edges[i], edges[j]
            n += ccw(a, b, c) * ccw(a, b, d) < 0 and ccw(c, d, a) * ccw(c, d, b) < 0
    return n


def test_self_intersections_equal_all_pairs(spark):
    rng = random.Random(5)
    rings = {}
    for k, points in enumerate((4, 5, 8, 20, 60, 120)):
        pts = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(points)]
        rings[f"r{k}"] = [*pts, pts[0]]
    # a long thin ring whose edges share few cells
    comb = [(float(i), 0.0 if i % 2 else 1.0) for i in range(200)]
    rings["comb"] = [*comb, (199.0, -5.0), (0.0, -5.0), comb[0]]
    df = spark.createDataFrame([(k, "Polygon", [v]) for k, v in rings.items()], RINGS)
    # a star: every edge spans the ring, yet it is placed only in the cells it passes
    star = [(math.cos(2.4 * i), math.sin(2.4 * i)) for i in range(151)]
    rings["star"] = [*star, star[0]]
    df = spark.createDataFrame([(k, "Polygon", [v]) for k, v in rings.items()], RINGS)
    conflicts = G.edge_conflicts(df, "id", "rings").groupBy("id").count().collect()
    got = {r["id"]: r["count"] for r in conflicts}
    cells = G._cells(G.segments(df.where("id = 'star'"), "id", "rings"), "id").count()
    assert cells < 151 * 3 * 13
    for k, ring in rings.items():
        assert got.get(k, 0) == crossings(ring), k


def test_measures(spark):
    hole = [(88.25, 23.25), (88.5, 23.25), (88.5, 23.5), (88.25, 23.5), (88.25, 23.25)]
    df = spark.createDataFrame(
        [("unit", "Polygon", [UNIT]), ("turned", "Polygon", [UNIT[::-1]]), ("holed", "Polygon", [UNIT, hole])], RINGS
    )
    cx, cy = G.centroid(F.col("rings"))
    got = {r["id"]: r for r in df.select("id", G.polygon_area(F.col("rings")).alias("a"), cx.alias("x"), cy.alias("y")).collect()}
    assert got["unit"]["a"] == 1.0 and (got["unit"]["x"], got["unit"]["y"]) == (88.5, 23.5)
    assert got["turned"]["a"] == 1.0 and got["turned"]["x"] == 88.5
    assert got["holed"]["a"] == pytest.approx(1 - 1 / 16)
    assert got["holed"]["x"] == pytest.approx((88.5 - 88.375 / 16) / (1 - 1 / 16), abs=1e-5)


def test_geometry_problem_kinds(spark):
    bow = [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    flat = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 0.0)]
    df = spark.createDataFrame(
        [
            ("good", "Polygon", [UNIT]), ("bow", "Polygon", [bow]), ("flat", "Polygon", [flat]),
            ("null", "Polygon", None), ("point", "Point", [UNIT]), ("empty", "Polygon", []),
            ("open", "Polygon", [UNIT[:4]]), ("kindless", None, [UNIT]),
        ],
        RINGS,
    )
    got = {r["id"]: r["problem"] for r in G.geometry_problems(df, "id", "geom_type", "rings").collect()}
    assert got == {
        "bow": "self_intersection", "flat": "zero_area", "null": "null_geometry", "point": "wrong_type",
        "empty": "empty_geometry", "open": "open_ring", "kindless": "wrong_type",
    }
    outside = {r["id"] for r in G.outside_region(df, "id", "rings").collect()}
    assert {"bow", "flat"} <= outside and "good" not in outside


def test_identifier_checks_and_summary(spark):
    df = spark.createDataFrame(
        [("1", "d1", "b1", "p1"), ("2", "d2", "b1", "p1"), ("3", None, " ", "p3")],
        "row string, district_id string, block_id string, panchayat_id string",
    )
    blanks = Q.blank_identifiers(df, "row", ["district_id", "block_id", "panchayat_id"])
    assert {(r["row"], r["property"]) for r in blanks.collect()} == {("3", "district_id"), ("3", "block_id")}
    dup = Q.duplicate_rows(df, ["panchayat_id"])
    assert [(r["panchayat_id"], r["copies"]) for r in dup.collect()] == [("p1", 2)]
    conflict = Q.parent_conflicts(df, "block_id", "district_id")
    assert [(r["block_id"], r["parents"]) for r in conflict.collect()] == [("b1", 2)]
    summary = {r["check"]: r["status"] for r in Q.check_summary({"a": blanks, "b": blanks.where("false")}).collect()}
    assert summary == {"a": "FAILED", "b": "PASSED"}


def test_duplicate_copies_are_whole_rows(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z"), (None, 1, "u"), (None, 1, "u"), ("b", None, "v")]
    df = spark.createDataFrame(rows, "k string, n int, text string")
    got = Q.duplicate_copies(df, ["k", "n"])
    assert got.columns == ["k", "n", "text", "copies"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        map(str, [(*r, 2) for r in rows if r[2] in "xyu"]))
    assert Q.duplicate_copies(df, ["text", "n"]).count() == 2
    assert Q.duplicate_copies(df.limit(0), ["k"]).count() == 0


def test_column_order_check(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    got = {r["column"]: (r["expected"], r["actual"]) for r in Q.column_order_check(df, ["a", "c", "b"]).collect()}
    assert got == {"a": (0, 0), "c": (1, None), "b": (2, 1)}


def test_calendar_gaps_ignore_duplicates(spark):
    import datetime as dt

    d = dt.date
    df = spark.createDataFrame(
        [("a", d(2024, 1, 1)), ("a", d(2024, 1, 1)), ("a", d(2024, 1, 2)), ("a", d(2024, 1, 6)), ("b", d(2024, 1, 1))],
        "District string, Date date",
    )
    got = [tuple(r) for r in Q.calendar_gaps(df).collect()]
    assert got == [("a", d(2024, 1, 3), d(2024, 1, 5), 3)]
    row = Q.null_and_duplicate_counts(df, ["Date"]).first()
    assert (row["total_rows"], row["duplicate_keys"], row["extra_copies"]) == (5, 1, 1)


def test_code_cleaning(spark):
    df = spark.createDataFrame([(" 12.0 ",), ("NaN",), ("None",), ("",), (None,), ("02167N003",), ("1.05",)], "c string")
    assert [r["c"] for r in df.select(S.clean_code("c").alias("c")).collect()] == ["12", None, None, None, None, "02167N003", "1.05"]
    ids = spark.createDataFrame([("blk_0171",), ("blk_02167N003",), ("blk_000",), ("x",)], "c string")
    assert [r["c"] for r in ids.select(S.canonical_block_id("c").alias("c")).collect()] == ["blk_171", "blk_02167N003", "blk_0", "x"]


POLY = "vill_code string, block_code string, dist_code string, district string, sub_dist string, vill_name string, subdis_typ string"
REG = "vill_code string, dist_code string, dist_census_code string, dist_name string, block_code string, block_name string, body_code string, body_name string, vill_name string"


@pytest.fixture(scope="module")
def sides(spark):
    def p(v, b, name="N", typ="CD_Block"):
        return (v, b, "331", "Dist", name, f"V{v}", typ)

    def r(v, b, body, name="Block One"):
        return (v, "9", "331", "Dist A", b, name, body, f"Body {body}", f"V{v}")

    polygons = spark.createDataFrame(
        [
            p("1", "b1", "block one"), p("1", "b1"), p("2", "b9"), p("3", "b1"), p("4", "b1"), p(None, "b1"),
            p("99", "b1", "Nax<lbari", "CD_BLOCK"), p("98", "b7", "town", "Municipality"), p("6", "b2", "Naxalbari"),
        ],
        POLY,
    )
    registry = spark.createDataFrame(
        [
            r("1", "b1", "g1"), r("2", "b1", "g2"), r("3", "b1", "g3"), r("3", "b1", "g4"), r("4", "b1", "g1"),
            r("5", "b1", "g5"), r("6", "b2", "g6", "Nak"), r("7", "b2", "g4"), r("7", "b2", "g4"), r("8", "b2", "0"),
        ],
        REG,
    )
    return polygons, registry


def test_row_classes(sides):
    got = sorted((r["vill_code"] or "", r["row_class"]) for r in R.classify_rows(*sides).collect())
    assert got == [
        ("", "UNMATCHED"), ("1", "SAFE_TO_DISSOLVE"), ("1", "SAFE_TO_DISSOLVE"), ("2", "ADMINISTRATIVE_MISMATCH"),
        ("3", "REQUIRES_SPLIT_GEOMETRY"), ("4", "SAFE_TO_DISSOLVE"), ("6", "SAFE_TO_DISSOLVE"),
        ("98", "UNMATCHED"), ("99", "UNMATCHED"),
    ]


def test_match_stats(sides):
    row = R.match_stats(*sides, "vill_code").first().asDict()
    assert row == {
        "left_null": 1, "right_null": 0, "left_total": 9, "left_unique": 7, "right_unique": 8, "matched_codes": 5,
        "left_only_codes": 2, "right_only_codes": 3, "left_matched_rows": 6, "left_unmatched_rows": 3,
    }


def test_duplicate_cases(sides):
    got = {r["vill_code"]: (r["n_bodies"], r["body_codes"], r["geometry_count"], r["case"][0]) for r in R.duplicate_cases(*sides).collect()}
    assert got == {"3": (2, "g3; g4", 1, "B"), "7": (1, "g4", 0, "C")}


def test_safe_rows_dissolve_and_missing(sides):
    polygons, registry = sides
    safe = R.safe_rows(polygons, registry)
    units = R.dissolve_summary(safe, ["reg_dist_name", "reg_block_code", "body_code"])
    assert {(r["body_code"], r["village_count"]) for r in units.collect()} == {("g1", 3), ("g6", 1)}
    parts = R.dissolve_parts(safe, ["body_code"], "vill_name")
    assert sorted((r["body_code"], r["village_count"]) for r in parts.collect()) == [("g1", 3)] * 3 + [("g6", 1)]
    got = {r["body_code"]: r["classification"] for r in R.missing_units(registry, polygons, units).collect()}
    assert got == {
        "g2": "ADMINISTRATIVE_MISMATCH", "g3": "FULLY_EXCLUDED_MULTI_GP", "g4": "OTHER", "g5": "NO_SURVEY_GEOMETRY",
    }


def test_names_and_blocks(sides):
    polygons, registry = sides
    left, right = R.block_pairs(polygons, registry)
    got = R.name_differences(left, right, "block_code", "polygon_name", "registry_name").collect()
    assert {r["block_code"] for r in got} == {"b1", "b2"}
    units = {(r["block_code"], r["sub_dist"]) for r in R.block_units(polygons).collect()}
    assert ("b1", "Naxalbari") in units and all(b != "b7" for b, _ in units)
    row = R.align_on_alternate(polygons, registry).first()
    assert (row["district"], row["dist_name"]) == ("Dist", "Dist A")
