"""Readers, parsers and writers on small files."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from panelwright.operators import panel as P
from panelwright.sources import tables as T
from panelwright.sources import text as X


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_daily_index_skips_noise(spark):
    got = X.parse_daily_index(
        lines(
            spark, "RMM values up to real time", "year, month, day, RMM1",
            "   1974     6     1     1.63447     1.20304     5     2.02948     Final_value",
            "1974 6 31 1.0 1.0 5 2.0", "1974 6 2 x 1.0 5 2.0", "1974 6 3 0.5", "74 6 3 1 1 5 2",
        )
    ).collect()
    assert len(got) == 1
    assert got[0]["Date"] == dt.date(1974, 6, 1) and got[0]["MJO_Phase"] == 5
    assert got[0]["MJO_Amplitude"] == pytest.approx(2.02948)


def test_monthly_index_uses_token_nine(spark):
    got = X.parse_monthly_index(
        lines(spark, " YR   MON  NINO1+2  ANOM", "1982   12   24.28   -0.24   25.84    0.17   28.01   -0.21   26.65    0.08", "1982 2 1 2 3 4 5 6 7")
    ).collect()
    assert [(r["year"], r["month"], r["Nino34_Anomaly"], r["available_date"]) for r in got] == [
        (1982, 12, 0.08, dt.date(1983, 1, 1))
    ]


def test_wide_years_and_sentinel(spark):
    got = X.parse_wide_years(
        lines(spark, "1870 2026", "1870  " + "  ".join(["-0.373"] * 11 + ["-9999.000"]), "HadISST1.1 anomaly", "-9999")
    ).orderBy("month").collect()
    assert len(got) == 12 and got[0]["value"] == -0.373 and got[11]["value"] is None


def test_release_lines(spark):
    row = X.parse_releases(lines(spark, "20080728,20080803,0.17", "bad,line,x")).collect()
    assert len(row) == 1 and row[0]["available_date"] == dt.date(2008, 8, 6)


def test_grid_text_with_and_without_level(spark, tmp_path):
    (tmp_path / "uwnd_2020_850hpa.ascii").write_text(
        "Dataset {\n}\n-----\nuwnd.uwnd[3][1][2][3]\n[0][0][0], 3.0, 1.3, 0.125\n[0][0][1], 1, 2, 3\n\ntime[2]\n1, 2\n"
    )
    (tmp_path / "uwnd_2021_850hpa.ascii").write_text("-----\n[59][0], 5.5, 6.5\n")
    got = X.read_grid_text(spark, str(tmp_path)).orderBy("Date", "lat").collect()
    assert [(r["Date"], r["lat"], r["values"]) for r in got] == [
        (dt.date(2020, 1, 1), 0, [3.0, 1.3, 0.125]),
        (dt.date(2020, 1, 1), 1, [1.0, 2.0, 3.0]),
        (dt.date(2021, 3, 1), 0, [5.5, 6.5]),
    ]


def test_grid_means(spark):
    def field(*values):
        return spark.createDataFrame(
            [(dt.date(2020, 1, 1), i, [v] * 3) for i, v in enumerate(values)], "Date date, lat int, values array<double>"
        )

    row = X.grid_daily_means(field(3.0, 3.0, 3.0), field(4.0, 4.0, 4.0), field(100900.0, 101000.0, 100500.0)).first()
    assert row["wind850_speed_raw"] == 5.0
    assert row["mslp_raw"] == 1008.0 and row["regional_slp_gradient_raw"] == 4.0


def test_feature_collection_and_rejection(spark, tmp_path):
    good = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"id": "a", "n": 1}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
            {"type": "Feature", "properties": {"id": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},
            {"type": "Feature", "properties": {"id": "c"}, "geometry": None},
        ],
    }
    (tmp_path / "good.geojson").write_text(json.dumps(good))
    got = X.read_features(spark, str(tmp_path / "good.geojson")).collect()
    assert sorted((r["properties"]["id"], r["part_no"]) for r in got if r["rings"]) == [("a", 0), ("b", 0), ("b", 1)]
    assert [r["rings"] for r in got if r["properties"]["id"] == "c"] == [None]
    (tmp_path / "bad.geojson").write_text('{"type": "Feature"}')
    with pytest.raises(ValueError):
        X.read_features(spark, str(tmp_path / "bad.geojson"))
    with pytest.raises(Exception):
        X.read_features(spark, str(tmp_path / "absent.geojson"))


def test_zone_files_union(spark, tmp_path):
    base = list(T.ZONE_FILE)
    values = ["2024-06-01", "z", "d", "1", "2", "3", "30", "20", "80", "18", "4", "1.5", "0.2", "0", "3", "3", "rice"]
    for zone, extra in (("one", None), ("two", "Drought_Stress_Index")):
        head = base + ([extra] if extra else [])
        (tmp_path / f"{zone}.csv").write_text(",".join(head) + "\n" + ",".join(values + (["0.7"] if extra else [])) + "\n")
    df = T.read_zone_files(
        spark, {z: str(tmp_path / f"{z}.csv") for z in ("one", "two")}, {"two": ("Drought_Stress_Index", "double")}
    )
    got = P.with_defaults(df, {"Drought_Stress_Index": 0.0, "Waterlogging_Risk_Index": 0.0}).orderBy("zone_id").collect()
    assert [(r["zone_id"], r["Drought_Stress_Index"], r["Waterlogging_Risk_Index"]) for r in got] == [("one", 0.0, 0.0), ("two", 0.7, 0.0)]


def test_zone_of_file_name(spark, tmp_path):
    for z in ("x", "y"):
        (tmp_path / f"{z}_2020.csv").write_text("a\n1\n")
    df = T.read_zone_folder(spark, str(tmp_path), {"x_2020.csv": "zone x", "y_2020.csv": "zone y"}, {"a": "int"})
    assert sorted(r["zone_id"] for r in df.collect()) == ["zone x", "zone y"]


def test_registry_and_elevation_keep_text_codes(spark, tmp_path):
    (tmp_path / "reg.csv").write_text("Village mapping report\nVillage Code,Body Code\n0171,12\n,13\n")
    got = T.read_registry(spark, str(tmp_path / "reg.csv"), ["Village Code", "Body Code"]).collect()
    assert {(r["Village Code"], r["Body Code"]) for r in got} == {("0171", "12"), (None, "13")}
    (tmp_path / "elev.csv").write_text("code,elevation_m\n02167N003,12.34\n02171,5\n")
    codes = {r["code"] for r in T.read_elevation(spark, str(tmp_path / "elev.csv")).collect()}
    assert codes == {"02167N003", "02171"}


def test_parquet_else_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n5\n")
    df = T.read_table(spark, str(tmp_path / "t.parquet"), str(tmp_path / "t.csv"), "a int")
    assert df.first()["a"] == 5
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert T.read_table(spark, str(tmp_path / "t.parquet"), str(tmp_path / "t.csv"), "a int").count() == 3


def test_panel_writer_partitions_and_never_overwrites(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1)), ("a", dt.date(2021, 1, 1))], "District string, Date date")
    out = str(tmp_path / "panel")
    T.write_panel(df, out, csv=str(tmp_path / "csv"))
    back = spark.read.parquet(out)
    assert back.where("year = 2021").count() == 1
    assert "PartitionFilters: [isnotnull(year" in back.where("year = 2021")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception):
        T.write_panel(df, out)


def test_features_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("u1", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]), ("u2", None)],
        "unit string, rings array<array<struct<x:double,y:double>>>",
    )
    T.write_features(df, str(tmp_path / "layer"), ["unit"], "rings")
    got = {r["properties"]["unit"]: r["rings"] for r in X.read_feature_lines(spark, str(tmp_path / "layer")).collect()}
    assert got["u2"] is None and got["u1"][0][1]["x"] == 1.0


def test_reports_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    T.write_report(df, str(tmp_path / "r"))
    T.write_metrics(df, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).first()["v"] == "1"
    assert spark.read.json(str(tmp_path / "m")).first()["v"] == 1


def test_nested_text_parses_or_is_null(spark):
    df = spark.createDataFrame([('{"p": 0.5}',), ("not json",), (None,)], "s string")
    got = [r["p"] for r in df.select(T.parse_nested("s", "p double")["p"].alias("p")).collect()]
    assert got == [0.5, None, None]


def test_merge_prefers_current_file(spark):
    d = dt.date
    history = spark.createDataFrame([("a", d(2025, 10, 1), 1.0), ("a", d(2025, 12, 31), 2.0), ("a", d(2026, 1, 1), 3.0)], "District string, Date date, r double")
    current = spark.createDataFrame([("a", d(2026, 1, 1), 9.0)], "District string, Date date, r double")
    got = P.merge_observations(history, current, since="2025-11-01", columns=["District", "Date", "r"]).orderBy("Date").collect()
    assert [(r["Date"], r["r"]) for r in got] == [(d(2025, 12, 31), 2.0), (d(2026, 1, 1), 9.0)]


def test_temperature_repair_chain(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2024, 7, 1), 60.0, 5.0, 24.0), ("a", dt.date(2024, 7, 2), 0.0, 20.0, 25.0), ("a", dt.date(2024, 1, 1), 60.0, 5.0, 4.0), ("a", dt.date(2024, 7, 3), 0.0, 30.0, 25.0)],
        "District string, Date date, Rainfall_Observed_mm double, Tmax_C double, Tmin_C double",
    )
    fixed, log = P.repair_temperatures(df)
    got = {r["Date"]: (r["Tmax_C"], r["Tmin_C"]) for r in fixed.collect()}
    assert got == {
        dt.date(2024, 7, 1): (25.2, 24.0), dt.date(2024, 7, 2): (25.5, 20.0),
        dt.date(2024, 1, 1): (5.0, 4.0), dt.date(2024, 7, 3): (30.0, 25.0),
    }
    assert sorted(r["issue"] for r in log.collect()) == ["low_tmax_heavy_rain", "tmax_below_tmin"]


def test_feature_rule_and_guard(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2024, 1, 1), 1.0, 2.0, 3.0, 1, 5)],
        "District string, Date date, as_of_feature double, future_rain_feature double, _hidden double, target_revival_7d int, label_available_7_14d int",
    )
    assert P.feature_columns(df.schema) == ["as_of_feature"]
    guarded = P.prediction_frame(df, ["as_of_feature"])
    assert "target_revival_7d" not in guarded.columns and "label_available_7_14d" not in guarded.columns
    with pytest.raises(ValueError):
        P.prediction_frame(df, ["absent"])
    with pytest.raises(ValueError):
        P.feature_columns(df.select("District").schema)
