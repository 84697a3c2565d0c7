"""Risk classes, advisories, applicability, downscaling, inheritance and replay."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.config import CORE_TARGETS, FEATURE_SCHEMAS, HORIZON_MONTHS, HORIZONS
from panelwright.functions import scalars as S
from panelwright.operators import advisory as V
from panelwright.operators import forecast as O
from panelwright.operators import quality as Q
from panelwright.operators import replay as R

HEADS = ("onset", "false_onset", "dry_spell_5d", "severe_break_7d", "heavy_rain", "revival")


def probabilities(spark, *rows):
    schema = ", ".join(f"p_{h} double" for h in HEADS)
    return spark.createDataFrame([tuple(r.get(h, 0.1) for h in HEADS) for r in rows], schema)


@pytest.mark.parametrize(
    "p,common,false",
    [
        (0.0, "LOW", "LOW"), (0.199, "LOW", "LOW"), (0.2, "LOW", "MODERATE"), (0.249, "LOW", "MODERATE"),
        (0.25, "MODERATE", "MODERATE"), (0.4, "MODERATE", "HIGH"), (0.5, "HIGH", "HIGH"), (0.65, "HIGH", "VERY_HIGH"),
        (0.75, "VERY_HIGH", "VERY_HIGH"), (None, "UNAVAILABLE", "UNAVAILABLE"),
        (float("nan"), "UNAVAILABLE", "UNAVAILABLE"), (float("inf"), "UNAVAILABLE", "UNAVAILABLE"),
    ],
)
def test_risk_edges(spark, p, common, false):
    df = O.risk_columns(probabilities(spark, {h: p for h in HEADS}))
    row = df.first()
    assert row["heavy_rain_risk"] == row["severe_break_risk"] == row["dry_spell_risk"] == common
    assert row["false_onset_risk"] == false
    order = ["UNAVAILABLE", "LOW", "MODERATE", "HIGH", "VERY_HIGH"]
    assert row["risk_level"] == max((common, false), key=order.index)


def test_one_unavailable_head_does_not_hide_the_others(spark):
    row = O.risk_columns(probabilities(spark, {"heavy_rain": None, "dry_spell_5d": 0.8})).first()
    assert row["heavy_rain_risk"] == "UNAVAILABLE"
    assert row["risk_level"] == "VERY_HIGH" and row["risk_color"] == "#ef4444"


@pytest.mark.parametrize(
    "values,state",
    [
        ({"heavy_rain": 0.6, "severe_break_7d": 0.9}, "heavy"), ({"severe_break_7d": 0.6}, "dry"),
        ({"dry_spell_5d": 0.7}, "dry"), ({"dry_spell_5d": 0.699}, "normal"),
        ({"false_onset": 0.4, "onset": 0.5}, "false"), ({"false_onset": 0.4, "onset": 0.49}, "normal"),
        ({"onset": 0.6}, "onset"), ({"revival": 0.5}, "revival"), ({}, "normal"),
        ({"revival": None}, "unavailable"), ({"onset": float("nan"), "heavy_rain": 0.9}, "unavailable"),
    ],
)
def test_headlines(spark, values, state):
    row = O.headline_advisory(probabilities(spark, values)).first()
    assert row["advisory_headline"] == O.HEADLINES[state]
    assert row["recommended_action"] == O.ACTIONS[state]


def advise(spark, date="2025-06-15", crop="aman_rice", dry=0.1, severe=0.1, **p):
    base = {"onset": 0.8, "false_onset": 0.1, "dry_spell_5d": 0.1, "severe_break_7d": 0.1, "heavy_rain": 0.1, "revival": 0.1}
    base.update(p)
    schema = "reference_date date, crop string, outlook_dry_spell double, outlook_severe_break double, " + ", ".join(f"p_{h} double" for h in HEADS)
    row = (dt.date.fromisoformat(date), crop, dry, severe, *[base[h] for h in HEADS])
    return V.crop_advisory(spark.createDataFrame([row], schema)).first()


@pytest.mark.parametrize(
    "kwargs,rule,action",
    [
        ({"crop": None}, "AGRI-WAIT-CROP-CONTEXT-001", "WAIT"), ({"crop": ""}, "AGRI-WAIT-CROP-CONTEXT-001", "WAIT"),
        ({"date": "2025-05-19"}, "AGRI-WAIT-WINDOW-001", "WAIT"), ({"date": "2025-08-08"}, "AGRI-WAIT-WINDOW-001", "WAIT"),
        ({"dry": None}, "AGRI-WAIT-APPLICABILITY-001", "WAIT"), ({"onset": None}, "AGRI-WAIT-APPLICABILITY-002", "WAIT"),
        ({"heavy_rain": 0.5, "false_onset": 0.9}, "AGRI-DRAINAGE-001", "WAIT"),
        ({"false_onset": 0.4}, "AGRI-WAIT-FALSE-ONSET-001", "WAIT"), ({"onset": 0.59}, "AGRI-WAIT-ONSET-001", "WAIT"),
        ({"dry_spell_5d": 0.7}, "AGRI-WAIT-DRY-SPELL-001", "WAIT"), ({"severe": 0.7}, "AGRI-WAIT-DRY-SPELL-001", "WAIT"),
        ({"dry": 0.7}, "AGRI-IRRIGATION-001", "PREPARE_IRRIGATION"), ({"dry_spell_5d": 0.5}, "AGRI-IRRIGATION-001", "PREPARE_IRRIGATION"),
        ({"date": "2025-05-20"}, "AGRI-SOW-001", "SOW"), ({"date": "2025-08-07"}, "AGRI-SOW-001", "SOW"),
    ],
)
def test_crop_advisory_order(spark, kwargs, rule, action):
    row = advise(spark, **kwargs)
    assert row["advisory"]["rule_id"] == rule and row["advisory"]["action"] == action
    extended = rule in ("AGRI-WAIT-DRY-SPELL-001", "AGRI-IRRIGATION-001", "AGRI-SOW-001")
    assert len(row["risk_factors"]) == (8 if extended else 6)


def test_advisory_rejects_bad_input(spark):
    df = spark.createDataFrame([("maize", 0.5), ("aman_rice", 1.5), (None, 0.5), ("aman_rice", None)], "crop string, p double")
    got = [r["input_error"] for r in V.advisory_input_errors(df, probabilities=["p"]).collect()]
    assert sorted(got) == ["probability_out_of_bounds", "unknown_crop"]


def test_downscaling_directions(spark):
    df = spark.createDataFrame(
        [("up", 150.0, 100.0, -0.5), ("valley", 50.0, 100.0, 0.5), ("same", 100.0, 100.0, 0.0), ("far", 1e6, 100.0, 0.0), ("bare", None, None, None)],
        "u string, elevation_mean_m double, district_mean_elevation_m double, delta_twi double",
    ).withColumns({"heavy": F.lit(0.4), "dry": F.lit(0.4), "severe": F.lit(0.4)})
    out = O.downscale(df, {"heavy_rain": "heavy", "dry_spell_5d": "dry", "severe_break_7d": "severe"})
    got = {r["u"]: r for r in out.collect()}
    assert got["up"]["dry_spell_5d_downscaled"] > 0.4 > got["valley"]["dry_spell_5d_downscaled"]
    assert got["same"]["heavy_rain_downscaled"] == 0.4 == got["bare"]["heavy_rain_downscaled"]
    assert got["up"]["severe_break_7d_downscaled"] == 0.4  # a head without coefficients
    assert got["far"]["heavy_rain_downscaled"] == pytest.approx(0.7492, abs=1e-4)  # bounded shift


def observation(spark, **changes):
    row = {
        "District": "Nadia", "Date": dt.date(2025, 7, 1), "Tmax_C": 30.0, "Tmin_C": 24.0, "Relative_Humidity_pct": 80.0,
        "MJO_Phase": 3, "iod_dmi": 0.5, "vpd_kpa": None,
    }
    row.update(changes)
    return spark.createDataFrame(
        [tuple(row.values())],
        "District string, Date date, Tmax_C double, Tmin_C double, Relative_Humidity_pct double, MJO_Phase int, iod_dmi double, vpd_kpa double",
    )


def test_observation_is_completed_but_not_invented(spark):
    row = O.complete_observation(observation(spark)).first()
    assert row["day_of_year"] == 182 and row["dtr_c"] == 6.0 and row["iod_positive_flag"] == 1
    assert row["iod_dmi_lag7"] == row["iod_dmi_lag14"] == 0.5 and row["vpd_kpa"] == pytest.approx(0.712, abs=0.01)
    kept = O.complete_observation(observation(spark, vpd_kpa=1.25)).first()
    assert kept["vpd_kpa"] == 1.25
    swapped = O.complete_observation(observation(spark, Tmax_C=20.0, Tmin_C=25.0)).first()
    assert swapped["dtr_c"] == 5.5
    bare = O.complete_observation(observation(spark, Tmax_C=None, MJO_Phase=None, iod_dmi=None)).first()
    assert bare["dtr_c"] is None and bare["vpd_kpa"] is None and bare["mjo_phase_sin"] is None and bare["iod_positive_flag"] is None


def test_missing_feature_lists(spark):
    df = O.with_missing(O.complete_observation(observation(spark, MJO_Phase=None)), {"s": ("dtr_c", "mjo_phase_sin", "iod_dmi")})
    assert df.first()["missing_s"] == ["mjo_phase_sin"]
    assert [len(v) for v in FEATURE_SCHEMAS.values()] == [26, 31, 38, 40]


def head_rows(spark, month, atmospheric_missing):
    obs = probabilities(spark, {h: 0.123456 for h in HEADS}).withColumns(
        {
            "District": F.lit("d"), "Date": F.to_date(F.lit(f"2025-{month:02d}-10")),
            "missing_baseline": F.array().cast("array<string>"), "missing_iod": F.array().cast("array<string>"),
            "missing_atmospheric": F.array(F.lit("u850_regional")) if atmospheric_missing else F.array().cast("array<string>"),
        }
    )
    out = O.head_results(obs, ["District", "Date"], {h: f"p_{h}" for h in HEADS})
    return {r["head"]: r for r in out.collect()}


def test_head_status_and_routes(spark):
    summer = head_rows(spark, 7, True)
    assert summer["heavy_rain"]["applicability"] == "UNAVAILABLE" and summer["heavy_rain"]["probability"] is None
    assert summer["onset"]["applicability"] == "APPLICABLE" and summer["onset"]["features_evaluated"] == 31
    assert (summer["dry_spell_5d"]["probability"], summer["dry_spell_5d"]["probability_pct"]) == (0.1235, 12.35)
    winter = head_rows(spark, 1, True)
    assert winter["revival"]["applicability"] == "OUT_OF_SEASON" and winter["revival"]["features_evaluated"] == 0
    assert winter["heavy_rain"]["applicability"] == "UNAVAILABLE"


def test_baseline_preferred_status(spark):
    df = spark.createDataFrame([(1, "onset", True), (6, "onset", True), (6, "revival", False)], "m int, h string, b boolean")
    got = [
        r["s"] for r in df.select(O.head_status(F.col("m"), F.col("h"), F.lit(True), baseline_preferred=F.col("b")).alias("s")).collect()
    ]
    assert got == ["OUT_OF_SEASON", "BASELINE_PREFERRED", "UNAVAILABLE"]


def test_outlook_completeness(spark):
    rows = [("a", h, e, 0.5, "APPLICABLE") for h in HORIZONS for e in HORIZON_MONTHS]
    rows += [("b", h, e, 0.5, "APPLICABLE") for h in HORIZONS for e in HORIZON_MONTHS][:-1]
    rows += [("c", h, e, 1.5 if e == "revival" else None, "APPLICABLE") for h in HORIZONS for e in HORIZON_MONTHS]
    df = spark.createDataFrame(rows, "k string, horizon string, event string, probability double, applicability string")
    got = {r["k"]: r for r in O.nest_outlook(df, ["k"]).collect()}
    assert [got[k]["complete"] for k in "abc"] == [True, False, False]
    assert got["a"]["outlook"]["7_14d"]["heavy_rain"]["probability"] == 0.5


def test_inheritance_with_compound_crosswalk(spark):
    children = spark.createDataFrame([("u1", "309", "2162"), ("u2", "309", "9999"), ("u3", "320", "1"), ("u4", "777", "1")], "u string, dist string, block string")
    walk = spark.createDataFrame([("Siliguri", "309", ["2162"]), ("Nadia", "320", None)], "District string, district_code string, blocks array<string>")
    fc = spark.createDataFrame([("Siliguri", 0.1), ("Nadia", 0.2)], "District string, p double")
    got = {r["u"]: r["p"] for r in O.inherit_down(children, walk, fc, child_district="dist", child_block="block").collect()}
    assert got == {"u1": 0.1, "u3": 0.2}


def test_probability_checks(spark):
    df = spark.createDataFrame([("a", 0.5, 50.0), ("b", 1.2, 120.0), ("c", 0.5, 51.0), ("d", None, None)], "k string, p double, pct double")
    assert sorted(r["k"] for r in Q.probability_violations(df, ["k"], "p", "pct").collect()) == ["b", "c"]


def test_district_table_and_catalog(spark):
    t = O.district_table(spark)
    assert t.count() == 12 and t.where("District = 'Siliguri_Foothill'").first()["District_Encoded"] == 11
    assert V.crop_catalog(spark).count() == 1
    names = spark.createDataFrame([("Birbhum (Suri)",), ("Cooch Behar",)], "n string")
    assert [r["k"] for r in names.select(S.model_key("n").alias("k")).collect()] == ["Birbhum_Suri", "Cooch_Behar"]


# --- replay ------------------------------------------------------------------------

def replay(spark):
    days = [dt.date(2025, 6, 1) + dt.timedelta(days=i) for i in range(40)]
    panel = spark.createDataFrame(
        [(k, d, float(i % 7), *[int(i % 5 == j) for j in range(6)]) for k in ("a", "b") for i, d in enumerate(days)],
        "District string, Date date, Rainfall_Observed_mm double, " + ", ".join(f"{c} int" for c in CORE_TARGETS.values()),
    )
    guarded = R.guarded_inputs(panel, 2025, ["Rainfall_Observed_mm"])
    assert not [c for c in guarded.columns if c.startswith("target_")]
    p = {f"p_{h}": F.lit(0.1) for h in HEADS}
    p.update(
        p_false_onset=(F.col("Rainfall_Observed_mm") / 10.0), p_onset=F.lit(0.7),
        outlook_dry_spell=F.lit(0.1), outlook_severe_break=F.lit(0.1),
    )
    return panel, R.replay_records(guarded.withColumns(p), panel)


def test_replay_records_cases_and_decisions(spark):
    panel, records = replay(spark)
    rows = records.collect()
    assert len(rows) == 80
    warned = [r for r in rows if r["advisory"]["rule_id"] == "AGRI-WAIT-FALSE-ONSET-001"]
    assert warned and all(r["p_false_onset"] >= 0.4 for r in warned)
    d = R.decision_metrics(records).first()
    assert d["false_onset_wait_records"] == len(warned)
    assert d["followed_by_false_onset_rate"] == pytest.approx(sum(r["y_false_onset"] for r in warned) / len(warned))
    cases = {r["case_id"]: r for r in R.select_cases(records).collect()}
    best = max(r["p_false_onset"] for r in rows if r["y_false_onset"] == 1)
    first = min((r["Date"], r["District"]) for r in rows if r["y_false_onset"] == 1 and r["p_false_onset"] == best)
    chosen = cases["A_HIGH_FALSE_ONSET_ACTUAL"]
    assert (chosen["Date"], chosen["District"]) == first
    assert "D_HIGH_DRY_SPELL_ACTUAL" not in cases
    timeline = {r["case_id"]: r["timeline"] for r in R.case_timeline(R.select_cases(records), panel).collect()}
    for case, points in timeline.items():
        ref = cases[case]["Date"]
        dates = [p["date"] for p in points]
        assert dates == sorted(dates) and all(ref < x <= ref + dt.timedelta(days=21) for x in dates)
    assert sorted(map(str, rows)) == sorted(map(str, replay(spark)[1].collect()))


def test_no_warning_gives_null_rates(spark):
    _, records = replay(spark)
    d = R.decision_metrics(records.where("p_false_onset < 0.4")).first()
    assert d["false_onset_wait_records"] == 0 and d["followed_by_false_onset_rate"] is None


def test_replay_order_is_by_date_and_district(spark):
    rows = [("b", dt.date(2020, 1, 2)), ("a", dt.date(2020, 1, 2)), ("c", dt.date(2020, 1, 1))]
    df = spark.createDataFrame(rows, "District string, Date date")
    assert [r["District"] for r in R.replay_order(df).collect()] == ["c", "a", "b"]
