"""Model heads and calibration, checked by their properties."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import learn as N
from panelwright.operators import metrics as M

TREES = {"maxIter": 8, "maxDepth": 3, "stepSize": 0.2}


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        y = int(rng.random() < 1 / (1 + math.exp(-(2 * x - 1))))
        split = ("train", "train", "calibration", "selection", "test")[i % 5]
        rows.append((x, z, y, split))
    return spark.createDataFrame(rows, "x double, z double, label int, split string").cache()


def test_candidates_beat_climatology(spark, data):
    fits, metrics = N.fit_candidates(
        data, label="label",
        candidates={"logistic_local": ("logistic", ["x", "z"]), "boosted_local": ("boosted", ["x", "z"])}, settings=TREES,
    )
    rows = {(r["candidate"], r["split"]): r for r in metrics.collect()}
    assert len(rows) == 4
    for r in rows.values():
        rate = r["events"] / r["n"]
        assert r["brier"] < rate * (1 - rate) and r["roc_auc"] > 0.75
    assert N.pick_candidate(metrics).count() == 1
    importances = N.feature_importances(fits["boosted_local"][0], ["x", "z"], "h")
    assert N.top_features(importances).first()["feature"] == "x"


def raw_scores(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(2000):
        p = rng.random()
        rows.append((p, int(rng.random() < p * p)))  # over-confident scores
    rows += [(0.0, 0), (1.0, 1)]
    return spark.createDataFrame(rows, "raw_p double, label int")


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibrators_are_monotone_bounded_and_better(spark, method):
    df = raw_scores(spark)
    out = N.CALIBRATORS[method]().fit(df, "label").predict(df)
    rows = out.orderBy("raw_p").collect()
    p = [r["p"] for r in rows]
    assert all(0.0 <= v <= 1.0 for v in p) and all(a <= b + 1e-9 for a, b in zip(p, p[1:]))
    before = sum((r["raw_p"] - r["label"]) ** 2 for r in rows)
    assert sum((r["p"] - r["label"]) ** 2 for r in rows) < before


def test_isotonic_is_exact_on_separable_scores(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1)], "raw_p double, label int")
    out = N.IsotonicCalibrator().fit(df, "label").predict(df).orderBy("raw_p").collect()
    assert [r["p"] for r in out] == pytest.approx([0.0, 0.5, 0.5, 1.0])


def test_method_choice_uses_the_selection_set(spark):
    df = raw_scores(spark)
    method, calibrator = N.choose_calibration(df, df, "label")
    assert method in N.CALIBRATORS
    assert calibrator.predict(df).where("p is null").count() == 0


def test_masked_scores(spark, data):
    model = N.logistic_head(["x", "z"], "label", 600).fit(data.withColumn("label", F.col("label").cast("double")))
    out = N.score_with_mask(data, model, F.col("x") > 0)
    assert out.where("x <= 0 and p is not null").count() == 0
    assert out.where("x > 0 and (p is null or p < 0 or p > 1)").count() == 0
    assert set(out.columns) == {*data.columns, "p"}


def test_alphabetical_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("b",)], "s string")
    got = {r["s"]: r["c"] for r in N.alphabetical_index(df, {"s": "c"}).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 2.0}


def test_multiclass_report_adds_up(spark):
    rng = random.Random(1)
    rows = [(c + rng.gauss(0, 0.3), rng.random(), c) for c in range(3) for _ in range(80)]
    df = spark.createDataFrame(rows, "x double, z double, label int")
    _, report, confusion = N.multiclass_report(df, features=["x", "z"], label="label", classes=[0, 1, 2])
    total = sum(r["support"] for r in report.collect())
    cells = sum(sum(r[str(c)] for c in range(3)) for r in confusion.collect())
    assert total == cells and 20 < total < 80
    assert all(r["f1"] > 0.7 for r in report.collect())


def test_sweep_works_on_calibrated_scores(spark):
    scores = raw_scores(spark).select(F.lit("e").alias("event"), F.col("label").alias("y"), F.col("raw_p").alias("p"))
    best = M.best_threshold(M.threshold_sweep(scores, M.GRID_91, by=["event"]), by=["event"]).first()
    assert 0.3 < best["threshold"] < 0.9
