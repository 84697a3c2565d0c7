"""Metrics, baselines, splits and release rules."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import baselines as B
from panelwright.operators import metrics as M


@pytest.fixture(scope="module")
def scores():
    rng = random.Random(11)
    rows = [("many", int(rng.random() < 0.3), rng.random()) for _ in range(900)]
    rows += [("ties", int(rng.random() < 0.5), rng.choice([0.0, 0.1, 0.3, 0.5, 1.0])) for _ in range(200)]
    rows += [("same", i % 2, 0.4) for i in range(20)]
    rows += [("one_class", 0, rng.random()) for _ in range(15)]
    rows += [("narrow", int(rng.random() < 0.5), 0.5 + rng.random() * 1e-9) for _ in range(300)]
    return rows


def auc(pairs):
    pos = [p for y, p in pairs if y]
    neg = [p for y, p in pairs if not y]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def average_precision(pairs):
    total = sum(y for y, _ in pairs)
    if not total:
        return None
    ap, before = 0.0, 0
    for t in sorted({p for _, p in pairs}, reverse=True):
        chosen = [y for y, p in pairs if p >= t]
        ap += (sum(chosen) - before) / total * sum(chosen) / len(chosen)
        before = sum(chosen)
    return ap


def test_metrics_equal_brute_force(spark, scores):
    df = spark.createDataFrame([*scores, ("many", None, 0.5), ("many", 1, None)], "event string, y int, p double")
    got = {r["event"]: r for r in M.binary_metrics(df, by=["event"]).collect()}
    for event in {e for e, _, _ in scores}:
        pairs = [(y, p) for e, y, p in scores if e == event]
        r = got[event]
        assert r["n"] == len(pairs)
        assert r["brier"] == pytest.approx(sum((p - y) ** 2 for y, p in pairs) / len(pairs))
        for name, want in (("roc_auc", auc(pairs)), ("pr_auc", average_precision(pairs))):
            assert (r[name] is None) == (want is None), (event, name)
            if want is not None:
                assert r[name] == pytest.approx(want), (event, name)
        tp = sum(y for y, p in pairs if p >= 0.5)
        fp = sum(1 - y for y, p in pairs if p >= 0.5)
        fn = sum(y for y, p in pairs if p < 0.5)
        assert r["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0.0)
        assert r["recall"] == pytest.approx(tp / (tp + fn) if tp + fn else 0.0)
        assert r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
        eps = 2.220446049250313e-16
        ll = -sum(math.log(min(1 - eps, max(eps, p)) if y else 1 - min(1 - eps, max(eps, p))) for y, p in pairs)
        assert r["log_loss"] == pytest.approx(ll / len(pairs))


def test_metrics_without_groups(spark, scores):
    df = spark.createDataFrame([s for s in scores if s[0] == "ties"], "event string, y int, p double")
    row = M.binary_metrics(df, by=[]).first()
    assert row["roc_auc"] == pytest.approx(auc([(y, p) for e, y, p in scores if e == "ties"]))


def test_sweep_takes_first_best(spark, scores):
    df = spark.createDataFrame(scores, "event string, y int, p double")
    best = {r["event"]: r for r in M.best_threshold(M.threshold_sweep(df, M.GRID_81, by=["event"]), by=["event"]).collect()}
    for event in ("many", "ties", "same", "one_class"):
        pairs = [(y, p) for e, y, p in scores if e == event]
        want, want_f1 = None, -1.0
        for t in M.GRID_81:
            tp = sum(y for y, p in pairs if p >= t)
            fp = sum(1 - y for y, p in pairs if p >= t)
            fn = sum(y for y, p in pairs if p < t)
            f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
            if f1 > want_f1:
                want, want_f1 = t, f1
        assert best[event]["threshold"] == want and best[event]["f1"] == pytest.approx(want_f1)


def test_reliability_edges(spark):
    ps = [0.0, 0.1, 0.3, 0.30000000000000004, 0.9999, 1.0, 0.05]
    df = spark.createDataFrame([("e", 1, p) for p in ps], "event string, y int, p double")
    got = {r["bin"]: r["count"] for r in M.reliability_bins(df, by=["event"]).collect()}
    edges = [i * 0.1 for i in range(10)] + [1.0]
    want = {}
    for p in ps:
        for i in range(10):
            if p >= edges[i] and (p < edges[i + 1] or (i == 9 and p <= 1.0)):
                want[i] = want.get(i, 0) + 1
    assert got == want


def test_purged_split_boundaries(spark):
    days = ["2023-11-24", "2023-11-25", "2023-12-31", "2024-01-01", "2024-06-30", "2024-07-01", "2024-11-24", "2024-11-25", "2025-01-01", "2025-11-24", "2025-11-25"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias("Date"))
    got = [r["split"] for r in B.with_purged_split(df, "Date", train_until=2023).orderBy("Date").collect()]
    assert got == ["train", None, None, "calibration", "calibration", "selection", "selection", None, "test", "test", None]
    years = B.with_year_split(df, "Date", train_until=2023, validate=2024, test=2025).orderBy("Date").collect()
    assert [r["split"] for r in years] == ["train"] * 3 + ["validation"] * 5 + ["test"] * 3


def test_rate_fallback_chain(spark):
    rows = [("e", "a", 6, 1), ("e", "a", 6, 0), ("e", "b", 7, 1), ("e", "b", 7, None), ("e", "c", 8, None)]
    wide = spark.createDataFrame(rows, "event string, District string, month int, y int")
    counts = B.label_counts(wide, ["District", "month"], {"e": "y"})
    rates = B.fallback_rates(counts, ["event"], "District")
    asked = spark.createDataFrame([("e", "a", 6), ("e", "a", 7), ("e", "c", 8)], "event string, District string, month int")
    got = {(r["District"], r["month"]): (r["p"], r["rate_level"]) for r in B.lookup_rates(asked, rates, ["event"], "District").collect()}
    assert got == {("a", 6): (0.5, 0), ("a", 7): (1.0, 1), ("c", 8): (pytest.approx(2 / 3), 2)}


def test_state_baseline_edges(spark):
    train = spark.createDataFrame([(float(i), int(i > 5)) for i in range(10)], "rain7 double, y int")
    rates = B.state_rates(B.label_counts(train, ["rain7"], {"e": "y"}), ["event"], "rain7")
    edges = rates.first()["edges"]
    assert edges == pytest.approx([2.97, 5.94])
    asked = spark.createDataFrame([("e", 0.0), ("e", 5.94), ("e", 100.0)], "event string, rain7 double")
    got = [r["p"] for r in B.state_baseline(asked, rates, ["event"], "rain7").orderBy("rain7").collect()]
    assert got == [0.0, 0.0, 1.0]


def test_snapped_states_keep_every_bucket(spark):
    train = spark.createDataFrame(
        [(float(v), a, b) for v, a, b in [(0, 1, None), (1, 0, 1), (2, None, 0), (3, 1, 1), (4, 0, 0), (5, None, 1)]],
        "rain7 double, a int, b int",
    )
    rates = B.state_rates(B.label_counts(train, ["rain7"], {"a": "a", "b": "b"}), ["event"], "rain7")
    values = [None, float("nan"), -1.0, 9.0, *[v / 4 for v in range(24)]]
    asked = spark.createDataFrame([(v, e) for v in values for e in "ab"], "v double, event string")
    asked = asked.withColumn("rain7", F.col("v"))
    snapped = B.snapped_states(asked, rates, "rain7")
    plain, moved = (
        sorted(map(repr, B.state_baseline(df, rates, ["event"], "rain7").select("event", "v", "p").collect()))
        for df in (asked, snapped)
    )
    assert plain == moved and snapped.select("rain7").distinct().count() <= 5


def test_positive_weight_is_clamped(spark):
    df = spark.createDataFrame([(1, 100), (0, 9), (10, 5)], "p int, n int")
    assert [r["w"] for r in df.select(B.positive_weight("p", "n").alias("w")).collect()] == [25.0, 9.0, 1.0]


def gate(spark, **changes):
    row = dict(
        validation_brier=0.1, validation_climatology_brier=0.1, test_brier=0.1, test_roc_auc=0.8, test_pr_auc=0.5,
        climatology_brier=0.12, district_brier=0.13, state_brier=0.14, climatology_pr_auc=0.4,
    )
    row.update(changes)
    schema = ", ".join(f"{k} double" for k in row)
    return B.release_gate(spark.createDataFrame([tuple(row.values())], schema)).first()["release_status"]


def test_release_gate_reasons(spark):
    assert gate(spark) == "PRODUCTION_V2"
    assert gate(spark, validation_brier=0.1051) == "BASELINE_PREFERRED"
    assert gate(spark, validation_brier=0.105) == "PRODUCTION_V2"
    assert gate(spark, state_brier=0.0999) == "BASELINE_PREFERRED"
    assert gate(spark, test_roc_auc=0.499) == "BASELINE_PREFERRED"
    assert gate(spark, test_pr_auc=0.379) == "BASELINE_PREFERRED"
    assert gate(spark, test_pr_auc=None) == "PRODUCTION_V2"


def test_variant_rules(spark):
    df = spark.createDataFrame(
        [(0.1, 0.8, 0.1, 0.7), (0.1, 0.8, 0.1009, 0.8), (0.1, 0.8, 0.1009, 0.79), (0.1, 0.8, 0.102, 0.9)],
        "ba double, aa double, bb double, ab double",
    )
    got = [r["c"] for r in df.select(B.ablation_choice("ba", "aa", "bb", "ab").alias("c")).collect()]
    assert got == ["ATMOSPHERIC_ENHANCED", "ATMOSPHERIC_ENHANCED", "RETAIN_BASELINE", "RETAIN_BASELINE"]
    deltas = spark.createDataFrame(
        [(-0.01, 0.01, 0.0, 0.0), (0.01, -0.01, 0.0, 0.0), (-0.01, -0.01, 0.0, 0.0), (0.01, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0)],
        "a double, b double, c double, d double",
    )
    status = [r["s"] for r in deltas.select(B.improvement_status(*[F.col(c) for c in "abcd"]).alias("s")).collect()]
    assert status == ["IMPROVED", "SLIGHT_REGRESSION", "SLIGHT_IMPROVEMENT", "NEUTRAL_TO_SLIGHT_REGRESSION", "NEUTRAL"]


def test_leave_one_out_equals_refit(spark):
    rng = random.Random(2)
    rows = [(i, rng.uniform(0, 10), rng.uniform(0, 5)) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    got = {r["k"]: r for r in B.leave_one_out_fit(df, "k", "x", "y").collect()}
    for k, x, y in rows:
        rest = [(a, b) for i, a, b in rows if i != k]
        mx, my = sum(a for a, _ in rest) / 11, sum(b for _, b in rest) / 11
        slope = sum((a - mx) * (b - my) for a, b in rest) / sum((a - mx) ** 2 for a, _ in rest)
        assert got[k]["held_out_error"] == pytest.approx(y - (my + slope * (x - mx)))


def test_class_balance_counts(spark):
    long = B.unpivot_labels(
        spark.createDataFrame([(dt.date(2024, 6, 1), 1, None), (dt.date(2024, 6, 2), 0, 1)], "Date date, t1 int, t2 int"),
        ["Date"], {"one": "t1", "two": "t2"},
    )
    got = {r["event"]: (r["eligible"], r["positive"], r["unknown"]) for r in B.class_balance(long, ["event"]).collect()}
    assert got == {"one": (2, 1, 0), "two": (1, 1, 1)}


def test_exact_percentiles_equal_the_builtin(spark, scores):
    df = spark.createDataFrame([*scores, ("single", 1, 0.7)], "event string, y int, p double")
    shares = [0.0, 0.1, 0.33, 0.5, 0.66, 0.99, 1.0]
    got = {r["event"]: r["percentiles"] for r in M.exact_percentiles(df, "p", shares, by=["event"]).collect()}
    want = df.groupBy("event").agg(F.percentile("p", F.array(*[F.lit(s) for s in shares])).alias("q")).collect()
    assert {r["event"] for r in want} == set(got)
    for r in want:
        assert got[r["event"]] == pytest.approx(r["q"], abs=1e-12)
