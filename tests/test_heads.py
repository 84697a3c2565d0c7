"""Released heads, point-in-time values, ordered totals and calibration against plain forms."""

from __future__ import annotations

import json
import random
import tempfile
from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from panelwright.operators import asof as A
from panelwright.operators import geo as G
from panelwright.operators import heads as H
from panelwright.operators import learn as N
from panelwright.operators import metrics as M
from panelwright.operators import training as T
from panelwright.operators.baselines import leave_one_out_fits


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        x, z = rng.gauss(0, 1), rng.gauss(5, 2)
        y = int(rng.random() < 1 / (1 + 2.718 ** -(1.5 * x - 0.4 * (z - 5))))
        day = date(1997, 1, 1) + timedelta(days=i * 2)
        split = ("train", "calibration", "selection", "test")[min(3, i // 240 if i < 480 else 2 + (i >= 540))]
        data.append((i % 7, day, x, z if i % 50 else None, y, split))
    return spark.createDataFrame(data, "District long, Date date, x double, z double, y int, split string")


def test_store_round_trip_and_scores_by_another_engine(spark, rows):
    """Scores of a fitted logistic head equal SQL over the written coefficient table."""
    known = rows.where("z is not null")
    fit = N.logistic_head(["x", "z"], "y", 500).fit(known.withColumn("y", F.col("y").cast("double")))
    intercept, weights = H.linear_weights(fit, ["x", "z"])
    boosted = N.boosted_head(["x", "z"], "y", {"maxIter": 5, "maxDepth": 2, "stepSize": 0.2}).fit(
        known.withColumn("y", F.col("y").cast("double")))
    heads = [
        H.Head("linear", "two", (1, 2, 3, 4, 5, 6), ("x", "z"), intercept=intercept, weights=weights),
        H.Head("platt", "two", tuple(range(1, 13)), ("x", "z"), intercept=intercept, weights=weights,
               slope=0.8, shift=-0.1),
        H.Head("steps", "two", tuple(range(1, 13)), ("x", "z"), intercept=intercept, weights=weights,
               points=((0.2, 0.1), (0.5, 0.6), (0.9, 0.8))),
        H.Head("trees", "two", tuple(range(1, 13)), ("x", "z"), kind="boosted"),
        H.Head("rates", "two", tuple(range(1, 13)), ("x", "z"), status=H.BASELINE),
    ]
    folder = tempfile.mkdtemp(dir="/tmp") + "/store"
    H.write_heads(spark, folder, heads, {"trees": boosted})
    back, load = H.read_heads(spark, folder)
    assert back == sorted(heads, key=lambda h: h.name)
    scored = H.score_heads(rows, back, load=load)
    assert scored.count() == rows.count()
    got = {(r.District, r.Date): r for r in scored.collect()}

    rows.select("District", "Date", "x", "z").coalesce(1).write.parquet(folder + "/rows")
    sql = f"""
        with c as (select * from '{folder}/coefficients/*.parquet' where head = 'linear')
        select District, Date, 1 / (1 + exp(-((select weight from c where feature = '')
          + x * (select weight from c where feature = 'x') + z * (select weight from c where feature = 'z')))) as p
        from '{folder}/rows/*.parquet'"""
    for district, day, p in duckdb.sql(sql).fetchall():
        r = got[district, day]
        if r.z is None:
            assert r.p_linear is r.p_platt is r.p_steps is r.p_trees is None
            continue
        assert r.p_linear == (pytest.approx(p, abs=1e-12) if day.month <= 6 else None)
        assert 0 <= r.p_trees <= 1 and r.p_rates is None
        points = [(0.2, 0.1), (0.5, 0.6), (0.9, 0.8)]
        if p <= 0.2 or p >= 0.9:
            want = 0.1 if p <= 0.2 else 0.8
        else:
            (x0, y0), (x1, y1) = points[p > 0.5 : 2 + (p > 0.5)]
            want = y0 + (y1 - y0) * (p - x0) / (x1 - x0)
        assert r.p_steps == pytest.approx(want, abs=1e-9)
    raw = {(r.District, r.Date): r.probability[1] for r in boosted.transform(known).collect()}
    assert all(got[k].p_trees == pytest.approx(v, abs=1e-12) for k, v in raw.items())

    rated = scored.withColumn("rate", F.when(F.col("District") != 3, F.lit(0.25)))
    long = H.stacked_results(rated, ["District", "Date"], back, rates={"rates": "rate"})
    states = {(r.head, r.applicability) for r in long.collect()}
    assert states == {
        ("linear", "APPLICABLE"), ("linear", "OUT_OF_SEASON"), ("linear", "UNAVAILABLE"), ("platt", "APPLICABLE"),
        ("platt", "UNAVAILABLE"), ("steps", "APPLICABLE"), ("steps", "UNAVAILABLE"), ("trees", "APPLICABLE"),
        ("trees", "UNAVAILABLE"), ("rates", "BASELINE_PREFERRED"), ("rates", "UNAVAILABLE")}
    assert all(r.probability is None for r in long.where("applicability in ('OUT_OF_SEASON', 'UNAVAILABLE')").collect())


def test_training_counts_and_weighted_fits(spark, rows):
    specs = [
        T.HeadSpec("all", "y", tuple(range(1, 13)), {"logistic": ("logistic", ("x",)), "boosted": ("boosted", ("x", "z"))}),
        T.HeadSpec("winter", "y", (1, 2), {"logistic": ("logistic", ("x",))}),
        T.HeadSpec("none", "zero", (1,), {"logistic": ("logistic", ("x",))}),
    ]
    table = rows.withColumn("zero", F.lit(0))
    want = {}
    for r in rows.collect():
        for name, months in (("all", range(1, 13)), ("winter", (1, 2))):
            n, s = want.get((name, r.split), (0, 0))
            hit = r.Date.month in months
            want[name, r.split] = (n + hit, s + hit * r.y)
    counts = {(r["head"], r["split"]): r for r in T.training_counts(table, specs).collect()}
    for key, (n, s) in want.items():
        assert (counts[key]["rows"], counts[key]["positives"]) == (n, s)
        weight = min(25.0, max(1.0, (n - s) / max(1, s))) if key[1] == "train" else None
        assert counts[key]["weight"] == (None if weight is None else pytest.approx(weight))
    fits, metrics = T.fit_heads(table, specs, settings={"maxIter": 3, "maxDepth": 2, "stepSize": 0.2}, parallel=3)
    # no row of the selection split lies in winter, and "none" has no positives
    assert ("winter", "selection") in want and want["winter", "selection"][0] == 0
    assert set(fits) == {("all", "logistic"), ("all", "boosted")}
    sizes = {(r["head"], r["candidate"], r["split"]): r["n"] for r in metrics.collect()}
    assert sizes["all", "logistic", "test"] == want["all", "test"][0]


def plain_isotonic(points):
    blocks = []
    for x, w, s in sorted(points):
        blocks.append([x, x, w, s])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            _, high, w1, s1 = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + w1, blocks[-1][3] + s1]
    return blocks


def test_isotonic_fit_keeps_every_score(spark):
    """As the plain algorithm, on scores that differ in the seventh place."""
    share = F.pmod(F.xxhash64("id"), F.lit(10**6)) / 1e6
    data = spark.range(200_000).select(
        (0.3 + F.col("id") * 1e-6).alias("raw_p"),
        (share < 0.3 + F.col("id") * 1e-6).cast("int").alias("y"),
    )
    fit = N.IsotonicCalibrator().fit(data, "y")
    blocks = plain_isotonic([(r.raw_p, 1.0, float(r.y)) for r in data.collect()])
    want = []
    for low, high, w, s in blocks:
        want += [(low, s / w)] if low == high else [(low, s / w), (high, s / w)]
    got = list(zip(fit.model.boundaries.toArray(), fit.model.predictions.toArray()))
    assert len(got) == len(want)
    assert all(a == pytest.approx(b, abs=1e-9) for p, q in zip(got, want) for a, b in zip(p, q))


def test_totals_and_codes_by_ranges(spark):
    rng = random.Random(8)
    data = [(g, s / 997, rng.randint(0, 3), rng.randint(0, 3)) for g in "ab" for s in rng.sample(range(997), 400)]
    df = spark.createDataFrame(data, "g string, score double, pos long, neg long")
    for r in M.totals_above(df, by=["g"]).collect():
        above = [d for d in data if d[0] == r.g and d[1] > r.score]
        assert (r.pos_above, r.neg_above) == (sum(d[2] for d in above), sum(d[3] for d in above))
    words = spark.createDataFrame([(w,) for w in "pear fig apple fig date".split()] + [(None,)], "w string")
    got = {r.w: r.c for r in N.alphabetical_index(words, {"w": "c"}).collect()}
    assert got == {"apple": 0, "date": 1, "fig": 2, "pear": 3, None: None}


def test_values_of_many_sources(spark):
    rng = random.Random(2)
    start = date(2000, 1, 1)
    probes = [(i, start + timedelta(days=rng.randint(0, 300))) for i in range(80)] + [(99, None)]
    weekly = [(start + timedelta(days=7 * i + rng.randint(0, 3)), float(i)) for i in range(40)] + [(None, 7.0)]
    weekly += [(weekly[5][0], 900.0)]
    other = [(start + timedelta(days=rng.randint(0, 300)), i, None if i % 3 else "t") for i in range(30)]

    def last(series, day, offset=0):
        if day is None:
            return None
        known = [v for v in series if v[0] is not None and v[0] <= day - timedelta(days=offset)]
        newest = max((v[0] for v in known), default=None)
        return max((v[1:] for v in known if v[0] == newest), key=lambda v: (v[0], v[-1] or ""), default=None)

    got = A.asof_many(
        spark.createDataFrame(probes, "id int, at date"), "at",
        [A.AsOfSource(spark.createDataFrame(weekly, "d date, w double"), "d", ("w",), (0, 7, 14)),
         A.AsOfSource(spark.createDataFrame(other, "t date, k int, s string"), "t", ("k", "s"))],
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    rows = got.collect()
    assert len(rows) == len(probes)
    for r in rows:
        day = dict(probes)[r.id]
        for offset, value in ((0, r.w), (7, r.w_lag7), (14, r.w_lag14)):
            want = last(weekly, day, offset)
            assert value == (want and want[0])
        want = last(other, day)
        assert (r.k, r.s) == (want or (None, None))


def test_two_predictor_fit_equals_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 2))
    y = 2 + x @ [0.5, -1.5] + rng.normal(size=12)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(12)] + [(50, None, 1.0, 1.0)],
                               "k int, a double, b double, y double")
    got = {r.k: r for r in leave_one_out_fits(df, "k", ("a", "b"), ["y"]).collect()}
    assert set(got) == set(range(12))
    for i in range(12):
        rest = [j for j in range(12) if j != i]
        coef, *_ = np.linalg.lstsq(np.c_[np.ones(11), x[rest]], y[rest], rcond=None)
        assert got[i].fit_y == pytest.approx(coef @ [1, *x[i]], abs=1e-9)


def test_units_of_several_parts(spark):
    def ring(x, y, s):
        return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]

    parts = [("u", [ring(0.0, 0.0, 2.0), ring(0.5, 0.5, 1.0)]), ("u", [ring(10.0, 0.0, 1.0)[::-1]]), ("u", None),
             ("flat", [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]]), ("none", [])]
    df = spark.createDataFrame(parts, "unit string, rings array<array<struct<x:double,y:double>>>")
    got = {r.unit: r for r in G.unit_geometry(df, ["unit"]).collect()}
    u = got["u"]
    assert (u.parts, u.area, u.min_x, u.max_x) == (3, pytest.approx(4.0), 0.0, 11.0)
    assert u.centroid_lon == pytest.approx((3 * 1.0 + 1 * 10.5) / 4) and u.centroid_lat == pytest.approx((3 * 1.0 + 0.5) / 4)
    assert got["flat"].centroid_lon is None and got["none"].parts == 1


def test_crs_names(spark):
    rows = [(1, json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"coordinates": [1.0, 2.0]}}]})),
            (2, json.dumps({"crs": {"properties": {"name": "EPSG:3857"}}, "features": []})), (3, None)]
    got = {r.id: (r.crs, r.problem) for r in G.crs_problems(spark.createDataFrame(rows, "id int, value string"), "id").collect()}
    assert got == {2: ("EPSG:3857", "crs_mismatch"), 3: ("EPSG:4326", "no_features")}
