"""Train the logistic heads of the release and print them as written in ``released``.

    python -m panelwright.plans.train_heads <table folder>
"""

from __future__ import annotations

import sys
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from panelwright.config import CORE_MONTHS, CORE_TARGETS, FEATURE_SCHEMAS, HEAD_ROUTES, HORIZON_MONTHS
from panelwright.functions import scalars as S
from panelwright.operators import baselines as B
from panelwright.operators import heads as H
from panelwright.operators import learn as N
from panelwright.operators.staging import durable

SPARSE = 0.015
TRAIN_UNTIL = 1998


def release_specs():
    """(head, label, months, schema) of the core heads and of the two outlook heads."""
    for name, label in CORE_TARGETS.items():
        yield name, label, CORE_MONTHS[name], HEAD_ROUTES[name][1]
    for event in ("dry_spell", "severe_break"):
        yield f"outlook_{event}", f"target_{event}_7_14d", HORIZON_MONTHS[event], "horizon"


def train(rows) -> list[H.Head]:
    """A sparse logistic head per label, calibrated by Platt's method, released or not by its
    Brier score against the rates of district and month, and of the month, on later rows."""
    def one(spec):
        name, label, months, schema = spec
        features = FEATURE_SCHEMAS[schema]
        data = rows.where(S.in_months("Date", months) & F.col(label).isNotNull()).withColumn(
            "_y", F.col(label).cast("double")
        )
        learn = data.where("split = 'train'")
        fit = N.logistic_head(list(features), "_y", 1, sparse=SPARSE).fit(learn)
        intercept, weights = H.linear_weights(fit, features)
        weights = {f: float(f"{w:.6g}") for f, w in weights.items()}
        head = H.Head(name, schema, tuple(months), tuple(weights), intercept=round(intercept, 6), weights=weights)
        held = data.where("split = 'calibration'").withColumn("raw_p", head.raw())
        slope, shift = 1.0, 0.0
        if held.select("_y").distinct().count() == 2 and weights:
            model = N.SigmoidCalibrator().fit(held, "_y").model
            slope, shift = round(float(model.coefficients[0]), 6), round(float(model.intercept), 6)
        if slope <= 0:
            slope, shift = 1.0, 0.0
        month = F.month("Date").alias("_m")
        rates = learn.groupBy("District", month).agg(F.avg("_y").alias("_rate")).join(
            learn.groupBy(month).agg(F.avg("_y").alias("_month")), "_m"
        )
        test = data.where("split in ('selection', 'test')").withColumn("_m", F.month("Date"))
        p = H.Head(name, schema, tuple(months), tuple(weights), intercept=round(intercept, 6), weights=weights,
                   slope=slope, shift=shift)
        row = test.join(rates, ["District", "_m"], "left").agg(
            F.avg((p.calibrated(p.raw()) - F.col("_y")) ** 2).alias("model"),
            F.avg((F.coalesce("_rate", F.lit(0.0)) - F.col("_y")) ** 2).alias("rate"),
            F.avg((F.coalesce("_month", F.lit(0.0)) - F.col("_y")) ** 2).alias("month"),
        ).first()
        best = min(row["rate"], row["month"])
        status = H.MODEL if row["model"] is not None and row["model"] <= best else H.BASELINE
        print(name, label, row, file=sys.stderr)
        return H.Head(name, schema, tuple(months), tuple(weights), "logistic", round(intercept, 6), weights,
                      slope, shift, (), status)

    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(one, release_specs()))


def main() -> None:
    from pyspark.sql import SparkSession

    from panelwright.plans import head_queries as Q

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "10g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    folder = sys.argv[1]
    panel = Q.with_vectors(spark, folder, Q.labelled_rows(spark, folder), Q.month_ends(spark, folder))
    for head in train(durable(B.with_purged_split(panel, "Date", train_until=TRAIN_UNTIL))):
        print(f"    {head!r},")


if __name__ == "__main__":
    main()
