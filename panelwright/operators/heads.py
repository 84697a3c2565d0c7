"""Released heads: a store of fitted heads, and masked scoring of all of them in one pass."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import scalars as S

# What a release decides about a head.
MODEL, BASELINE = "PRODUCTION_V2", "BASELINE_PREFERRED"


@dataclass(frozen=True)
class Head:
    """A released head.

    ``kind`` logistic: ``weights`` per unit of each feature and ``intercept`` are the whole
    model, so it is scored as one expression. ``kind`` boosted: the fitted pipeline lies in
    the store. ``slope`` and ``shift`` calibrate on the logit scale (1 and 0: not at all);
    ``points`` (score, probability) is a monotone calibration instead. ``rates`` tells the
    scope of the baseline that serves the head if its release prefers one.
    """

    name: str
    schema: str
    months: tuple[int, ...]
    features: tuple[str, ...]
    kind: str = "logistic"
    intercept: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    points: tuple[tuple[float, float], ...] = ()
    status: str = MODEL

    def missing(self) -> Column:
        """Whether a feature of the head is absent or not finite.

        A function over an array: written out, the tests of all heads make one compiled
        method so long that the JVM leaves it interpreted.
        """
        values = F.array(*[F.col(feature).cast("double") for feature in self.features])
        return F.exists(values, lambda value: ~S.finite(value))

    def in_season(self, ts: str) -> Column:
        return S.in_months(ts, self.months)

    def raw(self) -> Column:
        total = F.lit(float(self.intercept))
        for feature, weight in self.weights.items():
            total = total + F.col(feature).cast("double") * F.lit(float(weight))
        return S.sigmoid(total)

    def calibrated(self, raw: Column) -> Column:
        if self.points:
            return interpolated(raw, self.points)
        if (self.slope, self.shift) == (1.0, 0.0):
            return raw
        return S.sigmoid(S.logit(raw) * F.lit(float(self.slope)) + F.lit(float(self.shift)))


def interpolated(x: Column, points: tuple[tuple[float, float], ...]) -> Column:
    """Monotone calibration: linear between the points, constant outside."""
    xs = F.array(*[F.lit(float(p[0])) for p in points])
    ys = F.array(*[F.lit(float(p[1])) for p in points])
    below = F.size(F.filter(xs, lambda v: v <= x))
    x0, x1 = F.get(xs, below - 1), F.get(xs, below)
    y0, y1 = F.get(ys, below - 1), F.get(ys, below)
    inside = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return F.when(below == 0, F.lit(float(points[0][1]))).when(
        below == len(points), F.lit(float(points[-1][1]))
    ).otherwise(inside)


def linear_weights(model: PipelineModel, features: list[str]) -> tuple[float, dict[str, float]]:
    """(intercept, weight per unit of each feature) of a standardised logistic pipeline."""
    scaler, last = model.stages[-2], model.stages[-1]
    intercept, weights = float(last.intercept), {}
    for name, mean, std, w in zip(
        features, scaler.mean.toArray(), scaler.std.toArray(), last.coefficients.toArray()
    ):
        if w and std:
            weights[name] = float(w / std)
            intercept -= float(w * mean / std)
    return intercept, weights


# --- store ---------------------------------------------------------------------------

def write_heads(
    spark: SparkSession, folder: str, heads: list[Head], models: dict[str, PipelineModel] | None = None
) -> None:
    """Write heads to a folder on shared storage: one row each, and the boosted pipelines.

    The folder must be new. Coefficients also stand in a table of their own (head, feature,
    weight), so that other engines can recompute the scores.
    """
    rows = [(h.name, json.dumps(asdict(h))) for h in heads]
    spark.createDataFrame(rows, "head string, spec string").coalesce(1).write.json(f"{folder}/heads")
    terms = [
        (h.name, feature, float(weight))
        for h in heads
        for feature, weight in [("", h.intercept), *h.weights.items()]
    ]
    spark.createDataFrame(terms, "head string, feature string, weight double").coalesce(1).write.parquet(
        f"{folder}/coefficients"
    )
    for name, model in (models or {}).items():
        model.save(f"{folder}/models/{name}")


def read_heads(spark: SparkSession, folder: str) -> tuple[list[Head], Callable[[str], PipelineModel]]:
    """Heads of a store, in the order of their names, and a loader of the boosted pipelines."""
    heads = []
    for row in spark.read.json(f"{folder}/heads").orderBy("head").collect():
        spec = json.loads(row["spec"])
        spec |= {
            "months": tuple(spec["months"]), "features": tuple(spec["features"]),
            "points": tuple(map(tuple, spec["points"])),
        }
        heads.append(Head(**spec))
    return heads, lambda name: PipelineModel.load(f"{folder}/models/{name}")


# --- scoring -------------------------------------------------------------------------

def score_heads(
    df: DataFrame, heads: list[Head], ts: str = "Date",
    load: Callable[[str], PipelineModel] | None = None, prefix: str = "p_", all_months: bool = False,
) -> DataFrame:
    """Rows with the calibrated probability of every head, in one narrow pass.

    A probability is null out of season (unless ``all_months``), where a feature is absent,
    and for heads whose release prefers the baseline. Logistic heads are expressions inside the code that Spark
    compiles; boosted pipelines transform the same rows one after the other, so nothing is
    shuffled or read twice however many heads there are. No row is dropped.
    """
    out = df
    for head in heads:
        usable = (F.lit(all_months) | head.in_season(ts)) & ~head.missing()
        if head.status == BASELINE:
            value = F.lit(None).cast("double")
        elif head.kind == "logistic":
            value = F.when(usable, S.clip(head.calibrated(head.raw()), 0.0, 1.0))
        else:
            model = load(head.name).copy()
            for stage in model.stages:
                if isinstance(stage, VectorAssembler):
                    stage.setHandleInvalid("keep")
            kept = out.columns
            out = model.transform(out.withColumn("_usable", usable)).withColumn(
                "_raw", F.get(vector_to_array("probability"), F.lit(1))
            )
            out = out.withColumn(
                f"{prefix}{head.name}",
                F.when(F.col("_usable"), S.clip(head.calibrated(F.col("_raw")), 0.0, 1.0)),
            ).select(*kept, f"{prefix}{head.name}")
            continue
        out = out.withColumn(f"{prefix}{head.name}", value)
    return out


def stacked_results(
    df: DataFrame, keys: list[str], heads: list[Head], ts: str = "Date",
    rates: dict[str, str] | None = None, prefix: str = "p_",
) -> DataFrame:
    """Long table of head results: status, probability and number of features.

    ``df`` carries the scores of ``score_heads``; ``rates`` names the column of the baseline
    rate of each head whose release prefers it. A head is OUT_OF_SEASON,
    BASELINE_PREFERRED (with the rate, if one is known), UNAVAILABLE (a feature is absent)
    or APPLICABLE, in this order. Probabilities have 4 places, percentages 2.
    """
    cells = []
    for head in heads:
        rate = F.lit(None).cast("double")
        if head.status == BASELINE and rates and head.name in rates:
            rate = F.col(rates[head.name]).cast("double")
        status = (
            F.when(~head.in_season(ts), "OUT_OF_SEASON")
            .when(rate.isNotNull(), BASELINE)
            .when(head.missing() | F.lit(head.status == BASELINE), "UNAVAILABLE")
            .otherwise("APPLICABLE")
        )
        cells.append(
            F.struct(
                F.lit(head.name).alias("head"), F.lit(head.schema).alias("schema"),
                F.lit(len(head.features)).alias("features"), status.alias("applicability"),
                F.when(status == BASELINE, rate)
                .when(status == "APPLICABLE", F.col(f"{prefix}{head.name}"))
                .alias("_use"),
            )
        )
    rows = df.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")
    p, pct = S.probability_pair("_use")
    return rows.select(
        *keys, "head", "schema",
        F.when(F.col("applicability") == "APPLICABLE", F.col("features")).otherwise(0)
        .alias("features_evaluated"),
        "applicability", p.alias("probability"), pct.alias("probability_pct"),
    )
