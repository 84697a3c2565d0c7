"""Training, calibration and selection of event heads with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators.baselines import choose_candidate
from panelwright.operators.metrics import binary_metrics, ordinal_codes
from panelwright.operators.staging import durable

# Settings of the boosted heads (trees, depth, step) and their sampling.
BOOSTED_V1 = {"maxIter": 120, "maxDepth": 5, "stepSize": 0.08}
BOOSTED_V2 = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.05, "minInstancesPerNode": 5}
SAMPLING = {"subsamplingRate": 0.85, "featureSubsetStrategy": "0.85", "seed": 42}


MAX_CLASSES = 1_000


def alphabetical_index(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Ordinal codes in alphabetical order, as in a fitted label encoder; null stays null.

    The distinct values are numbered by ranges (see ``metrics.ordinal_codes``) and joined
    back, so a column may have as many values as it likes.
    """
    out = df
    for column, name in columns.items():
        codes = ordinal_codes(df, column, name)
        out = out.join(codes, column, "left")
    return out.select(*df.columns, *columns.values())


def _assembler(features: list[str], output: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="skip")


def boosted_head(features: list[str], label: str, settings=BOOSTED_V2, weight: str | None = None) -> Pipeline:
    model = GBTClassifier(featuresCol="_x", labelCol=label, **settings, **SAMPLING)
    if weight:
        model.setWeightCol(weight)
    return Pipeline(stages=[_assembler(features, "_x"), model])


def logistic_head(
    features: list[str], label: str, rows: int, c: float = 1.0, weight: str | None = None,
    sparse: float | None = None,
) -> Pipeline:
    """Standardised logistic regression; strength ``c`` per row maps to 1 / (c * rows).

    ``sparse`` is an L1 penalty instead, under which features without use get no weight.
    """
    model = LogisticRegression(
        featuresCol="_x", labelCol=label, standardization=False, maxIter=1000,
        regParam=1.0 / (c * max(rows, 1)) if sparse is None else sparse,
        elasticNetParam=0.0 if sparse is None else 1.0,
    )
    if weight:
        model.setWeightCol(weight)
    return Pipeline(
        stages=[
            _assembler(features, "_raw"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
            model,
        ]
    )


def positive_probability(scored: DataFrame, name: str = "raw_p") -> DataFrame:
    return scored.withColumn(name, F.get(vector_to_array("probability"), F.lit(1)))


def score_with_mask(
    df: DataFrame, model: PipelineModel, mask: Column, name: str = "p", calibrator=None
) -> DataFrame:
    """Score every row in one pass; the probability is null outside the mask.

    With a fitted calibrator the calibrated probability is given, else the raw one.
    """
    if calibrator is None:
        scored = positive_probability(model.transform(df), "_p")
    else:
        raw = positive_probability(model.transform(df), calibrator.raw)
        scored = calibrator.predict(raw, "_p").drop(calibrator.raw)
    kept = scored.withColumn(name, F.when(mask, S.clip("_p", 0.0, 1.0)))
    work = [c for c in kept.columns if c.startswith("_") and c not in df.columns]
    return kept.drop("rawPrediction", "probability", "prediction", *work)


class SigmoidCalibrator:
    """Platt calibration: logistic regression on the logit of the raw probability."""

    def __init__(self, raw: str = "raw_p"):
        self.raw, self.model = raw, None

    def _features(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_logit", array_to_vector(F.array(S.logit(self.raw))))

    def fit(self, df: DataFrame, label: str) -> "SigmoidCalibrator":
        # one weighted row per distinct score and label
        counts = df.groupBy(self.raw, F.col(label).cast("double").alias("_y")).agg(
            F.count(F.lit(1)).cast("double").alias("_w")
        )
        self.model = LogisticRegression(
            featuresCol="_logit", labelCol="_y", weightCol="_w", regParam=0.0,
            standardization=False, maxIter=1000,
        ).fit(self._features(counts))
        return self

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        slope = float(self.model.coefficients[0])
        return df.withColumn(
            name, S.sigmoid(S.logit(self.raw) * F.lit(slope) + F.lit(float(self.model.intercept)))
        )


class IsotonicCalibrator:
    """Monotone calibration, constant outside the fitted range.

    Distinct scores are cut into ranges, and each range pools its adjacent violators into
    blocks (see :func:`pooled_blocks`). Pooling is a mergeable summary: pooling the blocks of
    all ranges gives the fit of all scores, so Spark's isotonic regression gets the blocks'
    ends instead of the scores. No score is rounded; with 0/1 labels the blocks are far
    fewer than the scores.
    """

    def __init__(self, raw: str = "raw_p"):
        self.raw, self.model = raw, None

    def _clipped(self) -> Column:
        return S.clip(self.raw, 1e-6, 1.0 - 1e-6)

    def fit(self, df: DataFrame, label: str) -> "IsotonicCalibrator":
        points = df.groupBy(self._clipped().alias("low")).agg(
            F.count(F.lit(1)).cast("double").alias("w"),
            F.sum(F.col(label).cast("double")).alias("s"),
        ).select("low", F.col("low").alias("high"), "w", "s")
        schema = "low double, high double, w double, s double"
        blocks = points.repartitionByRange("low").sortWithinPartitions("low").mapInArrow(
            pooled_blocks, schema
        )
        ends = blocks.select(
            (F.col("s") / F.col("w")).alias("_y"),
            F.explode(
                F.when(
                    F.col("low") < F.col("high"),
                    F.array(
                        F.struct(F.col("low").alias("_x"), (F.col("w") / 2).alias("_w")),
                        F.struct(F.col("high").alias("_x"), (F.col("w") / 2).alias("_w")),
                    ),
                ).otherwise(F.array(F.struct(F.col("low").alias("_x"), F.col("w").alias("_w"))))
            ).alias("e"),
        ).select("e._x", "_y", "e._w")
        self.model = IsotonicRegression(
            featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="_iso"
        ).fit(ends)
        return self

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        scored = self.model.transform(df.withColumn("_x", self._clipped()))
        return scored.withColumn(name, F.col("_iso")).drop("_x", "_iso")


def pooled_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (low, high, w, s) of ascending means from blocks in ascending order.

    A block whose mean is not above that of the block before it is pooled with it. Only the
    blocks that remain are held.
    """
    lows, highs, weights, sums = [], [], [], []
    for batch in batches:
        for low, high, w, s in zip(*(batch.column(i).to_pylist() for i in range(4))):
            while weights and sums[-1] * w >= s * weights[-1]:
                low, w, s = lows.pop(), w + weights.pop(), s + sums.pop()
                highs.pop()
            lows.append(low)
            highs.append(high)
            weights.append(w)
            sums.append(s)
    if lows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.float64()) for x in (lows, highs, weights, sums)],
            names=["low", "high", "w", "s"],
        )


CALIBRATORS = {"sigmoid": SigmoidCalibrator, "isotonic": IsotonicCalibrator}


def choose_calibration(calibration: DataFrame, selection: DataFrame, label: str):
    """Fit each method on one segment, keep the better on the next, refit on both.

    Better means a smaller Brier score, then a smaller log loss. Returns the method's
    name and the refitted calibrator.
    """
    scores = None
    for method, make in CALIBRATORS.items():
        part = make().fit(calibration, label).predict(selection).select(
            F.lit(method).alias("method"), F.col(label).alias("y"), "p"
        )
        scores = part if scores is None else scores.unionByName(part)
    metrics = binary_metrics(scores, by=["method"])
    best = metrics.orderBy("brier", "log_loss", F.col("method").desc()).first()["method"]
    both = calibration.unionByName(selection, allowMissingColumns=True)
    return best, CALIBRATORS[best]().fit(both, label)


def fit_head(
    data: DataFrame, *, label: str, features: list[str], kind: str, settings=BOOSTED_V2,
    weight: float | None = None, rows_hint: int | None = None,
) -> tuple[PipelineModel, str, object, DataFrame]:
    """Train one candidate on the ``split`` column and calibrate it.

    ``data`` holds eligible rows with splits train, calibration, selection and test.
    ``weight`` is what a positive row counts in a boosted fit (see
    ``baselines.positive_weight``); ``rows_hint`` is the number of training rows, if known.
    Returns model, calibration method, calibrator and the scored selection/test rows.
    """
    rows = data.where(F.col("split").isNotNull()).withColumn(
        label, F.col(label).cast("double")
    )
    train = rows.where("split = 'train'")
    if kind == "logistic":
        model = logistic_head(features, label, rows_hint or train.count()).fit(train)
    else:
        if weight is not None:
            train = train.withColumn("_weight", F.when(F.col(label) == 1.0, weight).otherwise(1.0))
        model = boosted_head(
            features, label, settings, weight="_weight" if weight is not None else None
        ).fit(train)
    held_out = positive_probability(model.transform(rows.where("split != 'train'"))).select(
        *[c for c in data.columns], "raw_p"
    )
    held_out = durable(held_out)
    method, calibrator = choose_calibration(
        held_out.where("split = 'calibration'"), held_out.where("split = 'selection'"), label
    )
    scored = calibrator.predict(held_out.where("split in ('selection', 'test')"))
    return model, method, calibrator, scored


def fit_candidates(
    data: DataFrame, *, label: str, candidates: dict[str, tuple[str, list[str]]],
    parallel: int = 4, settings=BOOSTED_V2,
) -> tuple[dict[str, tuple], DataFrame]:
    """Fit every candidate ``{name: (kind, features)}`` on one durable table.

    Jobs of several candidates run side by side from driver threads. Returns the fits
    and one metrics row per candidate and split.
    """
    base = durable(data)

    def one(item):
        name, (kind, features) = item
        return name, fit_head(
            base, label=label, features=features, kind=kind, settings=settings
        )

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        fits = dict(pool.map(one, candidates.items()))
    scores = None
    for name, (_, method, _, scored) in fits.items():
        part = scored.select(
            F.lit(name).alias("candidate"), F.lit(method).alias("calibration"), "split",
            F.col(label).cast("int").alias("y"), "p",
        )
        scores = part if scores is None else scores.unionByName(part)
    return fits, binary_metrics(scores, by=["candidate", "calibration", "split"])


def pick_candidate(metrics: DataFrame, by: list[str] = ()) -> DataFrame:
    """Smallest selection Brier score; logistic candidates win ties."""
    rows = metrics.where("split = 'selection'").withColumn(
        "_tie", (~F.contains("candidate", F.lit("logistic"))).cast("int")
    )
    if by:
        return choose_candidate(rows, list(by), "brier", "_tie").drop("_tie")
    return rows.orderBy("brier", "_tie", "candidate").limit(1).drop("_tie")


def feature_importances(model: PipelineModel, features: list[str], head: str) -> DataFrame:
    """Importance per feature of a boosted head (absolute weights for a logistic one)."""
    from pyspark.sql import SparkSession

    last = model.stages[-1]
    values = (
        last.featureImportances.toArray()
        if hasattr(last, "featureImportances")
        else abs(last.coefficients.toArray())
    )
    rows = [(head, f, float(v)) for f, v in zip(features, values)]
    return SparkSession.active().createDataFrame(
        rows, "head string, feature string, importance double"
    )


def top_features(importances: DataFrame, k: int = 15) -> DataFrame:
    """Features with the greatest mean importance across heads."""
    mean = importances.groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
    return mean.orderBy(F.desc("mean_importance"), "feature").limit(k)


def multiclass_report(
    df: DataFrame, *, features: list[str] | None = None, vector: str | None = None,
    label: str, classes: list[int] | None = None, seed: int = 45, share: float = 0.8,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Random forest on a random split: model, per-class report and confusion matrix.

    The classes come from the data, so that none is missing from the matrix; more than
    ``MAX_CLASSES`` of them are an error and never a silent cut.
    """
    if classes is None:
        found = df.select(F.col(label).cast("int")).where(f"`{label}` is not null").distinct()
        classes = sorted(r[0] for r in found.limit(MAX_CLASSES + 1).collect())
        if len(classes) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes in {label}")
    x = vector or "_x"
    stages = [] if vector else [_assembler(features or [], x)]
    data = df.withColumn(label, F.col(label).cast("double"))
    train, test = data.randomSplit([share, 1.0 - share], seed=seed)
    forest = RandomForestClassifier(featuresCol=x, labelCol=label, seed=seed)
    model = Pipeline(stages=[*stages, forest]).fit(train)
    pairs = (
        model.transform(test)
        .select(F.col(label).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted"))
        .groupBy("actual", "predicted")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    confusion = pairs.groupBy("actual").pivot("predicted", classes).agg(F.sum("n")).fillna(0)
    per_class = (
        pairs.select(F.explode(F.array(
            F.struct(F.col("actual").alias("class"), F.col("n").alias("support"),
                     F.lit(0).cast("bigint").alias("called"),
                     F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"),
                     F.col("n").alias("called"), F.lit(0).cast("bigint").alias("hit")),
        )).alias("r"))
        .select("r.*")
        .groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    )
    zero = F.lit(0.0)
    report = per_class.select(
        "class", "support",
        F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("called")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("support")), zero).alias("recall"),
        F.coalesce(
            F.try_divide(F.col("hit") * 2.0, F.col("support") + F.col("called")), zero
        ).alias("f1"),
    )
    return model, report, confusion
