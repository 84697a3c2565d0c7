"""Queries that train models; their results are checked by properties, not by SQL."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators import baselines as B
from panelwright.operators import learn as N
from panelwright.operators import metrics as M
from panelwright.plans.catalog import query, tidy
from panelwright.plans.tables import table

LOCAL = ["rain", "wet_days", "largest", "month_sin", "month_cos"]
FULL = [*LOCAL, "rain_before", "open_share", "returned_share"]
SMALL_TREES = {"maxIter": 12, "maxDepth": 3, "stepSize": 0.1, "minInstancesPerNode": 5}


def month_features(spark, sf_dir):
    """Per supplier and month: rain features, and whether next month is wetter than 220."""
    c = F.col
    month = F.date_trunc("month", "l_shipdate").cast("date")
    monthly = table(spark, sf_dir, "lineitem").groupBy(
        c("l_suppkey").alias("District"), month.alias("Date")
    ).agg(
        F.sum("l_quantity").alias("rain"), F.countDistinct("l_shipdate").cast("double").alias("wet_days"),
        F.max("l_quantity").alias("largest"),
        F.avg((c("l_linestatus") == "O").cast("double")).alias("open_share"),
        F.avg((c("l_returnflag") == "R").cast("double")).alias("returned_share"),
    )
    w = Window.partitionBy("District").orderBy("Date")
    rows = monthly.withColumns(
        {
            "month_sin": S.cycle_sin(F.month("Date"), 12.0),
            "month_cos": S.cycle_cos(F.month("Date"), 12.0),
            "rain_before": F.coalesce(F.lag("rain").over(w), F.lit(0.0)),
            "label": (F.lead("rain").over(w) >= 220).cast("double"),
        }
    )
    split = B.with_purged_split(rows, "Date", train_until=1998)
    return split.where(F.col("label").isNotNull() & F.col("split").isNotNull())


CANDIDATES = {
    "logistic_local": ("logistic", LOCAL),
    "boosted_local": ("boosted", LOCAL),
    "boosted_full": ("boosted", FULL),
}


def _fits(spark, sf_dir, candidates):
    return N.fit_candidates(
        month_features(spark, sf_dir), label="label", candidates=candidates, settings=SMALL_TREES
    )


@query("candidate_heads")
def candidate_heads(spark, sf_dir):
    """Selection and test metrics of every candidate, the chosen one marked."""
    _, metrics = _fits(spark, sf_dir, CANDIDATES)
    chosen = N.pick_candidate(metrics).select("candidate", F.lit(1).alias("chosen"))
    out = metrics.join(chosen, "candidate", "left")
    return tidy(
        out.select("candidate", "calibration", "split", "n", "events", "brier", "log_loss", "roc_auc",
                   "pr_auc", F.coalesce("chosen", F.lit(0)).alias("chosen"))
    )


@query("head_feature_importance")
def head_feature_importance(spark, sf_dir):
    fits, _ = _fits(spark, sf_dir, {k: v for k, v in CANDIDATES.items() if k != "logistic_local"})
    tables = [
        N.feature_importances(fit[0], CANDIDATES[name][1], name) for name, fit in fits.items()
    ]
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return tidy(N.top_features(both, 15))


@query("calibrated_head_reliability")
def calibrated_head_reliability(spark, sf_dir):
    fits, _ = _fits(spark, sf_dir, {"logistic_local": CANDIDATES["logistic_local"]})
    scored = fits["logistic_local"][3].withColumn("y", F.col("label").cast("int"))
    return tidy(M.reliability_bins(scored, by=["split"]))


@query("masked_head_scores")
def masked_head_scores(spark, sf_dir):
    """Scores in one pass; null outside the months in which the head applies."""
    fits, _ = _fits(spark, sf_dir, {"logistic_local": CANDIDATES["logistic_local"]})
    rows = month_features(spark, sf_dir).where("split = 'test'").select("District", "Date", *LOCAL)
    model, _, calibrator, _ = fits["logistic_local"]
    season = F.month("Date").between(6, 10)
    scored = N.score_with_mask(rows, model, season, calibrator=calibrator)
    return tidy(scored.select(F.col("District").alias("district"), F.col("Date").alias("day"), "p"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"), "label"
    )


@query("multiclass_report")
def multiclass_report(spark, sf_dir):
    _, report, _ = N.multiclass_report(_vectors(spark, sf_dir), vector="x", label="label")
    return tidy(report)


@query("multiclass_confusion")
def multiclass_confusion(spark, sf_dir):
    _, _, confusion = N.multiclass_report(_vectors(spark, sf_dir), vector="x", label="label")
    return tidy(confusion)
