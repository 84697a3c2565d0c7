"""Training run over all heads: one table, side by side fits, one release per head."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import scalars as S
from panelwright.operators.baselines import positive_weight
from panelwright.operators.learn import BOOSTED_V2, fit_head
from panelwright.operators.metrics import binary_metrics
from panelwright.operators.staging import durable


@dataclass(frozen=True)
class HeadSpec:
    """What is trained for a head: its label, its months, and its candidates by name."""

    name: str
    label: str
    months: tuple[int, ...]
    candidates: dict[str, tuple[str, tuple[str, ...]]]


def eligible_label(spec: HeadSpec, ts: str = "Date"):
    """The label in the months of the head, else null."""
    return F.when(S.in_months(ts, spec.months), F.col(spec.label))


def training_counts(table: DataFrame, specs: list[HeadSpec], ts: str = "Date") -> DataFrame:
    """(head, split, rows, positives, weight): what each head learns from.

    All heads are counted side by side in one pass. The weight of a positive row is the
    negatives per positive of the training rows, between 1 and 25.
    """
    known = table.where(F.col("split").isNotNull())
    sums = known.groupBy("split").agg(
        *[F.count(eligible_label(s, ts)).alias(f"n_{i}") for i, s in enumerate(specs)],
        *[F.sum(eligible_label(s, ts).cast("bigint")).alias(f"s_{i}") for i, s in enumerate(specs)],
    )
    cells = [
        F.struct(
            F.lit(s.name).alias("head"), F.col(f"n_{i}").alias("rows"),
            F.coalesce(f"s_{i}", F.lit(0)).cast("bigint").alias("positives"),
        )
        for i, s in enumerate(specs)
    ]
    rows = sums.select("split", F.explode(F.array(*cells)).alias("c")).select("split", "c.*")
    weight = positive_weight("positives", "_negatives")
    return rows.withColumn("_negatives", F.col("rows") - F.col("positives")).select(
        "head", "split", "rows", "positives",
        F.when(F.col("split") == "train", weight).alias("weight"),
    )


def fit_heads(
    table: DataFrame, specs: list[HeadSpec], *, ts: str = "Date", parallel: int = 8,
    settings=BOOSTED_V2, keep: tuple[str, ...] = (),
) -> tuple[dict[tuple[str, str], tuple], DataFrame]:
    """Fit every candidate of every head.

    The table (features, all labels, split) is staged once; every fit reads the columns it
    needs from it. Fits run side by side from driver threads, each under a scheduler pool of
    its own, so that with ``spark.scheduler.mode=FAIR`` the many small jobs of a boosted fit
    share the cluster. Boosted fits weigh positives (see :func:`training_counts`). A head
    with an empty split has no candidates. Returns the fits by (head, candidate) and one
    metrics row per head, candidate and split.
    """
    base = durable(table.where(F.col("split").isNotNull()))
    counts = {(r["head"], r["split"]): r for r in training_counts(base, specs, ts).collect()}
    spark = table.sparkSession
    jobs = []
    for spec in specs:
        sizes = [
            counts[spec.name, s]["rows"] if (spec.name, s) in counts else 0
            for s in ("train", "calibration", "selection", "test")
        ]
        train = counts.get((spec.name, "train"))
        if min(sizes) and 0 < train["positives"] < train["rows"]:
            jobs += [(spec, name, *c, train) for name, c in spec.candidates.items()]

    @inheritable_thread_target(spark)
    def one(job):
        spec, name, kind, features, train = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{spec.name}-{name}")
        rows = base.select(
            *keep, ts, "split", *features, eligible_label(spec, ts).alias("_label")
        ).where(F.col("_label").isNotNull())
        fit = fit_head(
            rows, label="_label", features=list(features), kind=kind, settings=settings,
            weight=float(train["weight"]), rows_hint=train["rows"],
        )
        return (spec.name, name), fit

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        fits = dict(pool.map(one, jobs))
    scores = None
    for (head, name), (_, method, _, scored) in fits.items():
        part = scored.select(
            F.lit(head).alias("head"), F.lit(name).alias("candidate"),
            F.lit(method).alias("calibration"), "split",
            F.col("_label").cast("int").alias("y"), "p",
        )
        scores = part if scores is None else scores.unionByName(part)
    return fits, binary_metrics(scores, by=["head", "candidate", "calibration", "split"])
