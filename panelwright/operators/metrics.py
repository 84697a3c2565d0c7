"""Probability metrics from score-level counts.

Every metric starts from one row per (group, distinct score) with its positives and
negatives, built with a map-side combined aggregation. Metrics that need an order over
all scores add running totals in blocks, so no single task ever sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import clip
from panelwright.operators.staging import durable

ALL = "_all"

def _even_grid(start: float, stop: float, points: int) -> tuple[float, ...]:
    step = (stop - start) / (points - 1)
    return (*[start + i * step for i in range(points - 1)], stop)


# The threshold grids in use. The last one repeats a step that was itself
# computed as a difference of floats, because its thresholds are compared with scores.
GRID_81 = _even_grid(0.1, 0.9, 81)
GRID_91 = _even_grid(0.05, 0.95, 91)
GRID_STEP_2 = tuple(0.05 + i * ((0.05 + 0.02) - 0.05) for i in range(45))


def _group(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn(ALL, F.lit(0)), [ALL])


def score_counts(scores: DataFrame, *, by: list[str], y: str, p: str) -> DataFrame:
    """Positives and negatives per group and distinct (clipped) score; null pairs dropped."""
    kept = scores.where(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(p))
    return (
        kept.groupBy(*by, clip(p, 0.0, 1.0).alias("score"))
        .agg(
            F.sum(F.col(y).cast("bigint")).alias("pos"),
            F.sum(F.lit(1) - F.col(y).cast("bigint")).alias("neg"),
        )
    )


def placed_in_order(df: DataFrame, order: list[Column], name: str = "_part") -> DataFrame:
    """Rows in balanced ranges of an order, numbered by range and staged.

    The ranges follow from a sample of the rows, so there are as many as the session has
    shuffle partitions and none depends on how many rows a group has. Equal rows of the
    order share a range.
    """
    return durable(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


def totals_above(counts: DataFrame, *, by: list[str]) -> DataFrame:
    """Add ``pos_above`` and ``neg_above``: totals over strictly higher scores of the group.

    The scores are cut into ranges (see :func:`placed_in_order`); totals of whole higher
    ranges, a prefix sum over one row per group and range, plus a running sum inside the
    range give the exact result.
    """
    placed = placed_in_order(counts, [*[F.col(c) for c in by], F.desc("score")])
    higher = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = placed.groupBy(*by, "_part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    offsets = per_part.select(
        *by, "_part",
        F.coalesce(F.sum("p").over(higher), F.lit(0)).alias("_p0"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("_n0"),
    )
    inside = Window.partitionBy(*by, "_part").orderBy(F.desc("score")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        placed.join(offsets, [*by, "_part"])
        .withColumns(
            {
                "pos_above": F.col("_p0") + F.coalesce(F.sum("pos").over(inside), F.lit(0)),
                "neg_above": F.col("_n0") + F.coalesce(F.sum("neg").over(inside), F.lit(0)),
            }
        )
        .drop("_p0", "_n0", "_part")
    )


def row_positions(df: DataFrame, name: str) -> DataFrame:
    """Position of every row in the present order of an ordered table, from 0.

    Rows are numbered inside their partition; one count per partition gives its first
    position. The numbered table is staged, so both steps see the same partitions.
    """
    staged = durable(df.withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    return staged.withColumns({"_part": part, "_inside": inside}).join(offsets, "_part").select(
        *df.columns, (F.col("_first") + F.col("_inside")).alias(name)
    )


def ordinal_codes(values: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct non-null values of a column with their position in ascending order.

    Ranges, one count per range and row numbers inside the range; no list of all values
    passes through one task or the driver.
    """
    distinct = values.where(F.col(column).isNotNull()).select(column).distinct()
    placed = placed_in_order(distinct, [F.col(column)])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    )
    inside = Window.partitionBy("_part").orderBy(column)
    return placed.join(offsets, "_part").select(
        column, (F.col("_first") + F.row_number().over(inside) - 1).alias(name)
    )


def _ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def binary_metrics(
    scores: DataFrame, *, by: list[str], y: str = "y", p: str = "p", threshold: float = 0.5
) -> DataFrame:
    """Per group: counts, Brier, log loss, ROC-AUC, average precision, P/R/F1."""
    return metrics_from_counts(
        score_counts(scores, by=by, y=y, p=p), by=by, threshold=threshold
    )


def metrics_from_counts(counts: DataFrame, *, by: list[str], threshold: float = 0.5) -> DataFrame:
    """:func:`binary_metrics` from one row per group and distinct score.

    ``auc_numerator`` / ``auc_denominator`` are the exact integers behind ``roc_auc``
    (twice the favourable pairs, ties counting half); AUC is null with one class only.
    The counts are staged once, in order: whatever produced the scores is not computed
    again.
    """
    counts, keys = _group(counts, by)
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    eps = 2.220446049250313e-16
    safe = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), s))
    hit = s >= F.lit(threshold)
    hits = pos + F.col("pos_above")
    out = totals_above(counts, by=keys).groupBy(*keys).agg(
        F.sum(pos + neg).alias("n"),
        F.sum(pos).alias("events"),
        F.sum(pos * (s - 1.0) * (s - 1.0) + neg * s * s).alias("_sq"),
        F.sum(-(pos * F.ln(safe) + neg * F.ln(F.lit(1.0) - safe))).alias("_ll"),
        F.sum(neg * (F.col("pos_above") * 2 + pos)).alias("auc_numerator"),
        F.sum(pos * _ratio(hits, hits + neg + F.col("neg_above"))).alias("_ap"),
        F.sum(F.when(hit, pos).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("events") - F.col("tp")
    zero = F.lit(0.0)
    out = out.select(
        *by, "n", "events", "tp", "fp",
        _ratio(F.col("_sq"), F.col("n")).alias("brier"),
        _ratio(F.col("_ll"), F.col("n")).alias("log_loss"),
        "auc_numerator",
        (F.col("events") * (F.col("n") - F.col("events")) * 2).alias("auc_denominator"),
        _ratio(
            F.col("auc_numerator"), F.col("events") * (F.col("n") - F.col("events")) * 2
        ).alias("roc_auc"),
        _ratio(F.col("_ap"), F.col("events")).alias("pr_auc"),
        F.coalesce(_ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(_ratio(tp, tp + fn), zero).alias("recall"),
        F.coalesce(_ratio(tp * 2, tp * 2 + fp + fn), zero).alias("f1"),
        _ratio(F.col("events"), F.col("n")).alias("positive_rate"),
    )
    return out


def edge_index(value: Column, edges) -> Column:
    """How many of the ascending ``edges`` are at or below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))


def reliability_bins(
    scores: DataFrame, *, by: list[str], y: str = "y", p: str = "p", bins: int = 10
) -> DataFrame:
    """Count, mean prediction and observed rate in equal bins; the last one is closed."""
    step = 1.0 / bins
    edges = [i * step for i in range(bins)] + [1.0]
    scores, keys = _group(scores, by)
    counts = score_counts(scores, by=keys, y=y, p=p).withColumn(
        "bin", edge_index(F.col("score"), edges[1:-1])
    )
    bounds = F.array(*[F.lit(e) for e in edges])
    out = counts.groupBy(*keys, "bin").agg(
        F.sum(F.col("pos") + F.col("neg")).alias("count"),
        F.sum("pos").alias("events"),
        F.sum(F.col("score") * (F.col("pos") + F.col("neg"))).alias("_sum"),
    )
    return out.select(
        *by, "bin",
        F.get(bounds, F.col("bin")).alias("bin_lower"),
        F.get(bounds, F.col("bin") + 1).alias("bin_upper"),
        "count", "events",
        _ratio(F.col("_sum"), F.col("count")).alias("mean_predicted"),
        _ratio(F.col("events"), F.col("count")).alias("observed_rate"),
    )


def threshold_sweep(
    scores: DataFrame, grid=GRID_81, *, by: list[str], y: str = "y", p: str = "p"
) -> DataFrame:
    """Precision, recall and F1 at every threshold of the grid.

    Scores are first reduced to counts per grid interval (at most one row per
    threshold and group), so the sweep itself costs nothing and joins nothing.
    """
    grid = sorted(float(g) for g in grid)
    scores, keys = _group(scores, by)
    counts = score_counts(scores, by=keys, y=y, p=p).withColumn(
        "step", edge_index(F.col("score"), grid)
    )
    slots = (
        counts.groupBy(*keys, "step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    every = counts.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(len(grid)))).alias("step"),
        F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"),
    )
    full = slots.unionByName(every).groupBy(*keys, "step").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    down = Window.partitionBy(*keys).orderBy(F.desc("step")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    whole = Window.partitionBy(*keys)
    tp, fp = F.sum("pos").over(down), F.sum("neg").over(down)
    swept = full.select(
        *keys, "step", tp.alias("tp"), fp.alias("fp"),
        (F.sum("pos").over(whole) - tp).alias("fn"),
    ).where("step > 0")
    zero = F.lit(0.0)
    limits = F.array(*[F.lit(g) for g in grid])
    return swept.select(
        *by,
        F.get(limits, F.col("step") - 1).alias("threshold"),
        "step", "tp", "fp", "fn",
        F.coalesce(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), zero).alias("precision"),
        F.coalesce(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), zero).alias("recall"),
        F.coalesce(
            _ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")), zero
        ).alias("f1"),
    )


def best_threshold(sweep: DataFrame, *, by: list[str]) -> DataFrame:
    """The first threshold with the greatest F1 of each group."""
    pick = F.max_by(
        F.struct("threshold", "step", "f1"), F.struct(F.col("f1"), (-F.col("step")).alias("s"))
    ).alias("best")
    return sweep.groupBy(*by).agg(pick).select(*by, "best.*")


def skill_against_constant(
    scores: DataFrame, train: DataFrame, *, by: list[str], rate_by: list[str] | None = None,
    y: str = "y", p: str = "p",
) -> DataFrame:
    """Brier score, that of the constant training rate, and the skill of the first.

    ``rate_by`` names the columns of ``by`` that the training rate depends on (default:
    all). The rates meet the aggregated scores, one row per group, and never the rows.
    """
    scores, keys = _group(scores, by)
    if rate_by is None:
        train, rate_keys = _group(train, by)
    else:
        rate_keys = rate_by
    rate = train.groupBy(*rate_keys).agg(
        F.count(y).alias("train_n"), F.sum(F.col(y).cast("bigint")).alias("train_events")
    )
    sums = score_counts(scores, by=keys, y=y, p=p).groupBy(*keys).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("events"),
        F.sum(
            F.col("pos") * (F.col("score") - 1.0) * (F.col("score") - 1.0)
            + F.col("neg") * F.col("score") * F.col("score")
        ).alias("_sq"),
    )
    r = _ratio(F.col("train_events"), F.col("train_n"))
    constant = (
        F.col("events") * (r - 1.0) * (r - 1.0) + (F.col("n") - F.col("events")) * r * r
    )
    return sums.join(rate, rate_keys).select(
        *by, "n", "events",
        _ratio(F.col("_sq"), F.col("n")).alias("brier"),
        _ratio(constant, F.col("n")).alias("climatology_brier"),
        F.coalesce(F.lit(1.0) - _ratio(F.col("_sq"), constant), F.lit(0.0)).alias("skill"),
    )


def exact_percentiles(
    df: DataFrame, value: str, shares: list[float], *, by: list[str], weight: str | None = None,
    name: str = "percentiles",
) -> DataFrame:
    """Exact percentiles per group with linear interpolation, as one array column.

    Spark's own ``percentile`` holds every distinct value of a group in one task. Here
    the distinct values are ranked with blocked running totals and only the two rows
    next to each wanted position are picked, so any number of values is fine.
    ``weight`` gives how often each row's value occurs.
    """
    kept = df.where(F.col(value).isNotNull())
    times = F.sum(weight) if weight else F.count(F.lit(1))
    counts = durable(
        kept.groupBy(*by, F.col(value).cast("double").alias("score")).agg(
            times.alias("pos"), F.lit(0).cast("bigint").alias("neg")
        )
    )
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("_all"))
    ranked = totals_above(counts, by=by).join(totals, by).withColumn(
        "_first", F.col("_all") - F.col("pos_above") - F.col("pos")
    )

    def at(position: Column) -> Column:
        here = position.between(F.col("_first"), F.col("_first") + F.col("pos") - 1)
        return F.max(F.when(here, F.col("score")))

    picks, arrays = [], []
    for i, share in enumerate(shares):
        spot = (F.col("_all") - 1) * F.lit(float(share))
        picks += [at(F.floor(spot)).alias(f"_lo{i}"), at(F.ceil(spot)).alias(f"_hi{i}")]
        part = spot - F.floor(spot)
        arrays.append(F.col(f"_lo{i}") + part * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
    return ranked.groupBy(*by, "_all").agg(*picks).select(*by, F.array(*arrays).alias(name))


def probability_distribution(scores: DataFrame, *, by: list[str], p: str = "p") -> DataFrame:
    """Minimum, percentiles, maximum and the shares above .95 and below .05."""
    marks = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90,
             "p95": 0.95, "p99": 0.99}
    ranges = scores.groupBy(*by).agg(
        F.min(p).alias("min"),
        F.max(p).alias("max"),
        _ratio(F.count_if(F.col(p) > 0.95), F.count(p)).alias("share_above_95"),
        _ratio(F.count_if(F.col(p) < 0.05), F.count(p)).alias("share_below_05"),
    )
    q = exact_percentiles(scores, p, list(marks.values()), by=by)
    return ranges.join(q, by).select(
        *by, "min", *[F.get("percentiles", F.lit(i)).alias(m) for i, m in enumerate(marks)],
        "max", "share_above_95", "share_below_05",
    )


def describe(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum."""
    basics = df.groupBy(*by).agg(
        F.count(column).alias("count"), F.avg(column).alias("mean"),
        F.stddev(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"),
    )
    q = exact_percentiles(df, column, [0.25, 0.5, 0.75], by=by)
    return basics.join(q, by).select(
        *by, "count", "mean", "std", "min",
        *[F.get("percentiles", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))],
        "max",
    )


def feature_shift(train: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """Current mean of each feature against its training distribution.

    Per feature: the current mean and, over the training values, count, mean, sample
    deviation, minimum, percentiles (1, 5, 25, 50, 75, 95, 99), maximum and
    ``train_share_at_or_below``, the share of values not above the current mean. The training
    rows are reduced to counts per distinct value first, and everything is aggregated from
    these; the current means are one map with an entry per feature, handed over as a scalar
    subquery.
    """
    marks = {"p01": 0.01, "p05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "p95": 0.95, "p99": 0.99}
    long = train.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                for f in features
            ])
        ).alias("v")
    ).select("v.*").where(F.col("value").isNotNull())
    means = current.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).select(
        F.create_map(*[x for f in features for x in (F.lit(f), F.col(f))])
    )
    counts = (
        long.groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("current", F.try_element_at(means.scalar(), "feature"))
    )
    n, v = F.col("n"), F.col("value")
    out = counts.groupBy("feature").agg(
        F.max("current").alias("current"),
        F.sum("n").alias("count"),
        F.sum(n * v).alias("_s"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.sum(F.when(v <= F.col("current"), n).otherwise(0)).alias("at_or_below"),
        F.percentile("value", list(marks.values()), n).alias("_q"),
        F.sum(n * v * v).alias("_ss"),
    )
    mean = F.col("_s") / F.col("count")
    spread = F.greatest(F.col("_ss") - F.col("_s") * mean, F.lit(0.0))
    return out.select(
        "feature", "current", "count", mean.alias("mean"),
        F.sqrt(F.try_divide(spread, F.col("count") - 1)).alias("std"), "min",
        *[F.get("_q", F.lit(i)).alias(m) for i, m in enumerate(marks)], "max",
        _ratio(F.col("at_or_below"), F.col("count")).alias("train_share_at_or_below"),
    )
