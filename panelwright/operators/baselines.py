"""Rate baselines, temporal splits, class balance and release rules.

``by`` always names at least one column, such as the event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.config import SPLIT_GAP_DAYS
from panelwright.operators.metrics import exact_percentiles


# --- splits ------------------------------------------------------------------

def with_year_split(df: DataFrame, ts: str, *, train_until: int, validate: int, test: int) -> DataFrame:
    """Split by calendar year; other rows get a null split."""
    y = F.year(ts)
    return df.withColumn(
        "split",
        F.when(y <= train_until, "train").when(y == validate, "validation").when(y == test, "test"),
    )


def with_purged_split(
    df: DataFrame, ts: str, *, train_until: int, gap_days: int = SPLIT_GAP_DAYS
) -> DataFrame:
    """Split with a gap at the end of each segment so that labels cannot overlap.

    Training ends with ``train_until``; the first half of the next year calibrates, the
    second half selects, the year after tests. Rows in a gap get a null split.
    """
    def before_year_end(year: int) -> Column:
        return F.date_sub(F.to_date(F.lit(f"{year}-12-31")), gap_days)

    def day(text: str) -> Column:
        return F.to_date(F.lit(text))

    d, mid = F.col(ts), train_until + 1
    return df.withColumn(
        "split",
        F.when(d <= before_year_end(train_until), "train")
        .when(d.between(day(f"{mid}-01-01"), day(f"{mid}-06-30")), "calibration")
        .when((d >= day(f"{mid}-07-01")) & (d <= before_year_end(mid)), "selection")
        .when(
            (d >= day(f"{mid + 1}-01-01")) & (d <= before_year_end(mid + 1)), "test"
        ),
    )


def eligible(label: str, ts: str, months) -> Column:
    """Label known and the month applicable."""
    return F.col(label).isNotNull() & F.month(ts).isin([int(m) for m in months])


def unpivot_labels(
    df: DataFrame, keys: list[str], targets: dict[str, str], name: str = "event"
) -> DataFrame:
    """Long label table: one row per input row and event."""
    return df.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(event).alias(name), F.col(c).cast("int").alias("y"))
                    for event, c in targets.items()
                ]
            )
        ).alias("_l"),
    ).select(*keys, "_l.*")


def class_balance(long: DataFrame, by: list[str]) -> DataFrame:
    """Eligible, positive, negative and unknown counts, positive rate, positive weight."""
    pos, neg = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    out = long.groupBy(*by).agg(
        F.count("y").alias("eligible"), pos.alias("positive"), neg.alias("negative"),
        F.count_if(F.col("y").isNull()).alias("unknown"),
    )
    return out.withColumns(
        {
            "positive_rate": F.try_divide(F.col("positive").cast("double"), F.col("eligible")),
            "positive_weight": positive_weight("positive", "negative"),
        }
    )


def positive_weight(positive: str, negative: str) -> Column:
    """Negatives per positive, between 1 and 25."""
    ratio = F.col(negative) / F.greatest(F.lit(1), F.col(positive))
    return F.least(F.lit(25.0), F.greatest(F.lit(1.0), ratio))


# --- rate baselines ----------------------------------------------------------

def label_counts(
    df: DataFrame, keys: list[str], targets: dict[str, str], name: str = "event"
) -> DataFrame:
    """Known labels ``n`` and events per key columns and event.

    The label columns are aggregated side by side in one pass and stacked afterwards, so
    the panel rows are neither multiplied by the number of events nor read again. With
    (split, key, month) or (split, state) as keys this small table is all that the rate
    baselines and their scores need.
    """
    wide = df.groupBy(*keys).agg(
        *[F.count(c).alias(f"_n_{e}") for e, c in targets.items()],
        *[F.sum(F.col(c).cast("bigint")).alias(f"_s_{e}") for e, c in targets.items()],
    )
    cells = [
        F.struct(
            F.lit(e).alias(name), F.col(f"_n_{e}").alias("n"), F.col(f"_s_{e}").alias("events")
        )
        for e in targets
    ]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")


def fallback_rates(counts: DataFrame, by: list[str], key: str, month: str = "month") -> DataFrame:
    """Mean label per (key, month), per month and overall in one grouping-sets pass.

    ``counts`` comes from :func:`label_counts`. ``level`` is 0, 1 or 2; finer columns
    are null at coarser levels.
    """
    sets = [[*by, key, month], [*by, month], [*by]]
    grouped = counts.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*by, key, month]]
    )
    rates = grouped.agg(
        F.sum("n").alias("n"),
        F.sum("events").alias("events"),
        F.grouping(key).alias("_no_key"),
        F.grouping(month).alias("_no_month"),
    )
    return rates.where(F.col("n") > 0).select(
        *by, key, month,
        (F.col("_no_key") + F.col("_no_month")).cast("int").alias("level"),
        "n", "events",
        (F.col("events").cast("double") / F.col("n")).alias("rate"),
    )


def lookup_rates(
    df: DataFrame, rates: DataFrame, by: list[str], key: str, month: str = "month",
    *, month_only: str | None = None, key_only: str | None = None,
) -> DataFrame:
    """Add ``p``: rate of (key, month), else of the month, else overall, and its level.

    The month and overall levels have at most thirteen rows per event and are folded
    into one map per event; only the (key, month) level is a real join. ``month_only``
    names an extra column with the rate that ignores the key, ``key_only`` one that falls
    from (key, month) straight to the overall rate. There are few groups ``by`` and many
    rows in each, so the maps are broadcast and the rows never gathered by group.
    """
    coarse = (
        rates.where(F.col("level") > 0)
        .groupBy(*by)
        .agg(
            F.map_from_entries(
                F.collect_list(
                    F.when(F.col("level") == 1, F.struct(F.col(month), F.col("rate")))
                )
            ).alias("_months"),
            F.max(F.when(F.col("level") == 2, F.col("rate"))).alias("_overall"),
        )
    )
    fine = rates.where(F.col("level") == 0).select(
        *by, key, month, F.col("rate").alias("_fine")
    )
    by_month = F.try_element_at("_months", F.col(month))
    out = (
        df.join(fine, [*by, key, month], "left")
        .join(F.broadcast(coarse), by, "left")
        .withColumns(
            {
                "p": F.coalesce("_fine", by_month, "_overall"),
                "rate_level": F.when(F.col("_fine").isNotNull(), 0)
                .when(by_month.isNotNull(), 1)
                .otherwise(2),
            }
        )
    )
    if month_only:
        out = out.withColumn(month_only, F.coalesce(by_month, "_overall"))
    if key_only:
        out = out.withColumn(key_only, F.coalesce("_fine", "_overall"))
    return out.drop("_fine", "_months", "_overall")


def state_rates(counts: DataFrame, by: list[str], state: str, shares=(0.33, 0.66)) -> DataFrame:
    """Per group: exact state quantiles of the training rows and the mean label per bucket.

    ``counts`` holds ``n`` and ``events`` per group and state value, see
    :func:`label_counts`.
    """
    known = counts.where(F.col("n") > 0)
    overall = known.groupBy(*by).agg((F.sum("events") / F.sum("n")).alias("overall"))
    edges = exact_percentiles(
        known, state, list(shares), by=by, weight="n", name="edges"
    ).join(overall, by)
    per_bucket = known.join(edges, by).groupBy(
        *by, state_bucket(F.col(state)).alias("bucket")
    ).agg(
        F.any_value("edges").alias("edges"),
        F.any_value("overall").alias("overall"),
        (F.sum("events") / F.sum("n")).alias("rate"),
    )
    return per_bucket.groupBy(*by).agg(
        F.any_value("edges").alias("edges"),
        F.any_value("overall").alias("overall"),
        F.map_from_entries(F.collect_list(F.struct("bucket", "rate"))).alias("rates"),
    )


def snapped_states(df: DataFrame, rates: DataFrame, state: str) -> DataFrame:
    """Each state raised to the next edge of any group, or to infinity above all edges.

    A value is at or below an edge exactly when the raised one is, so every bucket stays the
    same, and counts per state have no more rows than there are edges, and one. ``rates``
    comes from :func:`state_rates`; its edges reach the rows as a scalar subquery.
    """
    edges = rates.select(F.explode("edges").alias("_e")).agg(F.collect_set("_e")).scalar()
    raised = F.array_min(F.filter("_edges", lambda e: e >= F.col(state)))
    return df.withColumn("_edges", edges).withColumn(
        state, F.coalesce(raised, F.lit(float("inf")))
    ).drop("_edges")


def state_bucket(value: Column, edges: str = "edges") -> Column:
    """0, 1 or 2: at or below the first edge, the second edge, above."""
    return (
        F.when(value <= F.get(edges, F.lit(0)), 0)
        .when(value <= F.get(edges, F.lit(1)), 1)
        .otherwise(2)
    )


def state_baseline(rows: DataFrame, rates: DataFrame, by: list[str], state: str) -> DataFrame:
    """Add ``p``: the training rate of the row's state bucket, else the overall rate.

    ``rates`` has one row per group and is broadcast, see :func:`lookup_rates`.
    """
    bucket = state_bucket(F.col(state))
    return rows.join(F.broadcast(rates), by).withColumn(
        "p", F.coalesce(F.try_element_at("rates", bucket), "overall")
    ).drop("edges", "rates", "overall")


# --- rules over metric tables --------------------------------------------------

def release_gate(metrics: DataFrame) -> DataFrame:
    """PRODUCTION_V2 or BASELINE_PREFERRED per head, with the reasons.

    Needs validation_brier, validation_climatology_brier, test_brier, test_roc_auc,
    test_pr_auc, climatology_brier, district_brier, state_brier, climatology_pr_auc.
    """
    best = F.least("climatology_brier", "district_brier", "state_brier")
    ok = F.col("validation_brier") <= F.col("validation_climatology_brier") * 1.05
    better = best < F.col("test_brier")
    weak = (F.col("test_roc_auc") < 0.5) | (
        F.col("test_pr_auc") < F.col("climatology_pr_auc") * 0.95
    )
    out = metrics.withColumns(
        {
            "validation_protected": F.coalesce(ok, F.lit(False)),
            "best_baseline_brier": best,
            "baseline_better": F.coalesce(better, F.lit(False)),
            "weak_discrimination": F.coalesce(weak, F.col("test_roc_auc") < 0.5, F.lit(False)),
        }
    )
    preferred = (
        ~F.col("validation_protected") | F.col("baseline_better") | F.col("weak_discrimination")
    )
    return out.withColumn(
        "release_status", F.when(preferred, "BASELINE_PREFERRED").otherwise("PRODUCTION_V2")
    )


def choose_candidate(metrics: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The row with the smallest ordering columns in each group."""
    row = F.struct(*[c for c in metrics.columns if c not in by])
    return metrics.groupBy(*by).agg(
        F.min_by(row, F.struct(*order)).alias("chosen")
    ).select(*by, "chosen.*")


def ablation_choice(brier_a: str, auc_a: str, brier_b: str, auc_b: str) -> Column:
    """Keep the enhanced variant B when its Brier score is not worse, or nearly so
    with a ROC-AUC that is not worse."""
    a, b = F.col(brier_a), F.col(brier_b)
    enhanced = (b <= a) | ((F.col(auc_b) >= F.col(auc_a)) & (b <= a + 0.001))
    return F.when(enhanced, "ATMOSPHERIC_ENHANCED").otherwise("RETAIN_BASELINE")


def improvement_status(d_brier: Column, d_roc: Column, d_pr: Column, d_f1: Column) -> Column:
    """Verdict on metric differences (enhanced minus base)."""
    def count(*flags: Column) -> Column:
        return sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))

    up = count(d_brier < -0.0005, d_roc > 0.002, d_pr > 0.005, d_f1 > 0.005)
    down = count(d_brier > 0.0005, d_roc < -0.002, d_pr < -0.005, d_f1 < -0.005)
    return (
        F.when((up >= 2) & (down == 0), "IMPROVED")
        .when((down >= 2) & (up == 0), "SLIGHT_REGRESSION")
        .when(up >= 1, "SLIGHT_IMPROVEMENT")
        .when(down >= 1, "NEUTRAL_TO_SLIGHT_REGRESSION")
        .otherwise("NEUTRAL")
    )


# --- covariates ----------------------------------------------------------------

def leave_one_out_fit(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Held-out linear fit per key: sums over all keys minus the key's own row.

    ``df`` has one row per key. The five sums reach the rows as a scalar subquery.
    """
    one = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    totals = one.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.sum("_x").alias("sx"),
            F.sum("_y").alias("sy"),
            F.sum(F.col("_x") * F.col("_x")).alias("sxx"),
            F.sum(F.col("_x") * F.col("_y")).alias("sxy"),
        )
    ).scalar()
    n = F.col("_t.n") - 1
    sx, sy = F.col("_t.sx") - F.col("_x"), F.col("_t.sy") - F.col("_y")
    sxx = F.col("_t.sxx") - F.col("_x") * F.col("_x")
    sxy = F.col("_t.sxy") - F.col("_x") * F.col("_y")
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    return (
        one.withColumn("_t", totals)
        .withColumn("slope", slope)
        .withColumn("intercept", (sy - F.col("slope") * sx) / n)
        .withColumn("held_out_fit", F.col("intercept") + F.col("slope") * F.col("_x"))
        .withColumn("held_out_error", F.col("_y") - F.col("held_out_fit"))
        .select(key, "slope", "intercept", "held_out_fit", "held_out_error")
    )


def leave_one_out_fits(df: DataFrame, key: str, predictors: tuple[str, str], outcomes: list[str]) -> DataFrame:
    """Held-out fits of several outcomes on two predictors: the normal equations of all rows
    less the key's own, solved per row in columns.

    ``df`` has one row per key; rows with an unknown predictor or outcome take no part. All
    sums reach the rows as one scalar subquery. Result: key, and per outcome
    ``fit_<outcome>`` and ``error_<outcome>``; null where the others do not determine a fit.
    """
    names = {"a": predictors[0], "b": predictors[1], **{f"y{i}": y for i, y in enumerate(outcomes)}}
    known = F.lit(True)
    for column in names.values():
        known = known & F.col(column).isNotNull()
    rows = df.where(known).select(
        key, *[F.col(column).cast("double").alias(f"_{n}") for n, column in names.items()]
    )
    products = ["a", "b", "aa", "ab", "bb"]
    for i in range(len(outcomes)):
        products += [f"y{i}", f"ay{i}", f"by{i}"]

    def factors(name: str) -> Column:
        rest, out = name, None
        while rest:
            part = rest if rest.startswith("y") else rest[0]
            rest = rest[len(part):]
            out = F.col(f"_{part}") if out is None else out * F.col(f"_{part}")
        return out

    totals = rows.agg(
        F.struct(F.count(F.lit(1)).alias("n"), *[F.sum(factors(p)).alias(p) for p in products])
    ).scalar()
    rows = rows.withColumn("_t", totals)
    n = (F.col("_t.n") - 1).cast("double")
    s = {p: F.col(f"_t.{p}") - factors(p) for p in products}

    def centred(p: str, u: str, v: str) -> Column:
        return s[p] - s[u] * s[v] / n

    aa, bb, ab = centred("aa", "a", "a"), centred("bb", "b", "b"), centred("ab", "a", "b")
    det = aa * bb - ab * ab
    out = [F.col(key)]
    for i, outcome in enumerate(outcomes):
        ay, by = centred(f"ay{i}", "a", f"y{i}"), centred(f"by{i}", "b", f"y{i}")
        first, second = F.try_divide(ay * bb - by * ab, det), F.try_divide(by * aa - ay * ab, det)
        constant = (s[f"y{i}"] - first * s["a"] - second * s["b"]) / n
        fit = constant + first * F.col("_a") + second * F.col("_b")
        out += [fit.alias(f"fit_{outcome}"), (F.col(f"_y{i}") - fit).alias(f"error_{outcome}")]
    return rows.select(*out)
