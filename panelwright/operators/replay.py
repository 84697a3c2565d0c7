"""Historical replay: guarded predictions, advisories, and outcomes joined last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.config import CORE_TARGETS, PANEL, PanelColumns
from panelwright.functions import scalars as S
from panelwright.operators.advisory import crop_advisory
from panelwright.operators.panel import prediction_frame

# Probability limits of the demonstration cases.
CASE_LIMITS = {"false_high": 0.40, "false_low": 0.10, "onset_high": 0.60, "dry_high": 0.50}


def replay_rows(panel: DataFrame, year: int, cols: PanelColumns = PANEL) -> DataFrame:
    return panel.where(F.year(cols.ts) == year)


def guarded_inputs(panel: DataFrame, year: int, features: list[str], cols: PanelColumns = PANEL) -> DataFrame:
    """Replay-year rows without any label column; fails when a feature is absent."""
    return prediction_frame(replay_rows(panel, year, cols), features)


def replay_records(
    predictions: DataFrame, outcomes: DataFrame | None = None, *, crop: str = "aman_rice",
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """Advisory per prediction, then the outcome labels, joined only at the end.

    ``predictions``: key, date, ``p_<head>``, ``outlook_dry_spell``,
    ``outlook_severe_break``; an unknown probability stays null. ``outcomes``: key, date
    and the core label columns. Without that table the labels stand in a column ``outcome``
    of the predictions, a struct that neither scores nor advisories read; it is opened last.
    """
    rounded = {
        f"p_{h}": F.round(S.clip(f"p_{h}", 0.0, 1.0), 4)
        for h in CORE_TARGETS
    }
    advised = crop_advisory(
        predictions.withColumns(rounded).withColumn("crop", F.lit(crop)), date=cols.ts
    )
    if outcomes is None:
        opened = {f"y_{h}": F.col(f"outcome.{c}").cast("int") for h, c in CORE_TARGETS.items()}
        return advised.withColumns(opened).drop("outcome")
    labels = outcomes.select(
        cols.key, cols.ts,
        *[F.col(c).cast("int").alias(f"y_{h}") for h, c in CORE_TARGETS.items()],
    )
    return advised.join(labels, [cols.key, cols.ts])


def replay_order(records: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Records in the order of the replay output: by date, then by key."""
    return records.orderBy(cols.ts, cols.key)


def long_scores(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per record and head with ``p`` and ``y``."""
    return records.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(h).alias("event"),
                        F.col(f"p_{h}").alias("p"),
                        F.col(f"y_{h}").alias("y"),
                    )
                    for h in CORE_TARGETS
                ]
            )
        ).alias("s"),
    ).select(*keys, "s.*")


def _case_tests() -> dict[str, tuple[Column, Column]]:
    """Condition and score of each case, best score first. The names are fixed values."""
    c = F.col
    return {
        "A_HIGH_FALSE_ONSET_ACTUAL": (
            (c("y_false_onset") == 1) & (c("p_false_onset") >= CASE_LIMITS["false_high"]),
            c("p_false_onset"),
        ),
        "B_LOW_FALSE_ONSET_NO_EVENT": (
            (c("y_false_onset") == 0) & (c("p_false_onset") <= CASE_LIMITS["false_low"]),
            1.0 - c("p_false_onset"),
        ),
        "C_HIGH_ONSET_ACTUAL": (
            (c("y_onset") == 1) & (c("p_onset") >= CASE_LIMITS["onset_high"]),
            c("p_onset"),
        ),
        "D_HIGH_DRY_SPELL_ACTUAL": (
            (c("y_dry_spell_5d") == 1) & (c("p_dry_spell_5d") >= CASE_LIMITS["dry_high"]),
            c("p_dry_spell_5d"),
        ),
    }


def select_cases(records: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Best record per case: highest score, then earliest date, then smallest key.

    A min_by aggregate, merged map-side, so a case met by most records stays cheap.
    """
    cases = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(name).alias("case_id"), score.alias("score")))
                for name, (test, score) in _case_tests().items()
            ]
        )
    )
    matches = records.select("*", F.explode(cases).alias("_c")).select("*", "_c.*").drop("_c")
    row = F.struct(*[c for c in records.columns if c not in ("advisory", "risk_factors")],
                   F.col("advisory.rule_id").alias("rule_id"))
    order = F.struct((-F.col("score")).alias("s"), F.col(cols.ts), F.col(cols.key))
    return matches.groupBy("case_id").agg(F.min_by(row, order).alias("r")).select("case_id", "r.*")


def case_timeline(
    cases: DataFrame, panel: DataFrame, *, days: int = 21, cols: PanelColumns = PANEL
) -> DataFrame:
    """Rain of the ``days`` days after each case, nested in date order.

    The case dates are expanded to the wanted days, so the panel is matched by plain
    equality on key and date; at most ``days`` rows are gathered per case.
    """
    wanted = cases.select(
        "case_id", cols.key, F.col(cols.ts).alias("reference_date"),
        F.explode(
            F.sequence(F.date_add(cols.ts, 1), F.date_add(cols.ts, days))
        ).alias(cols.ts),
    )
    follow = wanted.join(panel.select(cols.key, cols.ts, cols.rain), [cols.key, cols.ts])
    return follow.groupBy("case_id", cols.key, "reference_date").agg(
        F.array_sort(F.collect_list(F.struct(F.col(cols.ts).alias("date"), F.col(cols.rain).alias("rain"))))
        .alias("timeline")
    )


def decision_metrics(records: DataFrame) -> DataFrame:
    """How often a false-onset warning was followed by the event and by a dry spell."""
    warned = F.col("advisory.rule_id") == "AGRI-WAIT-FALSE-ONSET-001"
    return records.agg(
        F.count_if(warned).alias("false_onset_wait_records"),
        F.avg(F.when(warned, F.col("y_false_onset"))).alias("followed_by_false_onset_rate"),
        F.avg(F.when(warned, F.col("y_dry_spell_5d"))).alias("followed_by_dry_spell_rate"),
    )
