"""Queries for metrics, baselines, splits, release rules and covariate fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.config import CORE_MONTHS, CORE_TARGETS
from panelwright.functions import scalars as S
from panelwright.operators import baselines as B
from panelwright.operators import labels as L
from panelwright.operators import metrics as M
from panelwright.operators.learn import alphabetical_index
from panelwright.operators.staging import durable, staged
from panelwright.operators.windows import series, trailing_sum
from panelwright.plans.catalog import query, tidy
from panelwright.plans.panel_queries import V2_LABELS, big
from panelwright.plans.tables import TEST_RULES, sparse_weather, table, weather_panel

TRAIN_UNTIL = 1998


def document_scores(spark, sf_dir):
    """Document length as a score for the two document labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    both = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    p = F.least(F.lit(1.0), F.col("n_chars") / 20000.0)
    return B.unpivot_labels(
        both.withColumn("p", p), ["doc_id", "lang", "p"], {"quality": "quality", "toxic": "toxic"}
    )


DOC_SQL = """
sc as (select event, lang, y, p from (
  select doc_id, lang, least(1e0, n_chars / 20000e0) as p, unnest(['quality', 'toxic']) as event, unnest([quality, toxic]) as y
  from documents join labels using (doc_id)))"""


def metrics_sql(source: str, threshold: str, keys: str = "event") -> str:
    return f"""
mt as (select {keys}, p as s, sum(y) as pos, sum(1 - y) as neg from {source} where y is not null and p is not null group by all),
cu as (select *, coalesce(sum(pos) over w, 0) as pa, coalesce(sum(neg) over w, 0) as na from mt
  window w as (partition by {keys} order by s desc rows between unbounded preceding and 1 preceding)),
ag2 as (select {keys}, cast(sum(pos + neg) as bigint) as n, cast(sum(pos) as bigint) as events,
  sum(pos * (s - 1) * (s - 1) + neg * s * s) / sum(pos + neg) as brier,
  sum(-(pos * ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, s)))
    + neg * ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, s))))) / sum(pos + neg) as log_loss,
  cast(sum(neg * (2 * pa + pos)) as bigint) as auc_numerator, cast(2 * sum(pos) * sum(neg) as bigint) as auc_denominator,
  case when sum(pos) > 0 then sum(pos * ((pos + pa) / cast(pos + pa + neg + na as double))) / sum(pos) end as pr_auc,
  cast(sum(case when s >= {threshold} then pos else 0 end) as bigint) as tp,
  cast(sum(case when s >= {threshold} then neg else 0 end) as bigint) as fp from cu group by all),
me as (select *, case when auc_denominator > 0 then auc_numerator / cast(auc_denominator as double) end as roc_auc,
  coalesce(tp / nullif(cast(tp + fp as double), 0), 0) as prec, coalesce(tp / nullif(cast(events as double), 0), 0) as rec,
  coalesce(2 * tp / nullif(cast(tp + fp + events as double), 0), 0) as f1 from ag2)"""


METRIC_OUT = """n, events, tp, fp, auc_numerator, auc_denominator, cast(round(brier * 1e6) as bigint) as brier,
  cast(round(log_loss * 1e6) as bigint) as log_loss, cast(round(roc_auc * 1e6) as bigint) as roc_auc, cast(round(pr_auc * 1e6) as bigint) as pr_auc,
  cast(round(prec * 1e6) as bigint) as "precision", cast(round(rec * 1e6) as bigint) as recall, cast(round(f1 * 1e6) as bigint) as f1"""


def metric_columns(*keys):
    return [
        *keys, "n", "events", "tp", "fp", "auc_numerator", "auc_denominator",
        *[S.scaled(c, 6).alias(c) for c in
          ("brier", "log_loss", "roc_auc", "pr_auc", "precision", "recall", "f1")],
    ]


@query("document_score_metrics", f"""
with {DOC_SQL}, {metrics_sql('sc', '0.05')} select event, {METRIC_OUT} from me
""")
def document_score_metrics(spark, sf_dir):
    scores = document_scores(spark, sf_dir)
    return tidy(M.binary_metrics(scores, by=["event"], threshold=0.05).select(*metric_columns("event")))


@query("language_score_metrics", f"""
with {DOC_SQL}, {metrics_sql('sc', '0.05', 'event, lang')} select event, lang, {METRIC_OUT} from me
""")
def language_score_metrics(spark, sf_dir):
    scores = document_scores(spark, sf_dir)
    out = M.binary_metrics(scores, by=["event", "lang"], threshold=0.05)
    return tidy(out.select(*metric_columns("event", "lang")))


def _edges(values) -> str:
    """Sum of comparisons that counts how many edges are at or below p."""
    return " + ".join(f"(p >= {v:.17e})::int" for v in values)


BIN_EDGES = [i * 0.1 for i in range(1, 10)]


@query("document_reliability", f"""
with {DOC_SQL}, b as (select event, y, p, {_edges(BIN_EDGES)} as bin from sc)
select event, bin, count(*) as count, cast(sum(y) as bigint) as events, cast(round(avg(p) * 1e6) as bigint) as mean_predicted,
 cast(round(avg(y) * 1e6) as bigint) as observed_rate, cast(bin as bigint) * 10 as lower from b group by 1, 2
""")
def document_reliability(spark, sf_dir):
    bins = M.reliability_bins(document_scores(spark, sf_dir), by=["event"])
    return tidy(
        bins.select(
            "event", "bin", "count", "events", S.scaled("mean_predicted", 6).alias("mean_predicted"),
            S.scaled("observed_rate", 6).alias("observed_rate"), S.scaled("bin_lower", 2).alias("lower"),
        )
    )


def _sweep_sql(grid) -> str:
    values = ", ".join(f"({i + 1}, {g:.17e})" for i, g in enumerate(grid))
    return f"""
gr2 as (select * from (values {values}) t(step, t)),
sw as (select event, step, t, cast(sum(case when p >= t then y else 0 end) as bigint) as tp, cast(sum(case when p >= t then 1 - y else 0 end) as bigint) as fp,
  cast(sum(case when p < t then y else 0 end) as bigint) as fn from sc, gr2 group by 1, 2, 3),
sf as (select *, coalesce(2 * tp / nullif(cast(2 * tp + fp + fn as double), 0), 0) as f1 from sw)"""


@query("threshold_sweep_81", f"""
with {DOC_SQL}, {_sweep_sql(M.GRID_81)}
select event, step, cast(round(t * 1e6) as bigint) as threshold, tp, fp, fn, cast(round(f1 * 1e6) as bigint) as f1 from sf
""")
def threshold_sweep_81(spark, sf_dir):
    sweep = M.threshold_sweep(document_scores(spark, sf_dir), M.GRID_81, by=["event"])
    return tidy(
        sweep.select("event", "step", S.scaled("threshold", 6).alias("threshold"), "tp", "fp", "fn", S.scaled("f1", 6).alias("f1"))
    )


@query("best_thresholds", " union all ".join(
    f"select * from (with {DOC_SQL}, {_sweep_sql(grid)} select '{name}' as grid, event, arg_max(step, (f1, -step)) as step, "
    f"cast(round(max(f1) * 1e6) as bigint) as f1 from sf group by event)"
    for name, grid in (("81", M.GRID_81), ("91", M.GRID_91), ("step2", M.GRID_STEP_2))
))
def best_thresholds(spark, sf_dir):
    scores = document_scores(spark, sf_dir)
    out = None
    for name, grid in (("81", M.GRID_81), ("91", M.GRID_91), ("step2", M.GRID_STEP_2)):
        best = M.best_threshold(M.threshold_sweep(scores, grid, by=["event"]), by=["event"])
        part = best.select(F.lit(name).alias("grid"), "event", "step", S.scaled("f1", 6).alias("f1"))
        out = part if out is None else out.unionByName(part)
    return tidy(out)


MARKS = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query("probability_distributions", f"""
with {DOC_SQL} select event, lang, cast(round(min(p) * 1e6) as bigint) as min,
""" + ", ".join(f"cast(round(quantile_cont(p, {v}) * 1e6) as bigint) as {k}" for k, v in MARKS.items()) + """,
 cast(round(max(p) * 1e6) as bigint) as max, cast(round(avg((p > 0.95)::int) * 1e6) as bigint) as above, cast(round(avg((p < 0.05)::int) * 1e6) as bigint) as below from sc group by 1, 2
""")
def probability_distributions(spark, sf_dir):
    out = M.probability_distribution(document_scores(spark, sf_dir), by=["event", "lang"])
    return tidy(
        out.select(
            "event", "lang", *[S.scaled(c, 6).alias(c) for c in ("min", *MARKS, "max")],
            S.scaled("share_above_95", 6).alias("above"), S.scaled("share_below_05", 6).alias("below"),
        )
    )


@query("climatology_skill", f"""
with {DOC_SQL}, r as (select event, avg(y) as r from sc group by 1)
select event, lang, count(*) as n, cast(sum(y) as bigint) as events, cast(round(avg((p - y) ** 2) * 1e6) as bigint) as brier,
 cast(round(avg((r - y) ** 2) * 1e6) as bigint) as climatology_brier,
 cast(round(coalesce(1 - sum((p - y) ** 2) / nullif(sum((r - y) ** 2), 0), 0) * 1e4) as bigint) as skill from sc join r using (event) group by 1, 2
""")
def climatology_skill(spark, sf_dir):
    scores = document_scores(spark, sf_dir)
    out = M.skill_against_constant(scores, scores, by=["event", "lang"], rate_by=["event"])
    return tidy(
        out.select("event", "lang", "n", "events", *[S.scaled(c, 6).alias(c) for c in ("brier", "climatology_brier")],
                   S.scaled("skill", 4).alias("skill"))
    )


# --- label panel: splits, balance and rates -----------------------------------------

def split_labels(spark, sf_dir):
    """Second-generation labels with month, seven-day rain and purged split."""
    labelled = L.label_events_v2(weather_panel(spark, sf_dir), rules=TEST_RULES)
    # after the labels: the sum then shares the window that looks ahead for them
    labelled = labelled.withColumn("rain7", trailing_sum("Rainfall_Observed_mm", 7, series("District", "Date")))
    split = B.with_purged_split(labelled, "Date", train_until=TRAIN_UNTIL)
    return split.withColumn("month", F.month("Date"))


def month_counts(spark, sf_dir):
    """Known labels and events per split, district, month and event."""
    return B.label_counts(split_labels(spark, sf_dir), ["split", "District", "month"], CORE_TARGETS)


LONG_SQL = V2_LABELS + """,
sp as (select *, sum(rain) over (partition by district order by dt rows between 6 preceding and current row) as rain7,
  case when dt <= date '1998-12-31' - 37 then 'train' when dt between date '1999-01-01' and date '1999-06-30' then 'calibration'
   when dt >= date '1999-07-01' and dt <= date '1999-12-31' - 37 then 'selection'
   when dt >= date '2000-01-01' and dt <= date '2000-12-31' - 37 then 'test' end as split from lab),
lo as (select district, dt, m as month, rain7, split, unnest(['onset', 'false_onset', 'dry_spell_5d', 'severe_break_7d', 'heavy_rain', 'revival']) as event,
  unnest([onset, false_onset, dry_spell_5d, severe_break_7d, heavy_rain, revival]) as y from sp)"""


@query("label_class_balance", f"""
{LONG_SQL}
select coalesce(split, 'gap') as split, event, count(y) as eligible, count(*) filter (y = 1) as positive, count(*) filter (y = 0) as negative,
 count(*) filter (y is null) as unknown, cast(round(count(*) filter (y = 1) / nullif(cast(count(y) as double), 0) * 1e6) as bigint) as positive_rate,
 cast(round(least(25e0, greatest(1e0, count(*) filter (y = 0) / greatest(1, count(*) filter (y = 1)))) * 1e4) as bigint) as positive_weight
from lo group by 1, 2
""")
def label_class_balance(spark, sf_dir):
    rows = split_labels(spark, sf_dir).withColumn("split", F.coalesce("split", F.lit("gap")))
    out = B.class_balance(B.unpivot_labels(rows, ["split"], CORE_TARGETS), ["split", "event"])
    return tidy(
        out.withColumns(
            {"positive_rate": S.scaled("positive_rate", 6), "positive_weight": S.scaled("positive_weight", 4)}
        )
    )


@query("year_split_sizes", """
select case when year(l_shipdate) <= 1998 then 'train' when year(l_shipdate) = 1999 then 'validation' when year(l_shipdate) = 2000 then 'test' end as split,
 count(*) as n, count(*) filter (month(l_shipdate) between 6 and 10) as in_season from lineitem group by 1
""")
def year_split_sizes(spark, sf_dir):
    lines = B.with_year_split(
        table(spark, sf_dir, "lineitem"), "l_shipdate", train_until=1998, validate=1999, test=2000
    )
    season = S.in_months("l_shipdate", CORE_MONTHS["revival"])
    return tidy(lines.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(season).alias("in_season")))


RATES_SQL = LONG_SQL + """,
ra as (select event, district, month, grouping(district) + grouping(month) as level, count(y) as n, sum(y) as events
  from lo where split = 'train' group by grouping sets ((event, district, month), (event, month), (event)) having count(y) > 0)"""


@query("climatology_rates", f"""
{RATES_SQL}
select event, district, month, level, n, cast(events as bigint) as events, cast(round(events / cast(n as double) * 1e6) as bigint) as rate from ra
""")
def climatology_rates(spark, sf_dir):
    counts = month_counts(spark, sf_dir).where("split = 'train' and n > 0")
    rates = B.fallback_rates(counts, ["event"], "District")
    return tidy(rates.withColumnRenamed("District", "district").withColumn("rate", S.scaled("rate", 6)))


LOOKUP_SQL = RATES_SQL + """,
ts as (select l.*, f.n as fn, f.events / cast(f.n as double) as fr, g.events / cast(g.n as double) as gr3, o.events / cast(o.n as double) as orr from lo l
  left join ra f on f.level = 0 and f.event = l.event and f.district = l.district and f.month = l.month
  left join ra g on g.level = 1 and g.event = l.event and g.month = l.month
  left join ra o on o.level = 2 and o.event = l.event where l.split in ('selection', 'test'))"""


@query("district_month_rate_lookup", f"""
{LOOKUP_SQL}
select event, district, month, case when fr is not null then 0 when gr3 is not null then 1 else 2 end as rate_level,
 cast(round(coalesce(fr, gr3, orr) * 1e6) as bigint) as p, count(*) as n from ts where split = 'test' group by 1, 2, 3, 4, 5
""")
def district_month_rate_lookup(spark, sf_dir):
    # one row per split, district, month and event, with all its panel rows
    labelled = split_labels(spark, sf_dir)
    counts = staged(
        B.label_counts(labelled.withColumn("_all", F.lit(0)), ["split", "District", "month"], {**CORE_TARGETS, "all": "_all"}),
        "rate-counts",
    )
    rates = B.fallback_rates(counts.where("split = 'train' and event <> 'all'"), ["event"], "District")
    sizes = counts.where("split = 'test' and event = 'all'").select(
        "District", "month", "n",
        F.explode(F.array(*[F.lit(e) for e in CORE_TARGETS])).alias("event"),
    )
    rows = B.lookup_rates(sizes, rates, ["event"], "District")
    return tidy(
        rows.groupBy("event", F.col("District").alias("district"), "month", "rate_level", S.scaled("p", 6).alias("p"))
        .agg(F.sum("n").alias("n"))
    )


@query("recent_state_baseline", f"""
{LONG_SQL}, tr as (select * from lo where split = 'train' and y is not null),
ed as (select event, quantile_cont(rain7, 0.33) as e1, quantile_cont(rain7, 0.66) as e2, avg(y) as overall from tr group by 1),
bt as (select event, case when rain7 <= e1 then 0 when rain7 <= e2 then 1 else 2 end as b, avg(y) as rate from tr join ed using (event) group by 1, 2),
te as (select l.event, l.y, case when rain7 <= e1 then 0 when rain7 <= e2 then 1 else 2 end as b, overall from lo l join ed using (event) where split = 'test' and y is not null)
select event, cast(round(coalesce(rate, overall) * 1e6) as bigint) as p, count(*) as n, cast(sum(y) as bigint) as events from te left join bt using (event, b) group by 1, 2
""")
def recent_state_baseline(spark, sf_dir):
    counts = durable(B.label_counts(split_labels(spark, sf_dir), ["split", "rain7"], CORE_TARGETS))
    rates = B.state_rates(counts.where("split = 'train'"), ["event"], "rain7")
    rows = B.state_baseline(counts.where("split = 'test' and n > 0"), rates, ["event"], "rain7")
    return tidy(
        rows.groupBy("event", S.scaled("p", 6).alias("p")).agg(
            F.sum("n").alias("n"), F.sum("events").alias("events")
        )
    )


def baseline_counts(spark, sf_dir):
    """Score counts of four rate baselines and a blend of two on the held-out splits.

    The label panel is computed once and staged, a narrow row per day. The training rows
    give the rates per district and month and per seven-day rain. All scores follow from
    district, month and the bucket of the rain, so the held-out rows are counted by these
    before they are stacked by event and scored.
    """
    rows = staged(
        split_labels(spark, sf_dir)
        .where(F.col("split").isin("train", "selection", "test"))
        .select("split", "District", "month", "rain7", *CORE_TARGETS.values()),
        "split-labels",
    )
    train, held_out = rows.where("split = 'train'"), rows.where("split <> 'train'")
    rates = durable(
        B.fallback_rates(
            B.label_counts(train, ["District", "month"], CORE_TARGETS), ["event"], "District"
        )
    )
    states = durable(
        B.state_rates(
            durable(B.label_counts(train, ["rain7"], CORE_TARGETS)), ["event"], "rain7"
        )
    )
    counts = B.label_counts(
        B.snapped_states(held_out, states, "rain7"),
        ["split", "District", "month", "rain7"], CORE_TARGETS,
    ).where("n > 0")
    rows = B.lookup_rates(
        counts, rates, ["event"], "District", month_only="p_month", key_only="p_district"
    ).withColumnRenamed("p", "p_chain")
    rows = B.state_baseline(rows, states, ["event"], "rain7")
    scores = {
        "district_month": F.col("p_chain"), "month": F.col("p_month"),
        "district": F.col("p_district"), "state": F.col("p"),
        "blend": (F.col("p_chain") + F.col("p")) / 2,
    }
    scored = rows.select(
        "event", "split", "n", "events",
        F.inline(
            F.array(
                *[F.struct(F.lit(k).alias("baseline"), v.alias("score")) for k, v in scores.items()]
            )
        ),
    )
    return scored.groupBy("event", "split", "baseline", "score").agg(
        F.sum("events").alias("pos"), F.sum(F.col("n") - F.col("events")).alias("neg")
    )


def baseline_table(spark, sf_dir):
    return M.metrics_from_counts(baseline_counts(spark, sf_dir), by=["event", "split", "baseline"])


BASE_SQL = LOOKUP_SQL + """,
tr as (select * from lo where split = 'train' and y is not null),
ed as (select event, quantile_cont(rain7, 0.33) as e1, quantile_cont(rain7, 0.66) as e2, avg(y) as overall from tr group by 1),
bt as (select event, case when rain7 <= e1 then 0 when rain7 <= e2 then 1 else 2 end as b, sum(y) / cast(count(*) as double) as rate
  from tr join ed using (event) group by 1, 2),
tb as (select ts.*, coalesce(fr, gr3, orr) as pc, coalesce(rate, overall) as ps from ts join ed using (event)
  left join bt on bt.event = ts.event and bt.b = case when rain7 <= e1 then 0 when rain7 <= e2 then 1 else 2 end where y is not null),
sc as (select event, split, y, unnest(['district_month', 'month', 'district', 'state', 'blend']) as baseline,
  unnest([pc, coalesce(gr3, orr), coalesce(fr, orr), ps, (pc + ps) / 2]) as p from tb)"""


@query("baseline_metrics", f"""
{BASE_SQL}, {metrics_sql('sc', '0.5', 'event, split, baseline')} select event, split, baseline, {METRIC_OUT} from me
""")
def baseline_metrics(spark, sf_dir):
    return tidy(baseline_table(spark, sf_dir).select(*metric_columns("event", "split", "baseline")))


def gate_table(spark, sf_dir):
    """The blend as the candidate against month, district and state rates, per event."""
    m = baseline_table(spark, sf_dir)

    def pick(split, baseline, metric):
        return F.max(F.when((F.col("split") == split) & (F.col("baseline") == baseline), F.col(metric)))

    return m.groupBy("event").agg(
        pick("selection", "blend", "brier").alias("validation_brier"),
        pick("selection", "month", "brier").alias("validation_climatology_brier"),
        *[pick("test", "blend", c).alias(f"test_{c}") for c in ("brier", "roc_auc", "pr_auc", "f1")],
        *[
            pick("test", "month", c).alias(f"climatology_{c}")
            for c in ("brier", "roc_auc", "pr_auc", "f1")
        ],
        pick("test", "district", "brier").alias("district_brier"),
        pick("test", "state", "brier").alias("state_brier"),
    )


def _picked(name, metric, split, baseline):
    return f"max({metric}) filter (split = '{split}' and baseline = '{baseline}') as {name}"


GATE_SQL = BASE_SQL + "," + metrics_sql("sc", "0.5", "event, split, baseline") + f""",
gt as (select event, {_picked('vb', 'brier', 'selection', 'blend')}, {_picked('vc', 'brier', 'selection', 'month')},
  {', '.join(_picked(n, c, 'test', 'blend') for n, c in (('tb', 'brier'), ('ta', 'roc_auc'), ('tp2', 'pr_auc'), ('tf', 'f1')))},
  {', '.join(_picked(n, c, 'test', 'month') for n, c in (('cb', 'brier'), ('ca', 'roc_auc'), ('cp', 'pr_auc'), ('cf', 'f1')))},
  {_picked('db', 'brier', 'test', 'district')}, {_picked('sb', 'brier', 'test', 'state')} from me group by 1)"""


@query("release_gate", f"""
{GATE_SQL}, g as (select *, coalesce(vb <= vc * 1.05, false) as ok, coalesce(least(cb, db, sb) < tb, false) as better, coalesce(ta < 0.5 or tp2 < cp * 0.95, ta < 0.5, false) as weak from gt)
select event, cast(ok as bigint) as validation_protected, cast(better as bigint) as baseline_better, cast(weak as bigint) as weak_discrimination,
 cast(round(least(cb, db, sb) * 1e6) as bigint) as best_baseline, case when not ok or better or weak then 'BASELINE_PREFERRED' else 'PRODUCTION_V2' end as release_status from g
""")
def release_gate(spark, sf_dir):
    out = B.release_gate(gate_table(spark, sf_dir))
    return tidy(
        out.select(
            "event", "validation_protected", "baseline_better", "weak_discrimination",
            S.scaled("best_baseline_brier", 6).alias("best_baseline"), "release_status",
        )
    )


@query("variant_comparison", f"""
{GATE_SQL}, d as (select *, (tb - cb < -0.0005)::int + (ta - ca > 0.002)::int + (tp2 - cp > 0.005)::int + (tf - cf > 0.005)::int as up,
 (tb - cb > 0.0005)::int + (ta - ca < -0.002)::int + (tp2 - cp < -0.005)::int + (tf - cf < -0.005)::int as down from gt)
select event, case when tb <= cb or (ta >= ca and tb <= cb + 0.001) then 'ATMOSPHERIC_ENHANCED' else 'RETAIN_BASELINE' end as ablation,
 case when up >= 2 and down = 0 then 'IMPROVED' when down >= 2 and up = 0 then 'SLIGHT_REGRESSION' when up >= 1 then 'SLIGHT_IMPROVEMENT'
  when down >= 1 then 'NEUTRAL_TO_SLIGHT_REGRESSION' else 'NEUTRAL' end as status, cast(round((tb - cb) * 1e6) as bigint) as brier_change from d
""")
def variant_comparison(spark, sf_dir):
    g = gate_table(spark, sf_dir)

    def change(a, b):
        return F.col(a) - F.col(b)

    brier = change("test_brier", "climatology_brier")
    return tidy(
        g.select(
            "event",
            B.ablation_choice("climatology_brier", "climatology_roc_auc", "test_brier", "test_roc_auc").alias("ablation"),
            B.improvement_status(
                brier, change("test_roc_auc", "climatology_roc_auc"),
                change("test_pr_auc", "climatology_pr_auc"), change("test_f1", "climatology_f1"),
            ).alias("status"),
            S.scaled(brier, 6).alias("brier_change"),
        )
    )


@query("chosen_candidates", f"""
{BASE_SQL}, {metrics_sql('sc', '0.5', 'event, split, baseline')}
select event, split, arg_min(baseline, (round(brier, 9), round(log_loss, 9), baseline)) as baseline, cast(round(min(round(brier, 9)) * 1e6) as bigint) as brier from me group by 1, 2
""")
def chosen_candidates(spark, sf_dir):
    # equal rates give equal scores up to the order of their sums: nine places, then the name
    m = baseline_table(spark, sf_dir).withColumns(
        {"brier": F.round("brier", 9), "log_loss": F.round("log_loss", 9)}
    )
    out = B.choose_candidate(m, ["event", "split"], "brier", "log_loss", "baseline")
    return tidy(out.select("event", "split", "baseline", S.scaled("brier", 6).alias("brier")))


# --- encodings, descriptions and covariates ------------------------------------------

@query("alphabetical_codes", """
select c_custkey, dense_rank() over (order by c_mktsegment) - 1 as segment_code from customer
""")
def alphabetical_codes(spark, sf_dir):
    df = alphabetical_index(table(spark, sf_dir, "customer"), {"c_mktsegment": "segment_code"})
    return tidy(df.select("c_custkey", big("segment_code").alias("segment_code")))


@query("quantity_description", """
select l_returnflag, count(l_quantity) as count, cast(round(avg(l_quantity) * 1e6) as bigint) as mean, cast(round(stddev_samp(l_quantity) * 1e6) as bigint) as std,
 cast(min(l_quantity) as bigint) as min, cast(round(quantile_cont(l_quantity, 0.25) * 100) as bigint) as q25, cast(round(quantile_cont(l_quantity, 0.5) * 100) as bigint) as q50,
 cast(round(quantile_cont(l_quantity, 0.75) * 100) as bigint) as q75, cast(max(l_quantity) as bigint) as max from lineitem group by 1
""")
def quantity_description(spark, sf_dir):
    d = M.describe(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])
    return tidy(
        d.select(
            "l_returnflag", "count", S.scaled("mean", 6).alias("mean"), S.scaled("std", 6).alias("std"),
            big("min").alias("min"), *[S.scaled(q, 2).alias(q) for q in ("q25", "q50", "q75")], big("max").alias("max"),
        )
    )


SHIFT_MARKS = {"p01": 0.01, "p05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "p95": 0.95, "p99": 0.99}


@query("feature_shift", f"""
with l as (select unnest(['l_quantity', 'l_linenumber', 'l_discount']) as feature, unnest([l_quantity, cast(l_linenumber as double), l_discount * 100]) as v, year(l_shipdate) <= 1999 as train from lineitem),
c as (select feature, avg(v) as cur from l where not train group by 1)
select feature, cast(round(any_value(cur) * 1e4) as bigint) as current, count(*) as n, cast(round(avg(v) * 1e4) as bigint) as mean,
 cast(round(stddev_samp(v) * 1e4) as bigint) as std, cast(round(min(v) * 1e4) as bigint) as min, cast(round(max(v) * 1e4) as bigint) as max,
 {', '.join(f'cast(round(quantile_cont(v, {q}) * 100) as bigint) as {m}' for m, q in SHIFT_MARKS.items())},
 cast(round(avg((v <= cur)::int) * 1e6) as bigint) as share from l join c using (feature) where train group by 1
""")
def feature_shift(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_quantity", F.col("l_linenumber").cast("double").alias("l_linenumber"),
        (F.col("l_discount") * 100).alias("l_discount"), (F.year("l_shipdate") <= 1999).alias("train"),
    )
    out = M.feature_shift(lines.where("train"), lines.where("not train"), ["l_quantity", "l_linenumber", "l_discount"])
    return tidy(
        out.select(
            "feature", S.scaled("current", 4).alias("current"), F.col("count").alias("n"), S.scaled("mean", 4).alias("mean"),
            *[S.scaled(c, 4).alias(c) for c in ("std", "min", "max")],
            *[S.scaled(m, 2).alias(m) for m in SHIFT_MARKS], S.scaled("train_share_at_or_below", 6).alias("share"),
        )
    )


def covariates(spark, sf_dir):
    """Per supplier: balance (covariate), mean rain and share of heavy days."""
    rain = sparse_weather(spark, sf_dir).groupBy("District").agg(
        F.avg("Rainfall_Observed_mm").alias("mean_rain"),
        (F.count_if(F.col("Rainfall_Observed_mm") >= 64.5) / F.count(F.lit(1))).alias("heavy_share"),
    )
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("District"), "s_acctbal")
    return rain.join(supplier, "District")


COVARIATE_SQL = """
dr as (select l_suppkey as district, cast(l_shipdate as date) as dt, sum(l_quantity) as r from lineitem group by 1, 2),
cv as (select district, avg(r) as mean_rain, count(*) filter (r >= 64.5) / count(*) as heavy_share, any_value(s_acctbal) as x from dr join supplier on s_suppkey = district group by 1)"""


@query("covariate_correlation", f"""
with {COVARIATE_SQL} select cast(round(corr(x, mean_rain) * 1e6) as bigint) as with_mean, cast(round(corr(x, heavy_share) * 1e6) as bigint) as with_heavy, count(*) as n from cv
""")
def covariate_correlation(spark, sf_dir):
    c = covariates(spark, sf_dir)
    return tidy(
        c.agg(
            S.scaled(F.corr("s_acctbal", "mean_rain"), 6).alias("with_mean"),
            S.scaled(F.corr("s_acctbal", "heavy_share"), 6).alias("with_heavy"), F.count(F.lit(1)).alias("n"),
        )
    )


@query("leave_one_out_fit", f"""
with {COVARIATE_SQL}, f as (select a.district, a.x, a.mean_rain as y, regr_slope(b.mean_rain, b.x) as s, regr_intercept(b.mean_rain, b.x) as i
  from cv a join cv b on a.district <> b.district group by 1, 2, 3)
select district, cast(round((i + s * x) * 1e4) as bigint) as held_out_fit, cast(round((y - i - s * x) * 1e4) as bigint) as held_out_error from f
""")
def leave_one_out_fit(spark, sf_dir):
    out = B.leave_one_out_fit(covariates(spark, sf_dir), "District", "s_acctbal", "mean_rain")
    return tidy(
        out.select(
            F.col("District").alias("district"), S.scaled("held_out_fit", 4).alias("held_out_fit"),
            S.scaled("held_out_error", 4).alias("held_out_error"),
        )
    )


@query("leave_one_out_two_predictors", f"""
with {COVARIATE_SQL}, k as (select c.*, s_nationkey as z from cv c join supplier on s_suppkey = c.district),
s as (select a.district, a.x, a.z, a.mean_rain as y0, a.heavy_share as y1, count(*) as n, sum(b.x) as sx, sum(b.z) as sz, sum(b.x * b.x) as sxx,
  sum(b.x * b.z) as sxz, sum(b.z * b.z) as szz, sum(b.mean_rain) as s0, sum(b.x * b.mean_rain) as sx0, sum(b.z * b.mean_rain) as sz0,
  sum(b.heavy_share) as s1, sum(b.x * b.heavy_share) as sx1, sum(b.z * b.heavy_share) as sz1
  from k a join k b on a.district <> b.district group by 1, 2, 3, 4, 5),
m as (select *, sxx - sx * sx / n as p, szz - sz * sz / n as q, sxz - sx * sz / n as r,
  sx0 - sx * s0 / n as u0, sz0 - sz * s0 / n as v0, sx1 - sx * s1 / n as u1, sz1 - sz * s1 / n as v1 from s),
f as (select *, (u0 * q - v0 * r) / (p * q - r * r) as a0, (v0 * p - u0 * r) / (p * q - r * r) as b0,
  (u1 * q - v1 * r) / (p * q - r * r) as a1, (v1 * p - u1 * r) / (p * q - r * r) as b1 from m)
select district, cast(round(((s0 - a0 * sx - b0 * sz) / n + a0 * x + b0 * z) * 1e4) as bigint) as fit_rain,
  cast(round((y0 - (s0 - a0 * sx - b0 * sz) / n - a0 * x - b0 * z) * 1e4) as bigint) as error_rain,
  cast(round(((s1 - a1 * sx - b1 * sz) / n + a1 * x + b1 * z) * 1e6) as bigint) as fit_heavy,
  cast(round((y1 - (s1 - a1 * sx - b1 * sz) / n - a1 * x - b1 * z) * 1e6) as bigint) as error_heavy from f
""")
def leave_one_out_two_predictors(spark, sf_dir):
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("District"), "s_nationkey")
    rows = covariates(spark, sf_dir).join(nation, "District")
    out = B.leave_one_out_fits(rows, "District", ("s_acctbal", "s_nationkey"), ["mean_rain", "heavy_share"])
    return tidy(
        out.select(
            F.col("District").alias("district"),
            S.scaled("fit_mean_rain", 4).alias("fit_rain"), S.scaled("error_mean_rain", 4).alias("error_rain"),
            S.scaled("fit_heavy_share", 6).alias("fit_heavy"), S.scaled("error_heavy_share", 6).alias("error_heavy"),
        )
    )
