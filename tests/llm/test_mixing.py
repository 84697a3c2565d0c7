from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm.mixing import Mix, drawn_margins, inclusion, mixed_sample, rake
from panelwright.llm.queries import MIX, PLANS

MARGINS = Mix(
    source={"a": 0.5, "b": 0.3, "*": 0.2}, language={"en": 0.6, "de": 0.4}, topic={"x": 0.7, "*": 0.3},
    budget=0.4,
)


def test_raked_margins_are_the_targets():
    rng = np.random.default_rng(1)
    grid = rng.integers(1, 1000, (3, 2, 2)).astype(float)
    goals = [np.array([0.2, 0.5, 0.3]), np.array([0.9, 0.1]), np.array([0.5, 0.5])]
    shares = rake(grid, goals)
    for axis, goal in enumerate(goals):
        others = tuple(a for a in range(3) if a != axis)
        assert np.allclose(shares.sum(axis=others), goal, atol=1e-8)
    # raking keeps the interactions of the table: cross ratios of cells do not change
    ratio = grid[0, 0, 0] * grid[1, 1, 0] / (grid[0, 1, 0] * grid[1, 0, 0])
    after = shares[0, 0, 0] * shares[1, 1, 0] / (shares[0, 1, 0] * shares[1, 0, 0])
    assert np.isclose(ratio, after)


def tilted(grid, goals):
    """The table of given margins nearest to ``grid``: one factor per class, by Newton steps on the
    logarithms of all factors at once, without scaling margins in turn."""
    design = [np.stack([np.indices(grid.shape)[a].ravel() == i for i in range(n)]) for a, n in enumerate(grid.shape)]
    design, goal = np.concatenate(design).astype(float), np.concatenate(goals)
    start, logs = (grid / grid.sum()).ravel(), np.zeros(len(goal))

    def loss(logs):
        return (start * np.exp(design.T @ logs)).sum() - goal @ logs

    for _ in range(200):
        table = start * np.exp(design.T @ logs)
        step = np.linalg.lstsq((design * table) @ design.T, goal - design @ table, rcond=1e-10)[0]
        size = 1.0
        while loss(logs + size * step) > loss(logs) + 1e-15 and size > 1e-6:
            size /= 2
        logs = logs + size * step
    return (start * np.exp(design.T @ logs)).reshape(grid.shape)


def test_raking_equals_an_independent_solution():
    rng = np.random.default_rng(7)
    for shape in [(3, 2, 2), (4, 3, 2), (2, 5, 4)]:
        grid = rng.integers(0, 500, shape).astype(float) + rng.integers(1, 3, shape)
        goals = [rng.dirichlet(np.full(n, 3.0)) for n in shape]
        assert np.allclose(rake(grid, goals), tilted(grid, goals), atol=1e-7)


def test_contradicting_margins_warn():
    with pytest.warns(UserWarning, match="margin is off"):
        rake(np.array([[[1.0], [0.0]], [[0.0], [1.0]]]), [np.array([0.8, 0.2]), np.array([0.2, 0.8]), np.array([1.0])])


def test_absent_classes_are_left_out():
    grid = np.array([[[10.0]], [[0.0]], [[30.0]]])
    shares = rake(grid, [np.array([0.5, 0.25, 0.25]), np.array([1.0]), np.array([1.0])])
    assert np.allclose(shares.ravel(), [2 / 3, 0, 1 / 3])
    assert rake(grid * 0, [np.ones(3), np.ones(1), np.ones(1)]).sum() == 0


@pytest.mark.parametrize("budget", [0.0, 0.1, 0.5, 0.9, 1.0, 2.0])
def test_expected_tokens_meet_the_budget(budget):
    tokens = np.array([[[100.0, 5.0], [40.0, 0.0]], [[7.0, 900.0], [1.0, 50.0]]])
    shares = rake(tokens, [np.array([0.5, 0.5]), np.array([0.7, 0.3]), np.array([0.4, 0.6])])
    chance = inclusion(tokens, shares, budget)
    assert (chance >= 0).all() and (chance <= 1).all()
    reachable = tokens[shares > 0].sum()
    assert np.isclose((chance * tokens).sum(), min(budget * tokens.sum(), reachable))
    free = (chance < 1) & (shares > 0)
    if free.sum() > 1:  # below 1 the drawn tokens are proportional to the raked shares
        ratio = (chance * tokens)[free] / shares[free]
        assert np.allclose(ratio, ratio[0])


def test_operator_meets_the_targets_on_many_rows(spark):
    rows = spark.range(40_000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"),
        F.element_at(F.array(*map(F.lit, ["a", "a", "a", "b", "c", "zz"])), (F.hash("id") % 3 + 3).cast("int")).alias("source"),
        F.when(F.hash("id", F.lit(1)) % 4 == 0, "de").otherwise("en").alias("lang"),
        F.when(F.hash("id", F.lit(2)) % 3 == 0, "x").otherwise("y").alias("kind"),
    )
    out = mixed_sample(rows, MARGINS, topic=F.col("kind"))
    drawn = out.where("sampled").agg(F.sum("n_tokens").alias("n")).first().n
    total = out.agg(F.sum("n_tokens").alias("n")).first().n
    assert abs(drawn / total - 0.4) < 0.02
    expected = out.groupBy("language_class").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("e")).collect()
    by = {r.language_class: r.e for r in expected}
    assert out.count() == 40_000 and by["en"] > 0 and by["de"] > 0
    again = mixed_sample(rows.repartition(5), MARGINS, topic=F.col("kind"))
    assert again.where("sampled").exceptAll(out.where("sampled")).count() == 0


def test_margins_hold_where_cells_are_bounded():
    # the plain share of cell (0, 0) is 31 tokens of its 10; the other cells can make up for it
    tokens = np.array([[[10.0], [400.0]], [[390.0], [200.0]]])
    goals = [np.array([0.5, 0.5]), np.array([0.5, 0.5]), np.array([1.0])]
    shares = rake(np.array([[[300.0], [200.0]], [[200.0], [300.0]]]), goals)
    drawn = inclusion(tokens, shares, 0.5) * tokens
    assert drawn.max() > 0 and np.isclose(drawn[0, 0, 0], 10)
    assert np.allclose(drawn.sum(axis=(1, 2)), 250) and np.allclose(drawn.sum(axis=(0, 2)), 250)
    # a class with too few tokens is taken whole, the other classes of its margin keep their ratio
    scarce = np.array([[[30.0, 10.0], [20.0, 40.0]], [[300.0, 70.0], [130.0, 200.0]], [[90.0, 50.0], [40.0, 20.0]]])
    goals = [np.array([0.6, 0.3, 0.1]), np.array([0.5, 0.5]), np.array([0.5, 0.5])]
    drawn = inclusion(scarce, rake(scarce, goals), 0.5) * scarce
    assert np.isclose(drawn.sum(), 500) and np.allclose(drawn.sum(axis=(1, 2)), [100, 300, 100])
    assert np.allclose(drawn.sum(axis=(0, 2)), 250) and np.allclose(drawn.sum(axis=(0, 1)), 250)


def test_drawn_margins_tell_target_from_expected(spark):
    sf = "/root/testdata/sf0.01"
    out = PLANS["op1_mixing"](spark, sf)
    rows = {(r.margin, r["class"]): r for r in drawn_margins(out, MIX).collect()}
    assert len(rows) == sum(map(len, (MIX.source, MIX.language, MIX.topic)))
    plain = out.toPandas()
    part = plain[plain.topic == "numbers"]
    drawn = (plain.n_tokens * plain.probability).sum()
    numbers = rows["topic", "numbers"]
    assert numbers.target == pytest.approx(0.05)
    assert numbers.observed == pytest.approx(part.n_tokens.sum() / plain.n_tokens.sum())
    assert numbers.expected == pytest.approx((part.n_tokens * part.probability).sum() / drawn)
    # all languages have tokens enough: their shares are the targets of those with rows
    have = {k: r for k, r in rows.items() if k[0] == "language" and r.observed}
    named = sum(r.target for r in have.values())
    assert all(r.expected == pytest.approx(r.target / named) for r in have.values())


def test_odd_rows(spark):
    rows = [(1, None, None, None), (None, "a b", "a", "en"), (None, "a b", "a", "en"), (2, "", "b", "xx"),
            (3, "word " * 30_000, "a", "de"), (3, "word " * 30_000, "a", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr(
        "*", "1 as weight", "2 as _tokens", "'q' as topic")
    out = mixed_sample(df, MIX).collect()
    assert len(out) == 6
    twins = [r for r in out if r.doc_id == 3]
    assert twins[0] == twins[1] and {r.n_tokens for r in twins} == {30_000}
    assert {r.source_class for r in out if r.doc_id == 1} == {"*"}
    assert mixed_sample(df.limit(0), MIX).count() == 0


def test_query_follows_the_plain_computation(spark):
    sf = "/root/testdata/sf0.01"
    out = PLANS["op1_mixing"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert sorted(out.doc_id) == sorted(docs.doc_id)
    counts = {i: len(t.split()) for i, t in zip(docs.doc_id, docs.text)}
    assert all(counts[i] == n for i, n in zip(out.doc_id, out.n_tokens))
    names = [[*m] for m in (MIX.source, MIX.language, MIX.topic)]
    cells = out.groupby(["source_class", "language_class", "topic"])
    grid = np.zeros([len(n) for n in names])
    for key, part in cells:
        grid[tuple(n.index(k) for n, k in zip(names, key))] = part.n_tokens.sum()
    shares = rake(grid, [np.array([*m.values()]) for m in (MIX.source, MIX.language, MIX.topic)])
    chance = inclusion(grid, shares, MIX.budget)
    for key, part in cells:
        at = tuple(n.index(k) for n, k in zip(names, key))
        assert np.allclose(part.probability, chance[at])
    expected = (out.probability * out.n_tokens).sum()
    assert abs(expected - 0.5 * out.n_tokens.sum()) < 1e-6 * out.n_tokens.sum()
