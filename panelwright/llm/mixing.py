"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import warnings

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.staging import staged

REST = "*"  # the class of all values that a target does not name
SEED = 20_240_611
MAX_ROUNDS = 1_000
TOLERANCE = 1e-10

Shares = Mapping[str, float]


@dataclass(frozen=True)
class Mix:
    """Target shares of tokens by source, language and topic, and the share to draw."""

    source: Shares
    language: Shares
    topic: Shares
    budget: float = 0.5


def word_count(text: Column) -> Column:
    """Words of a text, as a measure of its tokens; null has none."""
    bare = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " "))).cast("long")


def layout_topic(text: Column) -> Column:
    """Topic of a text by its make-up: tables of numbers, marked-up text, notes or prose."""
    text = F.coalesce(text, F.lit(""))
    length = F.length(text)
    digits = length - F.length(F.regexp_replace(text, "[0-9]+", ""))
    marks = length - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
    return (
        F.when(length < 400, "note")
        .when(digits * 20 > length, "numbers")
        .when(marks * 20 > length, "markup")
        .otherwise("prose")
    )


def rake(tokens: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Shares of the cells of ``tokens`` whose margins are the targets.

    Starts from the observed shares and scales one margin after the other until none is off
    by more than ``TOLERANCE``. Targets of classes without tokens cannot be met; they are
    left out and the rest of that margin is scaled to 1. If empty cells make the margins
    contradict each other, the last round stands (its last margin is exact), and a warning
    tells how far the worst margin is off.
    """
    total = tokens.sum()
    if total <= 0:
        return np.zeros_like(tokens, dtype=float)
    shares = tokens / total
    axes = range(shares.ndim)
    wanted = []
    for axis in axes:
        others = tuple(a for a in axes if a != axis)
        goal = np.where(shares.sum(axis=others) > 0, targets[axis], 0.0)
        if goal.sum() <= 0:
            raise ValueError("a target gives no share to any class that has tokens")
        wanted.append(goal / goal.sum())
    for _ in range(MAX_ROUNDS):
        worst = 0.0
        for axis in axes:
            others = tuple(a for a in axes if a != axis)
            margin = shares.sum(axis=others)
            worst = max(worst, np.abs(margin - wanted[axis]).max())
            scale = np.divide(wanted[axis], margin, out=np.zeros_like(margin), where=margin > 0)
            shares = shares * np.expand_dims(scale, others)
            if not shares.any():
                raise ValueError("the targets exclude every cell that has tokens")
        if worst <= TOLERANCE:
            break
    else:
        warnings.warn(f"raking stopped after {MAX_ROUNDS} rounds, a margin is off by {worst:.2g}", stacklevel=2)
    return shares


def reachable_margin(wanted: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Tokens of each class: in proportion to ``wanted``, at most ``caps``, of the same sum.

    What a class cannot give goes to the others in proportion, until none is above its cap.
    """
    goal, out = min(wanted.sum(), caps[wanted > 0].sum()), np.zeros_like(wanted)
    free = wanted > 0
    while free.any():
        raised = wanted * max(goal - out[~free].sum(), 0.0) / wanted[free].sum()
        over = free & (raised >= caps)
        out[free] = raised[free]
        if not over.any():
            break
        out[over] = caps[over]
        free &= ~over
    return out


def _bounded_scale(level: np.ndarray, caps: np.ndarray, goal: float) -> float:
    """The factor with which the sum of min(caps, factor * level) is ``goal``.

    If the caps themselves sum to no more, the least factor that takes them all.
    """
    used = level > 0
    level, caps = level[used], caps[used]
    order = np.argsort(caps / level)
    need = (caps / level)[order]
    whole = np.concatenate([[0.0], np.cumsum(caps[order])[:-1]])
    rest = np.cumsum(level[order][::-1])[::-1]
    fits = np.flatnonzero(whole + need * rest >= goal)
    return (goal - whole[fits[0]]) / rest[fits[0]] if len(fits) else need[-1]


def inclusion(tokens: np.ndarray, shares: np.ndarray, budget: float) -> np.ndarray:
    """Probability of each cell such that the expected tokens are ``budget`` of all.

    The drawn tokens of a cell are min(its tokens, share times a factor per class), raked
    anew under that bound until the margins are those of ``shares`` again. A class with
    fewer tokens than its margin needs is taken whole and what it lacks is dealt to the
    other classes of its margin in proportion; the expected total stays. If margins that
    can be met one by one contradict each other, the last round or the plain bound stands,
    whichever misses the margins less in sum.
    """
    caps = np.where(shares > 0, tokens, 0.0)
    goal = min(budget * tokens.sum(), caps.sum())
    if goal <= 0 or goal >= caps.sum():
        return (caps > 0).astype(float) * (goal > 0)
    axes = range(shares.ndim)
    others = [tuple(a for a in axes if a != axis) for axis in axes]
    wanted = [
        reachable_margin(shares.sum(axis=o) / shares.sum() * goal, caps.sum(axis=o)) for o in others
    ]

    def missed(drawn):
        return [np.abs(drawn.sum(axis=o) - w) for o, w in zip(others, wanted)]

    level = shares * _bounded_scale(shares.ravel(), caps.ravel(), goal)
    plain = np.minimum(level, caps)
    for _ in range(MAX_ROUNDS):
        if max(m.max() for m in missed(np.minimum(level, caps))) <= TOLERANCE * goal:
            break
        for axis in axes:
            for i in np.flatnonzero(wanted[axis] > 0):
                part = tuple(i if a == axis else slice(None) for a in axes)
                level[part] *= _bounded_scale(level[part].ravel(), caps[part].ravel(), wanted[axis][i])
    drawn = min((np.minimum(level, caps), plain), key=lambda d: sum(m.sum() for m in missed(d)))
    return np.divide(drawn, tokens, out=np.zeros_like(drawn), where=tokens > 0)


def _target(shares: Shares) -> tuple[list[str], np.ndarray]:
    named = {k: v for k, v in shares.items() if k != REST}
    rest = shares.get(REST, max(0.0, 1.0 - sum(named.values())))
    if min([rest, *named.values()]) < 0:
        raise ValueError("shares cannot be negative")
    return [*named, REST], np.array([*named.values(), rest], dtype=float)


def drawn_margins(sample: DataFrame, mix: Mix) -> DataFrame:
    """Target against expected share of every class in a result of ``mixed_sample``.

    One row per class that the mix names or that has rows: ``margin``, ``class``,
    ``target`` (share of all classes as the mix gives it), ``observed`` (share of the tokens
    before the draw) and ``expected`` (share of the tokens in the draw, by the
    probabilities). A class that ``expected`` leaves short of its target has too few tokens
    for the budget. Shares of no tokens are null.
    """
    margins = {
        "source": ("source_class", mix.source), "language": ("language_class", mix.language),
        "topic": ("topic", mix.topic),
    }
    goals = sample.sparkSession.createDataFrame(
        [
            (margin, name, float(share / goal.sum()))
            for margin, (_, shares) in margins.items()
            for names, goal in [_target(shares)]
            for name, share in zip(names, goal)
        ],
        "margin string, class string, target double",
    )
    cells = sample.groupBy(*[column for column, _ in margins.values()]).agg(
        F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("drawn")
    )
    classes = F.explode(
        F.array(
            *[
                F.struct(F.lit(margin).alias("margin"), F.col(column).alias("class"))
                for margin, (column, _) in margins.items()
            ]
        )
    )
    sums = (
        cells.select(classes.alias("of"), "tokens", "drawn")
        .groupBy("of.margin", "of.class")
        .agg(F.sum("tokens").alias("tokens"), F.sum("drawn").alias("drawn"))
    )
    of_margin = Window.partitionBy("margin")  # bounded by the targets
    shares = sums.select(
        "margin", "class",
        F.try_divide("tokens", F.sum("tokens").over(of_margin)).alias("observed"),
        F.try_divide("drawn", F.sum("drawn").over(of_margin)).alias("expected"),
    )
    return goals.join(shares, ["margin", "class"], "left").select(
        "margin", "class", "target", "observed", "expected"
    )


def mixed_sample(
    docs: DataFrame,
    mix: Mix,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    language_column: str = "lang",
    topic: Column | None = None,
    tokens: Column | None = None,
    seed: int = SEED,
    carry: list[Column] = (),
) -> DataFrame:
    """Calibrated inclusion probability and decision of every document.

    Each value of source, language and topic that a target names is a class; all others
    form the class ``*``. One aggregation (combined before the shuffle, so hot sources do
    no harm) sums tokens per cell; there are at most as many cells as products of named
    classes, whatever the data, so they are raked on the driver and come back as a
    broadcast table. A document is drawn if the hash of its id and the seed, as a number
    in [0, 1), is below the probability of its cell: repeated runs and repeated rows agree.

    Result: the id column, ``source_class``, ``language_class``, ``topic``, ``n_tokens``,
    ``weight`` (target share over observed share, whatever the budget allows),
    ``probability``, ``sampled`` and the columns of ``carry``. ``drawn_margins`` holds the
    expected shares of the draw against the targets. Null values of the three columns belong to ``*``; a null or empty
    text has 0 tokens and shares the fate of its cell (probability 0 if the whole cell has
    no tokens); rows without an id are drawn by their text; an empty table gives an empty
    result. Other columns are ignored, so their names cannot clash.
    """
    names, targets = zip(*map(_target, (mix.source, mix.language, mix.topic)))
    topic = layout_topic(F.col(text_column)) if topic is None else topic
    tokens = word_count(F.col(text_column)) if tokens is None else tokens
    keys = ["_source", "_language", "_topic"]
    by = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("text:"), F.md5(text_column)))
    rows = docs.select(
        F.col(id_column).alias("_id"),
        *[
            F.when(value.isin(*known), value).otherwise(REST).alias(key)
            for key, value, known in zip(
                keys, (F.col(source_column), F.col(language_column), topic), names
            )
        ],
        tokens.cast("long").alias("_tokens"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), by), 11).alias("_draw"),
        *[c.alias(f"_carry{i}") for i, c in enumerate(carry)],
    )
    if not carry:
        rows = staged(rows, "mixing")  # narrow rows; with texts a second scan is cheaper
    sums = rows.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")).collect()  # bounded by the targets
    grid = np.zeros([len(n) for n in names])
    at = {tuple(r[k] for k in keys): tuple(n.index(r[k]) for n, k in zip(names, keys)) for r in sums}
    for r in sums:
        grid[at[tuple(r[k] for k in keys)]] = r["tokens"] or 0
    shares = rake(grid, list(targets))
    chances = inclusion(grid, shares, mix.budget)
    total = max(grid.sum(), 1.0)
    cells = rows.sparkSession.createDataFrame(
        [
            (*key, float(shares[i] / (grid[i] / total)) if grid[i] > 0 else 0.0, float(chances[i]))
            for key, i in at.items()
        ],
        "_source string, _language string, _topic string, weight double, probability double",
    )
    return rows.join(F.broadcast(cells), keys).select(
        F.col("_id").alias(id_column),
        F.col("_source").alias("source_class"),
        F.col("_language").alias("language_class"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        "weight",
        "probability",
        (F.col("_draw") / F.lit(float(1 << 53)) < F.col("probability")).alias("sampled"),
        *[F.col(f"_carry{i}") for i in range(len(carry))],
    )
