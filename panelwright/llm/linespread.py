"""Line de-duplication by distinct-site spread, in Spark columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.staging import staged

BLANKS = " \t\n\x0b\x0c\r"
SKETCH_BITS = 12  # 4,096 registers: a standard error of 1.6 %
BAND = 0.1  # relative distance from the threshold within which lines are counted exactly
SMALL_LINES = 1_000_000  # line hashes sent to every executor at most


def _line_hash(line: Column, min_chars: int) -> Column:
    """Hash of the line without blank ends; null for lines too short to judge."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.length(bare) >= min_chars, F.xxhash64(bare))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SMALL_LINES else table


def site_spread(occurrences: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of the lines that stand on at least ``min_sites`` sites.

    ``occurrences`` has (hash, site). HyperLogLog sketches of the sites per line hash merge
    by aggregation, map-side first, so a line that fills a third of the table costs one
    small sketch per task. Estimates well above the threshold decide at once, those well
    below are dropped, and lines within ``BAND`` of it get exact distinct counts (distinct
    pairs first, which is also combined map-side).
    """
    spread = staged(
        occurrences.groupBy("hash")
        .agg(F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"))
        .select("hash", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - BAND)),
        "spread",
    )
    sure = F.col("sites") > min_sites * (1 + BAND)
    near = spread.where(~sure).select("hash")
    exact = (
        occurrences.where("site is not null")
        .join(_small(near), "hash", "left_semi")
        .distinct()
        .groupBy("hash")
        .agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("hash")
    )
    return spread.where(sure).select("hash").union(exact)


def without_boilerplate(
    docs: DataFrame,
    min_sites: int = 10,
    min_chars: int = 20,
    id_column: str = "doc_id",
    text_column: str = "text",
    site_column: str = "source",
) -> DataFrame:
    """Texts without the lines that many sites share.

    Lines are split at line breaks and compared without blank ends; lines of fewer than
    ``min_chars`` characters are never removed. A narrow pass notes the hash of every line
    with a 128-bit key of its text; ``site_spread`` finds the boilerplate. The boilerplate
    hashes of each distinct text are gathered (distinct lines of one text at most; copies
    of a text are combined first) and joined to the texts by key; Spark splits the rows of
    a text with very many copies.

    Result: the id column, ``n_lines``, ``n_removed`` and the cleaned ``text`` (the other
    lines, unchanged). A null text stays null with 0 lines; an empty text has one line; a
    null site adds no site but its lines are removed as well; a null id stays null;
    repeated rows are cleaned each; an empty table gives an empty result. Other columns are
    ignored, so their names cannot clash.
    """
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.col(text_column).alias("text"),
        F.col(site_column).cast("string").alias("site"),
        F.xxhash64(text_column).alias("k1"),
        F.xxhash64(F.lit(1), F.col(text_column)).alias("k2"),
    )
    lines = staged(
        rows.select(
            "k1", "k2", "site",
            F.explode(
                F.array_distinct(
                    F.filter(
                        F.transform(F.split("text", "\n"), lambda x: _line_hash(x, min_chars)),
                        lambda h: h.isNotNull(),
                    )
                )
            ).alias("hash"),
        ),
        "lines",
    )
    boilerplate = staged(site_spread(lines.select("hash", "site"), min_sites), "boilerplate")
    # staged, so that the join below deals both sides itself and can split a hot text
    removals = staged(
        lines.select("k1", "k2", "hash")
        .join(_small(boilerplate), "hash", "left_semi")
        .distinct()
        .groupBy("k1", "k2")
        .agg(F.collect_list("hash").alias("removed")),
        "removals",
    )
    split = F.split("text", "\n")
    cleaned = rows.join(removals, ["k1", "k2"], "left").select(
        "id",
        "text",
        F.when(
            F.col("removed").isNotNull(),
            F.filter(
                split,
                lambda x: ~F.coalesce(
                    F.array_contains(F.col("removed"), _line_hash(x, min_chars)), F.lit(False)
                ),
            ),
        ).alias("kept"),
    )
    n_lines = F.coalesce(F.size(split), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines)
    return cleaned.select(
        F.col("id").alias(id_column),
        n_lines.alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0).cast("long"))
        .otherwise(n_lines - F.size("kept"))
        .alias("n_removed"),
        F.when(F.col("kept").isNull(), F.col("text"))
        .otherwise(F.array_join("kept", "\n"))
        .alias("text"),
    )
