"""Running sums inside array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256  # values whose sums are built together


def _running(values: Column, start: Column) -> Column:
    """Sum before each value, from ``start`` on."""
    return F.aggregate(
        values,
        F.struct(start.alias("sum"), F.array().cast("array<int>").alias("out")),
        lambda s, x: F.struct(
            (s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out")
        ),
        lambda s: s["out"],
    )


def sums_before(values: Column) -> Column:
    """Sum before each value; in blocks, so that long arrays do not cost their square."""
    def total(v):
        return F.aggregate(v, F.lit(0), lambda s, x: s + x)

    def joined(blocks):
        starts = _running(F.transform(blocks, total), F.lit(0))
        return F.flatten(F.zip_with(blocks, starts, _running))

    def of(v):
        ends = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        blocks = F.transform(ends, lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return F.transform(F.array(blocks), joined)[0]

    return F.when(F.size(values) > 0, F.transform(F.array(values), of)[0]).otherwise(
        F.array().cast("array<int>")
    )
