"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.staging import staged

ROW_OVERHEAD = 16


def text_size(text: Column, overhead: int = ROW_OVERHEAD) -> Column:
    """UTF-8 bytes of a text (null: none) plus a fixed cost per row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead


def _number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partition number, row number and bytes before each row inside its partition."""
    part, rows, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column("_size").to_numpy()
        running = total + np.cumsum(size)
        columns = {
            "_part": np.full(len(size), part, np.int64),
            "_row": np.arange(rows, rows + len(size), dtype=np.int64),
            "_before": running - size,
        }
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *map(pa.array, columns.values())], [*batch.schema.names, *columns]
        )
        rows += len(size)
        total = int(running[-1]) if len(size) else total


def balanced_shards(
    rows: DataFrame,
    n_shards: int,
    size: Column,
    order: Sequence[str] = ("doc_id",),
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Cut the rows, in the given order, into ``n_shards`` contiguous runs of equal bytes.

    The rows are range partitioned by ``order`` (row positions break ties, so repeated keys
    cannot pile up in one task) and numbered inside their partitions; these narrow rows are
    staged once. One total per partition goes through the driver, bounded by the number of
    partitions, and comes back as global prefix sums. A row belongs to the shard in which
    its middle byte falls; the middle bytes grow along the order, so shards are contiguous
    and each misses the target by one row at most.

    Result: the carried columns, ``size``, ``shard`` (0 to n_shards - 1) and ``slot``
    (position inside the shard, gapless from 0). Null order keys come first; repeated rows
    each get a slot; an empty table gives an empty result. Shards stay empty where rows are
    larger than the target. Columns that are not carried are ignored.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    picked = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in order]).alias("_key"),
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carry"),
        size.cast("long").alias("_size"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    flat = picked.select(
        *[F.col(f"_key.`{c}`").alias(f"_k{i}") for i, c in enumerate(order)],
        *[F.col(f"_carry.`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)],
        "_size", "_tie",
    )
    keys = [f"_k{i}" for i in range(len(order))] + ["_tie"]
    kept = [f"_c{i}" for i in range(len(carry))]
    ordered = flat.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*kept, "_size")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields]
    schema = ", ".join(fields + ["_part long", "_row long", "_before long"])
    numbered = staged(ordered.mapInArrow(_number_rows, schema), "shards")

    totals = sorted(
        numbered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("_size").alias("bytes"))
        .collect()  # one row per partition
    )
    parts = [t["_part"] for t in totals]
    row_starts = [0, *accumulate(t["rows"] for t in totals)]
    byte_starts = [0, *accumulate(t["bytes"] for t in totals)]
    total = max(byte_starts[-1], 1)
    spark = rows.sparkSession
    starts = spark.createDataFrame(
        list(zip(parts, row_starts, byte_starts)), "_part long, _rows_at long, _bytes_at long"
    )
    placed = (
        numbered.join(F.broadcast(starts), "_part")  # bounded by the number of partitions
        .withColumn("_middle", 2 * (F.col("_bytes_at") + F.col("_before")) + F.col("_size"))
        .withColumn("_shard", F.expr(f"least({n_shards - 1}L, _middle * {n_shards}L div {2 * total}L)"))
        .withColumn("_at", F.col("_rows_at") + F.col("_row"))
    )
    firsts = placed.groupBy("_shard").agg(F.min("_at").alias("_first"))  # a row per shard
    return placed.join(F.broadcast(firsts), "_shard").select(
        *[F.col(k).alias(c) for k, c in zip(kept, carry)],
        F.col("_size").alias("size"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_at") - F.col("_first")).alias("slot"),
    )
