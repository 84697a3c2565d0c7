"""SimHash near-duplicates: pigeonhole blocks, with midpoints where a block is crowded."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.components import connected_components, shared_ids
from panelwright.operators.staging import shuffled, staged

BITS = 64
SHINGLE_WORDS = 3
SEED = 42
HASHES_AT_ONCE = 4_096  # hashes whose bits are counted together
TEXT_BLOCK = 1 << 20  # bytes of a text that are split into words together
CROWDED = 200  # members of a block from which midpoints are cheaper than pairs
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text (runs of anything but ASCII white space), about a megabyte at a time."""
    at = 0
    while at < len(data):
        end = at + TEXT_BLOCK
        if end < len(data):
            gap = _WHITE.search(data, end)
            end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


def _hashes(words: list[bytes], length: int) -> np.ndarray:
    count = len(words) - length + 1
    view = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: count - 1].tolist()]
    stops = (ends[length - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(view[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, count)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash: a bit is set if more than half of the shingle hashes have it.

    Shingles are three words in a row, repeats included; fewer words make one shingle, and
    a text without words has the fingerprint 0.
    """
    votes = np.zeros(BITS, np.int64)
    total = 0
    carry: list[bytes] = []

    def add(words: list[bytes], length: int) -> int:
        hashes = _hashes(words, length)
        for at in range(0, len(hashes), HASHES_AT_ONCE):
            block = hashes[at : at + HASHES_AT_ONCE].astype("<u8")
            bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[:] += bits.sum(axis=0, dtype=np.int64)
        return len(hashes)

    for words in word_blocks((text or "").encode().lower()):
        words = carry + words
        if len(words) >= SHINGLE_WORDS:
            total += add(words, SHINGLE_WORDS)
            carry = words[1 - SHINGLE_WORDS :]
        else:
            carry = words
    if not total and carry:
        total = add(carry, len(carry))
    return int(np.packbits(2 * votes > total, bitorder="little").view("<i8")[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str | None, int] = {}
        prints = []
        for value in batch.column(1):
            text = value.as_py()
            if text not in known:
                known[text] = fingerprint(text)
            prints.append(known[text])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints, pa.int64())], names=["id", "print"]
        )


def block_masks(distance: int) -> list[int]:
    """Masks, as signed longs, of which close pairs agree on at least one.

    The bits are cut into twice as many blocks as bits may differ; at most ``distance`` of
    these hold a difference, so two close fingerprints agree on half of the blocks, and
    every choice of half of the blocks is one key. For distance 3: 20 keys of 32 bits.
    """
    count = 2 * distance
    cuts = [round(i * BITS / count) for i in range(count + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, count - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _differing(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def _block_links(members: DataFrame, distance: int) -> DataFrame:
    """Verified links among the fingerprints of each uncrowded block."""
    x, y = members.alias("x"), members.alias("y")
    met = x.join(
        shuffled(y),
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.id") < F.col("y.id"))
        & (_differing(F.col("x.print"), F.col("y.print")) <= distance),
    )
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _midpoint_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links that connect exactly what all pairs within ``distance`` would connect.

    Two fingerprints within the distance have a midpoint: at most half the distance
    (rounded down, ``near``) from one and the rest (``far``) from the other. Every
    fingerprint is written under all points up to ``far`` away. A point with a member within
    ``near`` links all its members to that one: each such link is within near + far, and
    both ends of a close pair meet at their midpoint. The number of rows is a constant per
    fingerprint, whatever the size of a group, and a point has no more members than there
    are fingerprints around it.
    """
    near, far = distance // 2, distance - distance // 2
    flips = [(d, sum(1 << b for b in bits)) for d in range(far + 1) for bits in combinations(range(BITS), d)]
    steps = np.array([d for d, _ in flips], np.int32)
    masks = np.array([m for _, m in flips], np.uint64).view(np.int64)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            own = batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), 64):
                part = own[at : at + 64]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids[at : at + 64], len(masks))),
                        pa.array(np.bitwise_xor.outer(part, masks).ravel()),
                        pa.array(np.tile(steps, len(part))),
                    ],
                    names=["id", "point", "steps"],
                )

    around = prints.select("id", "print").mapInArrow(points, "id long, point long, steps int")
    centre = F.min(F.struct("steps", "id")).over(Window.partitionBy("point"))
    return (
        around.withColumn("centre", centre)
        .where((F.col("centre.steps") <= near) & (F.col("centre.id") != F.col("id")))
        .select(F.col("centre.id").alias("a"), F.col("id").alias("b"))
        .distinct()
    )


def simhash_duplicates(
    docs: DataFrame, distance: int = 3, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """SimHash components: (id column, fingerprint, component_id) per row.

    1. One narrow pass gives each text its fingerprint (see ``fingerprint``). Equal
       fingerprints share one representative, their smallest id, so copies never form pairs.
    2. Pigeonhole blocks (see ``block_masks``): representatives within ``distance`` bits
       share a block for certain. Blocks are counted first; those with up to ``CROWDED``
       members are joined with themselves and every pair is verified by its Hamming
       distance.
    3. Fingerprints of crowded blocks, as large groups of near copies give them, link through
       midpoints instead (see ``_midpoint_links``): the same components, and a constant
       number of rows per fingerprint in place of the square of the group. A pair that meets
       in a crowded block only has both ends there, so no link is lost.
    4. Links become components by joins.

    No join is broadcast: a fingerprint of a few bytes grows into 20 keys, which Spark does
    not see in the size of the staged files.

    Null and empty texts and texts without words have the fingerprint 0 and link like any
    other. Rows with a null id get a fingerprint, link with nothing and have a null
    component. Rows that repeat an id share its component, whatever their texts, and join
    what each of these texts links with. An empty table gives an empty result. Other columns
    are ignored, so their names cannot clash.
    """
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = staged(base.mapInArrow(_sign, "id long, print long"), "fingerprints")
    reps = staged(
        signed.where("id is not null").groupBy("print").agg(F.min("id").alias("id")), "representatives"
    )
    keys = reps.select(
        "id",
        "print",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.xxhash64(F.lit(slot), F.col("print").bitwiseAND(F.lit(mask))).alias("key")
                    )
                    for slot, mask in enumerate(block_masks(distance))
                ]
            )
        ),
    )
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = staged(keys.join(shuffled(sizes), "key"), "blocks")
    crowded = shared.where(F.col("members") > CROWDED).select("id", "print").distinct()
    links = _block_links(shared.where(F.col("members") <= CROWDED), distance).union(
        _midpoint_links(crowded, distance)
    )

    placed = staged(
        signed.join(shuffled(reps.withColumnRenamed("id", "rep")), "print", "left").select("id", "print", "rep"),
        "placed",
    )
    bridges = shared_ids(placed, "id", "rep")
    groups = connected_components(links.union(bridges)).select(
        F.col("node").alias("rep"), "component"
    )
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return placed.join(shuffled(groups), "rep", "left").select(
        F.col("id").alias(id_column),
        hexed.alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"),
    )
