"""Benchmark decontamination by a prefix-filtered set join over item-sized windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.shingles import run_hashes
from panelwright.operators.staging import staged

WINDOW_WORDS = 13
SHINGLE_WORDS = 5
FILTER_BITS = 26  # the filter of benchmark shingles has 2^26 bits, 8 MB, whatever their number
SEGMENT_BITS = 15  # bits of one segment while the filter is built

# Words are runs of 0-9, a-z (A-Z in lower case) and non-ASCII characters.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct windows of each item with the hashes of their shingles by offset."""
    for batch in batches:
        items, texts, sizes, hashes = [], [], [], []
        for item, value in zip(batch.column(0), batch.column(1)):
            words = words_of(value.as_py())
            size = min(WINDOW_WORDS, len(words))
            known = set()
            for at in range(len(words) - size + 1 if size else 0):
                window = words[at : at + size]
                text = b" ".join(window).decode()
                if text not in known:
                    known.add(text)
                    items.append(item.as_py())
                    texts.append(text)
                    sizes.append(size)
                    hashes.append(run_hashes(window, min(SHINGLE_WORDS, size)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(items, pa.string()), pa.array(texts, pa.string()),
                pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64())),
            ],
            names=["item", "window", "size", "hashes"],
        )


def _shingle_filter(windows: DataFrame) -> bytes:
    """Bits of all benchmark shingles; at most 2^11 segments of 4 KB reach the driver."""
    bit = F.shiftrightunsigned(F.col("hash"), 64 - FILTER_BITS)
    segments = (
        windows.select(F.explode("hashes").alias("hash"))
        .select(
            F.shiftright(bit, SEGMENT_BITS).alias("segment"),
            bit.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).alias("at"),
        )
        .groupBy("segment")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
        .collect()
    )
    width = 1 << (SEGMENT_BITS - 3)
    bits = bytearray(1 << (FILTER_BITS - 3))
    for row in segments:
        bits[row["segment"] * width : row["segment"] * width + len(row["bits"])] = row["bits"]
    return bytes(bits)


_HIT = pa.struct([("at", pa.int64()), ("hash", pa.int64())])


def _scanner(lengths: list[int], shipped):
    """One row per document: its words, the places of possible benchmark shingles, and the
    text again where there are any."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_bits = np.frombuffer(shipped.value, np.uint8)
        for batch in batches:
            counts, hits, texts = [], [], []
            for value in batch.column(2):
                text = value.as_py()
                words = words_of(text)
                found = []
                for length in lengths:
                    hashes = run_hashes(words, length)
                    bit = hashes >> np.uint64(64 - FILTER_BITS)
                    there = filter_bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)
                    places = np.flatnonzero(there & 1)
                    found += zip(places.tolist(), hashes[places].view(np.int64).tolist())
                counts.append(len(words))
                hits.append([{"at": a, "hash": h} for a, h in found])
                texts.append(text if found else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
                    pa.array(hits, pa.list_(_HIT)), pa.array(texts, pa.string()),
                ],
                names=["row", "id", "n_words", "hits", "text"],
            )

    return scan


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words inside true occurrences and the windows that occur, of each candidate row."""
    for batch in batches:
        counts, occurring = [], []
        for value, candidates in zip(batch.column(1), batch.column(2)):
            words = words_of(value.as_py())
            edges = np.zeros(len(words) + 1, np.int64)
            found = set()
            for candidate in candidates.as_py():
                start, window = candidate["start"], candidate["window"]
                expected = window.encode().split()
                if words[start : start + len(expected)] == expected:
                    edges[start] += 1
                    edges[start + len(expected)] -= 1
                    found.add(window)
            counts.append(int(np.count_nonzero(np.cumsum(edges)[:-1])))
            occurring.append(sorted(found))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(counts, pa.int64()),
                pa.array(occurring, pa.list_(pa.string())),
            ],
            names=["row", "n_hit", "windows"],
        )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    share: int = 20,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Words of each document that lie inside benchmark windows, and the items concerned.

    A window is 13 consecutive item words (a shorter item is one window). It is contained in
    a text only with all its five-word shingles, so its necessary prefix in any order of
    shingles is a single one; the order is by rarity in the corpus, which keeps the join as
    small as it can be.

    1. The shingles of all windows fill a bit filter of fixed size, which every executor gets.
    2. One narrow pass over the documents hashes their shingles and keeps the places that the
       filter lets through (all true places and about one in 10^4 others), with the text
       where there are any. The result is staged.
    3. These places give the corpus frequency of each benchmark shingle. Each window is
       indexed under its rarest shingle and joined to the places by hash. The offset of the
       shingle fixes the start of the window; starts before the first or ends behind the last
       word are dropped (positional and length bound). Spark splits hot hashes.
    4. Each remaining start is compared word by word with the text.

    Result per row: the id column, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``
    (digest of the sorted item ids) and ``contaminated`` (``n_hit`` > 0 and
    ``share * n_hit >= n_words``). Null texts have no words; null ids stay null; repeated
    rows are judged each; items without words have no window; a null item id counts as an
    item with an empty name. Empty tables give no rows, or rows without hits. Other columns
    are ignored, so their names cannot clash.
    """
    context = docs.sparkSession.sparkContext
    items = benchmark.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"),
        F.col(item_text_column).alias("text"),
    )
    windows = staged(
        items.mapInArrow(_windows, "item string, window string, size long, hashes array<long>"),
        "windows",
    )
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # 13 at most
    lengths = sorted({min(SHINGLE_WORDS, size) for size in sizes})
    shipped = context.broadcast(_shingle_filter(windows))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("id"),
        F.col(text_column).alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    scanned = staged(
        rows.mapInArrow(
            _scanner(lengths, shipped),
            f"row long, id {id_type}, n_words long, hits array<struct<at: long, hash: long>>,"
            " text string",
        ),
        "scanned",
    )

    places = scanned.where(F.size("hits") > 0).select(
        "row", "n_words", F.inline("hits").alias("at", "hash")
    )
    frequency = places.groupBy("hash").agg(F.count(F.lit(1)).alias("places"))
    prefixes = (
        windows.select("window", "size", "hashes")
        .dropDuplicates(["window"])
        .select("window", "size", F.posexplode("hashes").alias("offset", "hash"))
        .join(frequency, "hash")  # a shingle that occurs nowhere rules its window out below
        .groupBy("window", "size")
        .agg(
            F.count(F.lit(1)).alias("present"),
            F.min(F.struct("places", "offset", "hash")).alias("rarest"),
        )
        .where(F.col("present") == F.col("size") - F.least(F.lit(SHINGLE_WORDS), "size") + 1)
        .select("window", "size", "rarest.offset", "rarest.hash")
    )
    start = F.col("at") - F.col("offset")
    candidates = (
        places.join(prefixes, "hash")
        .where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .groupBy("row")
        .agg(F.collect_list(F.struct(start.alias("start"), "window")).alias("candidates"))
    )
    found = staged(
        scanned.select("row", "text")
        .join(candidates, "row")
        .mapInArrow(_verify, "row long, n_hit long, windows array<string>"),
        "found",
    )
    named = (
        found.select("row", F.explode("windows").alias("window"))
        .join(windows.select("window", "item"), "window")
        .select("row", "item")
        .distinct()
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))  # benchmark items at most
    )
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        scanned.select("row", "id", "n_words")
        .join(found.select("row", "n_hit"), "row", "left")
        .join(named, "row", "left")
        .select(
            F.col("id").alias(id_column),
            "n_words",
            hit.alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"),
        )
    )
