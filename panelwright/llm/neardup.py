"""MinHash near-duplicates by a multi-index Hamming join with exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.components import connected_components, shared_ids
from panelwright.llm.shingles import run_hashes
from panelwright.operators.staging import shuffled, staged

SHINGLE_WORDS = 5
SYMBOLS = 64  # minimum hashes of a signature
CHUNK = 4  # symbols of a chunk; 16 bits each fill one long
HASH_BLOCK = 1_024  # shingles hashed at once, bounds a worker's memory
FOLD_WORDS = 4  # longs that hold the folded shingles a text lacks
SMALL_IDS = 1_000_000  # ids sent to every executor at most (8 MB of keys)

_rng = np.random.default_rng(20_240_607)
_FACTORS = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
EMPTY = np.empty(0, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case: runs of anything but ASCII white space."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles; fewer words make one shingle."""
    return np.unique(run_hashes(words, min(SHINGLE_WORDS, len(words)))) if words else EMPTY


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 longs of four 16-bit symbols each, of a set of shingle hashes."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), HASH_BLOCK):
        block = np.multiply.outer(hashes[at : at + HASH_BLOCK], _FACTORS)
        block += _OFFSETS
        np.minimum(least, block.min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint64(32))) * _MIX
    return (mixed >> np.uint64(48)).astype("<u2").view("<i8")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, counts, chunks = [], [], []
        known: dict[bytes, tuple] = {}
        for value in batch.column(1):
            words = words_of(value.as_py() or "")
            digest = xxhash.xxh3_128_digest(b" ".join(words))
            if digest not in known:
                hashes = shingle_hashes(words)
                known[digest] = len(hashes), signature(hashes) if words else None
            count, symbols = known[digest]
            digests.append(digest if words else None)
            counts.append(count)
            chunks.append(symbols)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(digests, pa.binary()),
                pa.array(counts, pa.int64()),
                pa.array(chunks, pa.list_(pa.int64())),
            ],
            names=["id", "digest", "n", "chunks"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_hashes(words_of(v.as_py() or "")).view(np.int64) for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"]
        )


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact overlap of the full sets of each pair (a, b): ``na``, ``nb``, ``common``, and
    the shingles of ``a`` that ``b`` lacks, folded into 256 bits (``lacks``).

    The sets meet the pairs by two joins on the id, which Spark splits where a text has very
    many partners.
    """
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_sb"))
    both = pairs.join(right, "b").join(left, "a").withColumn(
        "_lacking", F.array_except("_sa", "_sb")
    )

    def folded(word: int) -> Column:
        own = F.filter("_lacking", lambda h: h.bitwiseAND(F.lit(FOLD_WORDS - 1)) == word)
        return F.aggregate(
            own,
            F.lit(0).cast("long"),
            lambda s, h: s.bitwiseOR(
                F.call_function(
                    "shiftleft",
                    F.lit(1).cast("long"),
                    F.shiftright(h, 2).bitwiseAND(F.lit(63)).cast("int"),
                )
            ),
        )

    return both.select(
        "a", "b",
        F.size("_sa").cast("long").alias("na"),
        F.size("_sb").cast("long").alias("nb"),
        (F.size("_sa") - F.size("_lacking")).cast("long").alias("common"),
        F.array(*[folded(w) for w in range(FOLD_WORDS)]).alias("lacks"),
    )


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    union = F.col("na") + F.col("nb") - F.col("common")
    return compared.where(F.col("common") * 100 >= union * percent).select("a", "b")


def _shingle_sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Full sets of the texts with the given ids.

    The ids go to every executor while they are few (counted first); beyond ``SMALL_IDS``
    the texts meet them by a shuffled join.
    """
    few = ids.count() <= SMALL_IDS
    return staged(
        texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
        .mapInArrow(_sets, "id long, shingles array<long>")
        .dropDuplicates(["id", "shingles"]),
        "sets",
    )


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(id, own): shingles of each text that no other candidate text has."""
    single = (
        sets.select("id", F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("texts"))
        .where("texts = 1")
    )
    return single.groupBy("id").agg(F.count(F.lit(1)).alias("own"))


MASKS = [-1 - (0xFFFF << (16 * k)) for k in range(CHUNK - 1)] + [(1 << 48) - 1]


def chunk_keys(reps: DataFrame) -> DataFrame:
    """Index rows (key, slot, id): every chunk with each of its symbols left out.

    Two signatures that differ in at most 31 of 64 symbols, fewer than two for each of the 16
    chunks, have, by the pigeonhole principle, a chunk of four with at most one differing
    symbol; leaving out that symbol gives both the same key. ``slot`` numbers the 64 chunks and omissions.
    """
    one = reps.select("id", F.posexplode("chunks").alias("_chunk", "_symbols"))
    options = F.array(
        *[
            F.struct(
                F.xxhash64(
                    F.col("_chunk"), F.lit(k), F.col("_symbols").bitwiseAND(F.lit(m))
                ).alias("key"),
                (F.col("_chunk") * CHUNK + k).alias("slot"),
            )
            for k, m in enumerate(MASKS)
        ]
    )
    return one.select("id", F.inline(options)).select("key", "slot", "id")


def _first_slot(x: Column, y: Column) -> Column:
    """The first slot in which two signatures share their key, so that a pair that meets
    under many keys is taken up once."""
    same = F.zip_with(
        x, y,
        lambda p, q: F.array(*[p.bitwiseXOR(q).bitwiseAND(F.lit(m)) == 0 for m in MASKS]),
    )
    return F.array_position(F.flatten(same), True) - 1


def _may_link(percent: int) -> Column:
    """Necessary conditions of a link between open rows x and y of one key.

    Sizes within the ratio; then two upper bounds of the intersection. Shingles that only one candidate text has cannot be common. Against the
    pivot p of the key: of p's shingles, those that x or y lacks are not common (folding
    can only make them fewer), and beyond p at most the smaller rest that is not unique.
    """
    n, m = F.col("x.n"), F.col("y.n")
    bound = F.least(n - F.col("x.own"), m - F.col("y.own"))
    lost = [
        F.bit_count(
            F.get("x.lacks", F.lit(w)).bitwiseOR(F.get("y.lacks", F.lit(w)))
        )
        for w in range(FOLD_WORDS)
    ]
    beyond = F.least(
        *[
            F.greatest(F.col(f"{s}.n") - F.col(f"{s}.common") - F.col(f"{s}.own"), F.lit(0))
            for s in "xy"
        ]
    )
    # the own shingles of any text but the pivot itself lie beyond the pivot
    by_pivot = F.col("x.np") - reduce(add, lost) + beyond
    ratio = lambda common: common * 100 >= (n + m - common) * percent
    return (
        (n * 100 >= m * percent)
        & (m * 100 >= n * percent)
        & ratio(bound)
        & ratio(F.least(by_pivot, n, m))
    )


def near_duplicates(
    docs: DataFrame, percent: int = 75, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Near-duplicate components: (id column, n_shingles, component_id, kept) per row.

    1. One narrow pass hashes each text: word digest, set size and a signature of 64
       minimum hashes of 16 bits. Texts with the same word sequence then share one
       representative (their smallest id), so copies never form pairs.
    2. Multi-index join: 16 chunks of four symbols, each with one symbol left out, give 64
       keys per representative. Signatures within 31 symbols share a key for certain. True
       pairs at the threshold differ in 16 symbols on average (deviation 3.5), so fewer than
       one in 10,000 of them is above that, and pairs of higher similarity practically never.
    3. The full sets of all texts that share a key are hashed once more, and the shingles
       that only one of these texts has are counted. A text whose other shingles are too few
       for any link leaves here, so texts of one template that differ in their own parts
       form no pairs.
    4. Every key links its members to its pivot, the member with the fewest own shingles and
       so as a rule the least edited copy. The exact overlaps with the pivots give the first
       links, which are joined into components. Then, only under keys whose members still
       lie in different components, those cross-component pairs are compared that the sizes,
       the own shingles and the overlaps with the pivot allow (see ``_may_link``), each pair
       under its first common key. No link that a key offers is lost, while a
       large group of near copies costs one pair per member and key. Pairs inside one
       component need no comparison: they could not change the result.
    5. Links are confirmed by 100 * intersection >= percent * union on the full sets.

    Texts without words (null, empty) link with nothing and keep their own id. Rows with a
    null id stay unlinked and are kept. Rows that repeat an id share its component, whatever
    their texts, and join what each of these texts links with. Ids are read as longs. An
    empty table gives an empty result. Other columns are ignored, so their names cannot clash.
    """
    base = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = staged(
        base.mapInArrow(
            _sign, "id long, digest binary, n long, chunks array<long>"
        ),
        "signatures",
    )
    reps = staged(
        signed.where("id is not null and digest is not null")
        .groupBy("digest")
        .agg(
            F.min("id").alias("id"), F.first("n").alias("n"), F.first("chunks").alias("chunks")
        ),
        "representatives",
    )
    keys = chunk_keys(reps)
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = staged(keys.join(shuffled(several.select("key")), "key", "left_semi"), "buckets")
    ids = staged(shared.select("id").distinct(), "ids")
    sets = _shingle_sets(base, ids)
    marks = staged(
        reps.select("id", "n")
        .join(ids, "id", "left_semi")
        .join(_own_shingles(sets), "id", "left")
        .select("id", "n", F.coalesce("own", F.lit(0).cast("long")).alias("own"))
        .where((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent),
        "marks",
    )
    marked = staged(shared.join(marks, "id"), "marked")
    pivots = marked.groupBy("key").agg(F.min(F.struct("own", "id")).alias("p"))
    placed = staged(
        marked.join(pivots, "key").select(
            "key", "slot", "id", "n", "own", F.col("p.id").alias("pivot")
        ),
        "placed",
    )
    star = placed.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    compared = staged(_compared(staged(star, "pairs"), sets), "compared")
    links = staged(_linked(compared.where("a <> b"), percent), "links")
    groups = connected_components(links)

    labelled = staged(
        placed.join(groups.withColumnRenamed("node", "id"), "id", "left").select(
            *placed.columns, F.coalesce("component", "id").alias("component")
        ),
        "labelled",
    )
    mixed = (
        labelled.groupBy("key")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        .where("_low < _high")
        .select("key")
    )
    overlaps = compared.select(
        F.col("a").alias("pivot"), F.col("b").alias("id"), F.col("na").alias("np"), "common", "lacks"
    )
    open_rows = staged(
        labelled.join(mixed, "key", "left_semi")
        .join(overlaps, ["pivot", "id"])
        .join(reps.select("id", "chunks"), "id"),
        "open",
    )
    x, y = open_rows.alias("x"), open_rows.alias("y")
    crossing = x.join(
        shuffled(y),
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.component") < F.col("y.component"))
        & _may_link(percent)
        & (_first_slot(F.col("x.chunks"), F.col("y.chunks")) == F.col("x.slot")),
    )
    rest = crossing.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    second = _linked(_compared(staged(rest, "pairs"), sets), percent)
    mapped = staged(
        signed.join(reps.select("digest", F.col("id").alias("rep")), "digest", "left").select(
            "id", "n", "rep"
        ),
        "mapped",
    )
    final = connected_components(
        links.union(second).union(shared_ids(mapped, "id", "rep"))
    ).withColumnRenamed("node", "rep")
    found = mapped.join(final, "rep", "left").withColumn("_named", F.coalesce("component", "rep"))
    own = F.when(F.col("id").isNotNull(), F.coalesce("_named", "id"))
    return found.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
    )
