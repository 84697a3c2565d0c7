"""Alignment of two tokenizers, with corpus-wide pair counts by external spills."""

from __future__ import annotations

import hashlib
import math
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import merge
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwright.llm.tokens import _byte_of_letter
from panelwright.operators.staging import staged

ID_BITS = 18  # of a token id; a pair is (B id, A id), B id first
RADIX_BITS = 5  # pairs are cut into 32 parts by their B id
DOC_BITS = 21  # of the number of a document inside its run
RUN_LINKS = 4_000_000  # links gathered before they are sorted and counted
RUN_RECORDS = 1_000_000  # pair-document records from which a run is closed
RUN_DOCS = 1 << 18
RUNS_MERGED = 64  # runs that one task merges
QUEUED_UNITS = 100_000  # units of text that are looked up together
JOINED_UNITS = 256  # new units that are encoded as one text
STORED_UNITS = 300_000  # units a worker remembers before it starts afresh
STORED_CHARS = 16_000_000
# Units end before blanks that follow a letter or mark and lead to another one.
UNIT = re.compile(r" \s*\S*(?:(?! +\S)\s+\S*)*")

RUN_SCHEMA = (
    "run long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>,"
    " n_links array<long>, shas array<string>, lengths binary, docs binary, times binary,"
    " slices array<struct<radix:int,keys:binary,counts:binary>>"
)
FACTS = ("n_a", "n_b", "n_groups", "n_links")
OUT_SCHEMA = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,"
    " groups_sha256 string"
)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def radix_of(b: np.ndarray) -> np.ndarray:
    """Part of the pairs of a B id, spread by multiplication."""
    mixed = b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - RADIX_BITS)).astype(np.int64)


class _Units:
    """Alignment of each unit of text met so far; a worker's bounded memory.

    Both tokenizers cut every text between units: the split pattern of the byte-level file
    never joins a blank to what stands before it, and no piece of the other model has its
    blank mark behind another character (checked here). So the tokens of a text are the
    tokens of its units.
    """

    def __init__(self, a_file: str, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(a_file)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letters = _byte_of_letter()
        entries = {i: token for token, i in self.a.get_vocab().items()}
        self.a_bytes = [
            bytes(letters.get(c, 63) for c in entries.get(i, "")) for i in range(max(entries) + 1)
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces with a blank behind another character cannot be aligned")
        if max(len(pieces), len(self.a_bytes)) > 1 << ID_BITS:
            raise ValueError(f"token ids of more than {ID_BITS} bits")
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.sizes = [np.array([len(p) for p in parts], np.int64) for parts in (self.a_bytes, self.b_bytes)]
        # how an id is written inside a group and at the end of its side
        self.a_text = [f"{i}{mark}" for i in range(len(self.a_bytes)) for mark in ",|"]
        self.b_text = [f"{i}{mark}" for i in range(len(self.b_bytes)) for mark in ",;"]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.facts = [array("q") for _ in FACTS]
        self.good = array("q")
        self.starts = array("q")
        self.pairs = array("q")

    def _learn(self, units: list[str]) -> None:
        """Align new units. Those that may stand behind one another are joined, so that both
        libraries are called for many units at once."""
        joinable = [u for u in units if u[-1:].strip() and u.lstrip(" ")[:1].strip()]
        rest = set(units).difference(joinable)
        chunks = [joinable[at : at + JOINED_UNITS] for at in range(0, len(joinable), JOINED_UNITS)]
        chunks += [[u] for u in rest]
        for at in range(0, len(chunks), 64):
            part = chunks[at : at + 64]
            again = [c for c, a, b in self._encoded(part) if not self._keep(c, a, b)]
            # a chunk of which some unit cannot be read back is aligned unit by unit
            singles = [[u] for c in again for u in c]
            for c, a, b in self._encoded(singles):
                if not self._keep(c, a, b):
                    self._add(c, np.zeros((4, 1), np.int64), False, [""], np.empty(0, np.int64))

    def _encoded(self, chunks: list[list[str]]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        texts = ["".join(c) for c in chunks]
        rows = self.a.encode_batch(texts, add_special_tokens=False)
        others = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [
            (c, np.array(a.ids, np.int64), np.array(b, np.int64)) for c, a, b in zip(chunks, rows, others)
        ]

    def _keep(self, units: list[str], a: np.ndarray, b: np.ndarray) -> bool:
        """Align a chunk and remember its units; False if the tokens do not give its bytes."""
        parts = [u.encode() for u in units]
        data = b"".join(parts)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data:
            return False
        if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            return False
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        a_ends, b_ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        pieces = np.union1d(a_ends, b_ends)  # each lies in one token of either side
        pairs = b[np.searchsorted(b_ends, pieces)] << ID_BITS | a[np.searchsorted(a_ends, pieces)]
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        a_last, b_last = cuts[a_group] == a_ends, cuts[b_group] == b_ends
        texts = [self.a_text[i] for i in (2 * a + a_last).tolist()]
        texts += [self.b_text[i] for i in (2 * b + b_last).tolist()]
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable").tolist()
        written = [texts[i] for i in order]
        upto = np.array([np.searchsorted(x, ends, "right") for x in (a_ends, b_ends, cuts, pieces)])
        facts = np.diff(upto, axis=1, prepend=0)
        stops = (upto[0] + upto[1]).tolist()
        groups = ["".join(written[i:j])[:-1] for i, j in zip([0, *stops], stops)]
        self._add(units, facts, True, groups, pairs)
        return True

    def _add(self, units: list[str], facts: np.ndarray, good: bool, groups: list[str], pairs: np.ndarray) -> None:
        first = len(self.groups)
        self.index.update(zip(units, range(first, first + len(units))))
        self.chars += sum(map(len, units))
        self.groups += groups
        self.good.extend([int(good)] * len(units))
        for kept, values in zip(self.facts, facts):
            kept.frombytes(np.ascontiguousarray(values, np.int64).tobytes())
        starts = len(self.pairs) + np.cumsum(facts[3]) - facts[3]
        self.starts.frombytes(starts.astype(np.int64).tobytes())
        self.pairs.frombytes(pairs.astype(np.int64).tobytes())

    def find(self, units: list[str]) -> list[int]:
        """Places of the units in the memory, after learning the new ones."""
        if len(self.groups) > STORED_UNITS or self.chars > STORED_CHARS:
            self.clear()
        places = list(map(self.index.get, units))
        if None in places:
            self._learn(list(dict.fromkeys(u for u, i in zip(units, places) if i is None)))
            places = list(map(self.index.__getitem__, units))
        return places


def _unit_lists(text: str) -> Iterator[list[str]]:
    """Units of a blank and the text, in lists of bounded length."""
    line = " " + text
    if len(line) < 4 * QUEUED_UNITS:
        yield UNIT.findall(line)
        return
    found = (m.group() for m in UNIT.finditer(line))
    while units := list(islice(found, QUEUED_UNITS)):
        yield units


class _Run:
    """Documents and pair-document records that become one run."""

    def __init__(self, units: _Units):
        self.units = units
        self.ids: list[int | None] = []
        self.facts = [array("q") for _ in FACTS]
        self.shas: list = []  # a running digest, None without tokens
        self.bad: set[int] = set()
        self.queue: list[tuple[int, list[str]]] = []
        self.queued = 0
        self.raw: list[np.ndarray] = []
        self.raw_links = 0
        self.keys = np.empty(0, np.int64)
        self.times = np.empty(0, np.int64)

    def add(self, doc_id: int | None, text: str | None) -> None:
        local = len(self.ids)
        self.ids.append(doc_id)
        self.shas.append(None)
        for kept in self.facts:
            kept.append(0)
        if text:
            for units in _unit_lists(text):
                self.queue.append((local, units))
                self.queued += len(units)
                if self.queued >= QUEUED_UNITS:
                    self.absorb()

    def absorb(self) -> None:
        """Align the queued texts and gather their links."""
        if not self.queue:
            return
        places = self.units.find(list(chain.from_iterable(u for _, u in self.queue)))
        found = np.array(places, np.int64)
        sizes = np.array([len(u) for _, u in self.queue], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        good = np.frombuffer(self.units.good, np.int64)[found]
        whole = np.minimum.reduceat(good, starts)
        sums = [np.add.reduceat(np.frombuffer(f, np.int64)[found], starts) for f in self.units.facts]
        texts = self.units.groups
        for at, (local, _) in enumerate(self.queue):
            if not whole[at]:
                self.bad.add(local)
                continue
            groups = ";".join(map(texts.__getitem__, places[starts[at] : ends[at]]))
            if self.shas[local] is None:
                self.shas[local] = hashlib.sha256(groups.encode())
            else:
                self.shas[local].update(b";" + groups.encode())
            for kept, values in zip(self.facts, sums):
                kept[local] += int(values[at])
        links = np.frombuffer(self.units.facts[3], np.int64)[found]
        total = int(links.sum())
        first = np.frombuffer(self.units.starts, np.int64)[found] - (np.cumsum(links) - links)
        pairs = np.frombuffer(self.units.pairs, np.int64)[np.repeat(first, links) + np.arange(total)]
        locals_ = np.repeat(np.array([local for local, _ in self.queue], np.int64), sizes)
        self.raw.append(pairs << DOC_BITS | np.repeat(locals_, links))
        self.raw_links += total
        self.queue, self.queued = [], 0
        if self.raw_links >= RUN_LINKS:
            self.count()

    def count(self) -> None:
        """Turn gathered links into sorted records (pair, document) with their times."""
        fresh, times = np.unique(np.concatenate([*self.raw, np.empty(0, np.int64)]), return_counts=True)
        if len(self.keys):
            both = np.concatenate([self.keys, fresh])
            order = np.argsort(both, kind="stable")
            both, added = both[order], np.concatenate([self.times, times])[order]
            heads = np.flatnonzero(np.diff(both, prepend=-1))
            self.keys, self.times = both[heads], np.add.reduceat(added, heads)
        else:
            self.keys, self.times = fresh, times.astype(np.int64)
        self.raw, self.raw_links = [], 0

    def full(self) -> bool:
        return len(self.keys) >= RUN_RECORDS or len(self.ids) >= RUN_DOCS

    def batch(self, run: int) -> pa.RecordBatch:
        """The run: documents, records side-major inside radix parts, and their pair counts."""
        self.absorb()
        self.count()
        keys, times = self.keys, self.times
        pairs, docs = keys >> DOC_BITS, keys & ((1 << DOC_BITS) - 1)
        if self.bad:
            keep = ~np.isin(docs, np.fromiter(self.bad, np.int64))
            pairs, docs, times = pairs[keep], docs[keep], times[keep]
            for local in self.bad:
                self.shas[local] = None
                for kept in self.facts:
                    kept[local] = 0
        parts = radix_of(pairs >> ID_BITS)
        order = np.argsort(parts, kind="stable")
        parts, pairs, docs, times = parts[order], pairs[order], docs[order], times[order]
        heads = np.flatnonzero(np.diff(pairs, prepend=-1))
        counts = np.add.reduceat(times, heads) if len(heads) else times
        slices = []
        bounds = np.searchsorted(parts[heads], np.arange((1 << RADIX_BITS) + 1))
        for radix, (i, j) in enumerate(zip(bounds, bounds[1:])):
            if j > i:
                slices.append(
                    {"radix": radix, "keys": pack_sorted(pairs[heads[i:j]]), "counts": pack(counts[i:j])}
                )
        lengths = np.diff(np.append(heads, len(pairs)))
        shas = [s.hexdigest() if s else "" for s in self.shas]
        columns = [
            pa.array([run], pa.int64()),
            pa.array([self.ids], pa.list_(pa.int64())),
            *[pa.array([list(f)], pa.list_(pa.int64())) for f in self.facts],
            pa.array([shas], pa.list_(pa.string())),
            *[pa.array([pack(v)], pa.binary()) for v in (lengths, docs, times)],
            pa.array(
                [slices],
                pa.list_(
                    pa.struct(
                        [("radix", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]
                    )
                ),
            ),
        ]
        names = ["run", "doc_ids", *FACTS, "shas", "lengths", "docs", "times", "slices"]
        return pa.RecordBatch.from_arrays(columns, names=names)


_stores: dict[int, _Units] = {}  # of a Python worker, by digest of the files


def _merged(slices: pa.Table) -> pa.Table:
    """Pair counts of the slices of one radix part, by a k-way merge over a heap."""
    runs = [
        zip(unpack_sorted(k).tolist(), unpack(c).tolist())
        for k, c in zip(slices["keys"].to_pylist(), slices["counts"].to_pylist())
    ]
    pairs, counts = array("q"), array("q")
    last = -1
    for pair, count in merge(*runs):
        if pair == last:
            counts[-1] += count
        else:
            pairs.append(pair)
            counts.append(count)
            last = pair
    radix = slices["radix"][0].as_py()
    return pa.table(
        {
            "radix": pa.array([radix] * len(pairs), pa.int32()),
            "pair": pa.array(np.frombuffer(pairs, np.int64)),
            "n": pa.array(np.frombuffer(counts, np.int64)),
        }
    )


def _sent_back(slices: pa.Table, totals: pa.Table) -> pa.Table:
    """Corpus-wide counts of the pairs of each slice, in the order of the slice."""
    pairs = totals["pair"].to_numpy()
    order = np.argsort(pairs)
    pairs = pairs[order]
    counts = totals["n"].to_numpy()[order]
    best = totals["best"].to_numpy()[order].astype(np.int64)
    found = [np.searchsorted(pairs, unpack_sorted(k)) for k in slices["keys"].to_pylist()]
    return pa.table(
        {
            "run": slices["run"],
            "radix": slices["radix"],
            "counts": pa.array([pack(counts[at]) for at in found], pa.binary()),
            "best": pa.array([pack(best[at]) for at in found], pa.binary()),
        }
    )


def _contributed(runs: pa.Table, parts: pa.Table) -> pa.Table:
    """Final rows of the documents of one run."""
    row = runs.to_pylist()[0]
    size = len(row["doc_ids"])
    best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
    if parts.num_rows:
        sent = sorted(parts.to_pylist(), key=lambda r: r["radix"])
        lengths, docs, times = (unpack(row[c]) for c in ("lengths", "docs", "times"))
        counts = np.repeat(np.concatenate([unpack(r["counts"]) for r in sent]), lengths)
        flags = np.repeat(np.concatenate([unpack(r["best"]) for r in sent]), lengths)
        np.add.at(total, docs, times * counts)
        np.add.at(best, docs, times * flags)
    return pa.table(
        {
            "doc_id": pa.array(row["doc_ids"], pa.int64()),
            **{name: pa.array(row[name], pa.int64()) for name in FACTS},
            "n_best": pa.array(best),
            "count_sum": pa.array(total),
            "groups_sha256": pa.array(row["shas"], pa.string()),
        }
    )


def alignment(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Alignment of two tokenizers over every whole text, with corpus-wide pair counts.

    ``a_path`` names a byte-level file of the tokenizers library, ``b_path`` a sentencepiece
    model. The driver sends both files (bounded by their vocabularies) to the executors.

    1. Each task aligns its texts unit by unit, remembers frequent units, and gathers
       pair-document records. From ``RUN_RECORDS`` records on it closes a run: records
       sorted side-major (B id, then A id, then document) inside 32 radix parts of the B id,
       compressed by Zstandard, with the count of each pair on its own, and the facts of the
       run's documents. A run is one row of a table staged in the shared folder.
    2. The counts of up to ``RUNS_MERGED`` runs and one radix part are merged over a heap;
       Spark adds up the merges. The order is side-major, so the pairs of a B id stay
       together and their maximum is one aggregation of at most as many rows as A has ids.
       A pair that all documents hold is one entry per run, so no key is hot.
    3. The totals go back to the runs part by part, and each run adds them up for its own
       documents; records are read twice and never sorted again.

    Result: ``doc_id``, ``n_a``, ``n_b`` (tokens), ``n_groups`` (between common ends),
    ``n_links`` (overlapping token pairs), ``n_best`` (links whose pair count is the highest
    of their B id, ties included), ``count_sum`` and ``groups_sha256``. Null and empty texts
    and texts whose token bytes differ from a blank and the text have zeros, an empty digest
    and no part in the counts. Null ids stay null; repeated rows count each; an empty table
    gives an empty result. Other columns are ignored, so their names cannot clash. Long texts
    are aligned in bounded lists of units; one unit without blanks is held whole.
    """
    with open(a_path, encoding="utf-8") as a_file, open(b_path, "rb") as b_file:
        shipped = docs.sparkSession.sparkContext.broadcast((a_file.read(), b_file.read()))

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = shipped.value
        known = xxhash.xxh3_64_intdigest(files[1], xxhash.xxh3_64_intdigest(files[0]))
        if known not in _stores:
            _stores.clear()
            _stores[known] = _Units(*files)
        number = TaskContext.get().partitionId() << 32
        run = _Run(_stores[known])
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                run.add(doc_id.as_py(), text.as_py())
                if run.full():
                    yield run.batch(number)
                    number += 1
                    run = _Run(_stores[known])
        if run.ids:
            yield run.batch(number)

    base = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    encoded = staged(base.mapInArrow(runs, RUN_SCHEMA), "runs")
    groups = max(1, math.ceil(encoded.select("run").count() / RUNS_MERGED))
    slices = encoded.select("run", F.inline("slices")).withColumn(
        "group", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int")
    )
    merged = (
        slices.select("radix", "group", "keys", "counts")
        .groupBy("radix", "group")
        .applyInArrow(_merged, "radix int, pair long, n long")
    )
    counted = staged(
        merged.groupBy("radix", "pair").agg(F.sum("n").alias("n")), "pair-counts"
    ).withColumn("b", F.shiftright("pair", ID_BITS))
    highest = counted.groupBy("b").agg(F.max("n").alias("high"))
    totals = counted.join(highest, "b").select(
        "radix", "pair", "n", (F.col("n") == F.col("high")).alias("best"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
    )
    back = (
        slices.select("radix", "group", "run", "keys")
        .groupBy("radix", "group")
        .cogroup(totals.groupBy("radix", "group"))
        .applyInArrow(_sent_back, "run long, radix int, counts binary, best binary")
    )
    out = (
        encoded.drop("slices")
        .groupBy("run")
        .cogroup(back.groupBy("run"))
        .applyInArrow(_contributed, OUT_SCHEMA)
    )
    return out.withColumnRenamed("doc_id", id_column)
