"""Conversation structure repair: cheapest edits by a survivor-coalescence Viterbi search."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.staging import staged

LONG_ROWS = 4_096  # rows from which a conversation is cut into pieces
PIECE_ROWS = 4_096
PIECE_CHARS = 8_000_000
BATCH_CHARS = 4_000_000  # characters of texts returned together
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3  # costs; keeping is free

# Role initials so far: nothing, system, user, assistant; the first and the last may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {
    EMPTY: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
# What a completion from the inner state can cost more, at most, if it starts from the outer
# one: missing roles are inserted (3 each), a system turn that came too late is deleted (4).
SWITCH = {
    EMPTY: {SYSTEM: 0, USER: 3, ASSISTANT: 0},
    SYSTEM: {EMPTY: 6, USER: 3, ASSISTANT: 6},
    USER: {EMPTY: 7, SYSTEM: 3, ASSISTANT: 3},
    ASSISTANT: {EMPTY: 4, SYSTEM: 0, USER: 3},
}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}

TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PIECE_SCHEMA = (
    "key string, piece long, single boolean, last boolean, "
    + ", ".join(f"{f} long" for f in FACTS)
    + ", audit string, turns array<struct<role:string,text:string>>"
)


def added_role(state: int) -> int:
    """State after the one role, user or assistant, that may follow."""
    return ASSISTANT if state == USER else USER


def _inserted(state: int) -> Iterator[tuple[int, int, str]]:
    """States that up to two insertions reach; more would only come round again."""
    cost, edits = 0, ""
    for _ in range(3):
        yield state, cost, edits
        state, cost, edits = added_role(state), cost + INSERT, edits + "I"


def _cheapest(moves: Iterable[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start, end, cost, edits in moves:
        found = (cost, edits)
        if found < best.get((start, end), (1 << 60, "")):
            best[start, end] = found
    return [(a, b, cost, edits) for (a, b), (cost, edits) in best.items()]


@cache
def row_moves(initial: str, unfinished: bool) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, edits) of a row that need not go, with insertions before it.

    Insertions before a deleted row are left out: behind it they cost the same and give a
    smaller audit, since D comes before I.
    """
    extra = UNFINISHED if unfinished else 0
    moves = [(state, state, DELETE, "D") for state in STATES]
    for state in STATES:
        for ready, cost, edits in _inserted(state):
            if initial in NEXT[ready]:
                moves.append((state, NEXT[ready][initial], cost + extra, edits + "K"))
            moves.append((state, added_role(ready), cost + REROLE + extra, edits + "R"))
    return _cheapest(moves)


def deletions(count: int) -> list[tuple[int, int, int, str]]:
    return [(state, state, DELETE * count, "D" * count) for state in STATES]


#: What ends a conversation in a state that may end.
CLOSING = _cheapest(
    (state, EMPTY, cost, edits)
    for state in STATES
    for ready, cost, edits in _inserted(state)
    if ready in (EMPTY, ASSISTANT)
)


class _Node:
    """One step of a path: its edits, its parent, and the nodes that refer to it."""

    __slots__ = ("parent", "edits", "referrers")

    def __init__(self, parent: _Node | None, edits: str):
        self.parent, self.edits = parent, edits
        self.referrers: set[_Node] = set()


def _smaller(a: tuple[_Node, str], b: tuple[_Node, str]) -> bool:
    """Whether path ``a`` spells less than path ``b``: both are compared from the node on
    where they part. Paths of one cost never are prefixes of each other, since only
    insertions lengthen a path and each costs."""
    (x, left), (y, right) = a, b
    ours, theirs = [left], [right]
    while x is not y:
        ours.append(x.edits)
        theirs.append(y.edits)
        x, y = x.parent, y.parent
    return "".join(reversed(ours)) < "".join(reversed(theirs))


class Survivors:
    """The cheapest path to each state, as a tree of back pointers.

    Every survivor is a leaf at the same step. A path that costs more than another one and the
    switch to its state (see ``SWITCH``) cannot win any more, nor tie, and is dropped. A node without referrers is dropped, and its
    parent with it when that has none left; the number of referrers is the reference count.
    Once all survivors descend from one child of the root, its edits are decided: they are
    given out and the child becomes the root. So the tree holds undecided steps only.
    """

    def __init__(self, entry: int = EMPTY):
        self.root = _Node(None, "")
        self.paths: dict[int, tuple[int, _Node]] = {entry: (0, self.root)}

    def _best(self, moves: Iterable[tuple[int, int, int, str]]) -> dict[int, tuple[int, _Node, str]]:
        best: dict[int, tuple[int, _Node, str]] = {}
        for start, end, cost, edits in moves:
            if start not in self.paths:
                continue
            before, node = self.paths[start]
            known = best.get(end)
            total = before + cost
            if (
                known is None
                or total < known[0]
                or (total == known[0] and _smaller((node, edits), known[1:]))
            ):
                best[end] = (total, node, edits)
        return best

    def advance(self, moves: Iterable[tuple[int, int, int, str]]) -> list[str]:
        """One step; returns the edits of all steps that are decided now."""
        leaves = [node for _, node in self.paths.values()]
        best = self._best(moves)
        costs = {state: cost for state, (cost, _, _) in best.items()}
        paths = {}
        for state, (cost, parent, edits) in best.items():
            if any(cost > costs[p] + SWITCH[p][state] for p in costs if p != state):
                continue
            node = _Node(parent, edits)
            parent.referrers.add(node)
            paths[state] = (cost, node)
        self.paths = paths
        for leaf in leaves:
            while not leaf.referrers and leaf.parent is not None:
                leaf.parent.referrers.discard(leaf)
                leaf = leaf.parent
        decided = []
        while len(self.root.referrers) == 1:
            self.root = self.root.referrers.pop()
            self.root.parent = None
            decided.append(self.root.edits)
        return decided

    def suffix(self, node: _Node) -> list[str]:
        """Edits of the undecided steps up to a survivor."""
        steps = []
        while node is not self.root:
            steps.append(node.edits)
            node = node.parent
        return steps[::-1]

    def finish(self, moves: Iterable[tuple[int, int, int, str]]) -> tuple[int, list[str], str]:
        """(cost, edits of the undecided steps, closing edits) of the best complete path."""
        ((cost, node, edits),) = self._best(moves).values()
        return cost, self.suffix(node), edits


class _Writer:
    """Applies decided edits to rows: audit and repaired turns."""

    def __init__(self, entry: int = EMPTY):
        self.state = entry
        self.audit: list[str] = []
        self.turns: list[dict[str, str]] = []

    def write(self, edits: str, role: str = "", text: str = "") -> None:
        self.audit.append(edits)
        for edit in edits:
            if edit == "I":
                self.state = added_role(self.state)
                self.turns.append({"role": ROLE_OF[self.state], "text": ""})
            elif edit == "R":
                self.state = added_role(self.state)
                self.turns.append({"role": ROLE_OF[self.state], "text": text})
            elif edit == "K":
                self.state = NEXT[self.state][role[:1]]
                self.turns.append({"role": role, "text": text})


@dataclass
class _Count:
    """Faults of rows in order, each row by its first fault; pieces can be added up."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    distinct: int = 0
    first: str | None = None  # role initials at both ends
    last: str | None = None
    low: int | None = None  # turns at both ends, without nulls
    high: int | None = None

    def row(self, turn: int | None, initial: str, copies: int = 1) -> None:
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        if copies > 1 and initial * 2 not in LEGAL:
            self.illegal += copies - 1
        self.last = initial

    def add(self, other: dict) -> None:
        """Add the counts of the piece that follows."""
        self.blank += other["blank"]
        self.duplicate += other["duplicate"]
        self.truncated += other["truncated"]
        self.illegal += other["illegal"]
        if self.last is None:
            self.first = other["first"]
        elif self.last + other["first"] not in LEGAL:
            self.illegal += 1
        self.last = other["last"]
        if other["low"] is not None:
            self.distinct += other["distinct"] - (other["low"] == self.high)
            self.low = other["low"] if self.low is None else self.low
            self.high = other["high"]

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct

    def facts(self, cost: int) -> dict[str, int]:
        return {f: cost if f == "cost" else getattr(self, f) for f in FACTS}


def fault(text: str, seen: bool) -> str | None:
    """First fault of a row."""
    bare = text.strip(WHITE)
    if not bare:
        return "blank"
    if seen:
        return "duplicate"
    return None if bare[-1] in ENDS else "truncated"


@dataclass
class _Open:
    """A conversation that is being read."""

    key: str
    counts: _Count = field(default_factory=_Count)
    seen: set[bytes] = field(default_factory=set)
    search: Survivors = field(default_factory=Survivors)
    waiting: deque = field(default_factory=deque)
    out: _Writer = field(default_factory=_Writer)

    def row(self, turn: int | None, role: str, text: str) -> None:
        digest = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode())
        kind = fault(text, digest in self.seen)
        self.seen.add(digest)
        self.counts.row(turn, role[:1])
        if kind:
            setattr(self.counts, kind, getattr(self.counts, kind) + 1)
        moves = deletions(1) if kind in ("blank", "duplicate") else row_moves(role[:1], kind is not None)
        self.waiting.append((role, text))
        self._write(self.search.advance(moves))

    def _write(self, decided: list[str]) -> None:
        for edits in decided:
            self.out.write(edits, *self.waiting.popleft())

    def close(self) -> dict:
        cost, rest, closing = self.search.finish(CLOSING)
        self._write(rest)
        self.out.write(closing)
        return _piece(self.key, 0, True, True, self.counts.facts(cost), self.out)


def _piece(key, piece, single, last, facts, out: _Writer) -> dict:
    row = {"key": key, "piece": piece, "single": single, "last": last}
    row |= {f: facts.get(f) for f in FACTS}
    return row | {"audit": "".join(out.audit), "turns": out.turns}


_PIECE_TYPES = pa.schema(
    [
        ("key", pa.string()), ("piece", pa.int64()), ("single", pa.bool_()), ("last", pa.bool_()),
        *[(f, pa.int64()) for f in FACTS], ("audit", pa.string()), ("turns", TURNS),
    ]
)


def _batched(rows: Iterable[dict], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    ready, chars = [], 0
    for row in rows:
        ready.append(row)
        chars += size(row) + 64
        if chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_pylist(ready, schema)
            ready, chars = [], 0
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema)


def _turn_chars(row: dict) -> int:
    return len(row["audit"]) + sum(len(t["text"]) for t in row["turns"])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations, in order of key and turn, one piece each."""

    def pieces():
        current = None
        for row in _rows(batches):
            if current is None or current.key != row["key"]:
                if current is not None:
                    yield current.close()
                current = _Open(row["key"])
            for _ in range(row["copies"]):
                current.row(row["turn"], row["role"], row["text"])
        if current is not None:
            yield current.close()

    yield from _batched(pieces(), _PIECE_TYPES, _turn_chars)


# --- long conversations: pieces with every entry state, then one choice of states ---

_WAYS = pa.list_(
    pa.struct(
        [("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]
    )
)
_CUT_TYPES = pa.schema(
    [
        ("key", pa.string()), ("piece", pa.int64()), ("ways", _WAYS),
        *[(f, pa.int64()) for f in ("blank", "duplicate", "truncated", "illegal", "distinct")],
        ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()),
        ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]))),
    ]
)
CUT_SCHEMA = (
    "key string, piece long, ways array<struct<entry:int,exit:int,cost:long,audit:string>>,"
    " blank long, duplicate long, truncated long, illegal long, distinct long, first string,"
    " last string, low long, high long, rows array<struct<role:string,text:string,copies:long>>"
)


def _ways(entry: int, steps: list) -> Iterator[dict]:
    search, decided = Survivors(entry), []
    for moves in steps:
        decided += search.advance(moves)
    common = "".join(decided)
    for state, (cost, node) in search.paths.items():
        yield {
            "entry": entry, "exit": state, "cost": cost,
            "audit": common + "".join(search.suffix(node)),
        }


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of bounded size, each searched from every state it may be entered in."""
    number = TaskContext.get().partitionId() << 32

    def pieces():
        nonlocal number
        key, rows, chars = None, [], 0
        for row in _rows(batches):
            if rows and (key != row["key"] or len(rows) >= PIECE_ROWS or chars >= PIECE_CHARS):
                yield summary(key, rows)
                number += 1
                rows, chars = [], 0
            key = row["key"]
            rows.append(row)
            chars += len(row["text"])
        if rows:
            yield summary(key, rows)

    def summary(key, rows):
        counts, steps = _Count(), []
        for row in rows:
            kind = fault(row["text"], row["seen"])
            initial, copies = row["role"][:1], row["copies"]
            counts.row(row["turn"], initial, copies)
            if kind == "blank":
                counts.blank += copies
                steps.append(deletions(copies))
            elif kind == "duplicate":
                counts.duplicate += copies
                steps.append(deletions(copies))
            else:
                counts.truncated += kind is not None
                counts.duplicate += copies - 1
                steps.append(row_moves(initial, kind is not None))
                if copies > 1:
                    steps.append(deletions(copies - 1))
        fields = ("blank", "duplicate", "truncated", "illegal", "distinct", "first", "last", "low", "high")
        return {
            "key": key, "piece": number,
            "ways": [way for entry in STATES for way in _ways(entry, steps)],
            **{f: getattr(counts, f) for f in fields},
            "rows": [{"role": r["role"], "text": r["text"], "copies": r["copies"]} for r in rows],
        }

    yield from _batched(pieces(), _CUT_TYPES, lambda row: sum(len(r["text"]) for r in row["rows"]))


_CHOICE_TYPES = pa.schema(
    [
        ("key", pa.string()), ("piece", pa.int64()), ("entry", pa.int32()), ("audit", pa.string()),
        *[(f, pa.int64()) for f in FACTS],
    ]
)
CHOICE_SCHEMA = "key string, piece long, entry int, audit string, " + ", ".join(f"{f} long" for f in FACTS)


class _Chooser:
    """Search over the pieces of one conversation."""

    def __init__(self, key: str):
        self.key = key
        self.counts = _Count()
        self.search = Survivors()
        self.state = EMPTY
        self.waiting: deque = deque()  # undecided pieces: number, exit by (entry, audit)

    def piece(self, row: dict) -> Iterator[dict]:
        self.counts.add(row)
        ways = [(w["entry"], w["exit"], w["cost"], w["audit"]) for w in row["ways"]]
        self.waiting.append((row["piece"], {(a, audit): b for a, b, _, audit in ways}))
        yield from self._named(self.search.advance(ways))

    def _named(self, decided: list[str]) -> Iterator[dict]:
        for audit in decided:
            number, exits = self.waiting.popleft()
            yield {"key": self.key, "piece": number, "entry": self.state, "audit": audit}
            self.state = exits[self.state, audit]

    def close(self) -> Iterator[dict]:
        cost, rest, closing = self.search.finish(CLOSING)
        yield from self._named(rest)
        yield {
            "key": self.key, "piece": None, "entry": self.state, "audit": closing,
            **self.counts.facts(cost),
        }


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The way through each piece, by the same search with pieces for steps.

    The row of the closing edits has no number and carries the facts.
    """

    def choices():
        current = None
        for row in _rows(batches):
            if current is None or current.key != row["key"]:
                if current is not None:
                    yield from current.close()
                current = _Chooser(row["key"])
            yield from current.piece(row)
        if current is not None:
            yield from current.close()

    yield from _batched(choices(), _CHOICE_TYPES, lambda row: len(row["audit"]))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of each piece whose way is chosen."""

    def pieces():
        for row in _rows(batches):
            out, audit, at = _Writer(row["entry"]), row["audit"], 0
            for turn in row["rows"] or []:
                for _ in range(turn["copies"]):
                    end = at
                    while audit[end] == "I":
                        end += 1
                    out.write(audit[at : end + 1], turn["role"], turn["text"])
                    at = end + 1
            out.write(audit[at:])
            last = row["piece"] is None
            yield _piece(row["key"], row["piece"], False, last, row, out)

    yield from _batched(pieces(), _PIECE_TYPES, _turn_chars)


def _long_pieces(rows: DataFrame) -> DataFrame:
    """Pieces of long conversations (see ``repaired_conversations``)."""
    unique = (
        rows.where("copies > 0")
        .groupBy("key", "turn", "role", "text")
        .agg(F.sum("copies").alias("copies"))
        .withColumn(
            "same",
            F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256),
        )
    )
    place = F.struct(F.col("turn").isNotNull().alias("dated"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = unique.groupBy("key", "same").agg(F.min(place).alias("first"))
    order = ["key", "turn", "role", "text"]
    cut = staged(
        unique.join(first, ["key", "same"])
        .select(*order, "copies", (place > F.col("first")).alias("seen"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_cut, CUT_SCHEMA),
        "conversation-pieces",
    )
    chosen = staged(
        cut.drop("rows").repartition("key").sortWithinPartitions("key", "piece")
        .mapInArrow(_choose, CHOICE_SCHEMA),
        "conversation-ways",
    )
    parts = cut.select("key", "piece", "rows").join(chosen.where("piece is not null"), ["key", "piece"])
    ends = chosen.where("piece is null").withColumn(
        "rows", F.lit(None).cast("array<struct<role:string,text:string,copies:long>>")
    )
    return parts.unionByName(ends).mapInArrow(_apply, PIECE_SCHEMA)


def repaired_conversations(
    rows: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    copies_column: str | None = None,
) -> DataFrame:
    """Cheapest repair of every conversation to role initials ``(s?(ua)+)?``, in pieces.

    Rows stand in the order of their turn, nulls first. A row's first fault counts: blank,
    duplicate (role and text stood before), truncated (the last character that is not white
    is none of ``.!?``). Blank rows and duplicates are deleted (D, 4); other rows are kept
    (K, 0), given the role user or assistant (R, 3) or deleted, and truncated rows that stay
    cost 3 more; turns without text may be inserted anywhere (I, 3). Of the cheapest edits
    those win whose initials are least.

    Result, one row per conversation and piece: the conversation column, ``piece``,
    ``single``, ``last``, the facts ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost`` (on the last piece only), ``audit`` (initials of the edits) and
    ``turns`` (repaired roles and texts). ``conversation_reports`` puts pieces together.

    Conversations of fewer than ``LONG_ROWS`` rows meet in one shuffle and are read in
    order, one piece each; the search (see ``Survivors``) holds undecided rows only. Longer
    ones, found by a count, are cut by ranges of their rows, however large one is: equal
    rows become one with a number of copies, first occurrences come from an aggregation,
    each piece is searched from every state, the same search over the pieces chooses one way
    through each, and the pieces are repaired apart from each other.

    Null roles and texts count as one space. Null turns come first and make no gap. A null
    conversation id is a conversation of its own. Rows that share a turn are taken by role
    and text; repeated rows are duplicates. With ``copies_column`` a row stands that many
    times; 0 leaves the row out, but its conversation stays: without rows it has zeros, an
    empty audit and no turns. An empty table gives an empty result. Other columns are
    ignored, so their names cannot clash.
    """
    conv = F.col(conv_column)
    kind = rows.schema[conv_column].dataType
    base = rows.select(
        F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("key"),
        F.col(turn_column).cast("long").alias("turn"),
        F.coalesce(F.col(role_column), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_column), F.lit(" ")).alias("text"),
        (F.col(copies_column) if copies_column else F.lit(1)).cast("long").alias("copies"),
    )
    long_keys = staged(
        base.groupBy("key").agg(F.sum("copies").alias("n")).where(F.col("n") >= LONG_ROWS).select("key"),
        "long-conversations",
    )
    short = (
        base.join(long_keys, "key", "left_anti")
        .repartition("key")
        .sortWithinPartitions("key", "turn", "role", "text")
        .mapInArrow(_short, PIECE_SCHEMA)
    )
    found = short
    if not long_keys.isEmpty():
        found = short.unionByName(_long_pieces(base.join(long_keys, "key", "left_semi")))
    name = F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias(conv_column)
    return found.select(name, "piece", "single", "last", *FACTS, "audit", "turns")


def _lines(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def conversation_reports(pieces: DataFrame, conv_column: str = "conv_id") -> DataFrame:
    """One row per conversation: facts, whole audit, digest of the repaired lines.

    ``repaired_sha256`` is over ``role:text`` of all turns, joined by line ends. Single
    pieces are digested where they stand. The pieces of a long conversation meet in order in
    one task, because its digest takes all its bytes in order; they come as few rows of
    finished text and pass through one by one.
    """
    kind = pieces.schema[conv_column].dataType.simpleString()
    text = _lines(F.col("turns"))
    single = pieces.where("single").select(
        conv_column, *FACTS, "audit", F.sha2(text, 256).alias("repaired_sha256")
    )
    several = pieces.where("not single").select(
        F.col(conv_column).alias("conv"), "piece", *FACTS, "last", "audit",
        F.when(F.size("turns") > 0, text).alias("lines"),
    )
    ordered = several.repartition("conv").sortWithinPartitions("conv", F.col("piece").asc_nulls_last())

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, audit, empty = hashlib.sha256(), [], True
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                row = part.to_pylist()[0]
                audit.append(row["audit"])
                if row["lines"] is not None:
                    digest.update((b"" if empty else b"\n") + row["lines"].encode())
                    empty = False
                if row["last"]:
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            *[pa.array([row[f]], pa.int64()) for f in FACTS],
                            pa.array(["".join(audit)], pa.string()),
                            pa.array([digest.hexdigest()], pa.string()),
                        ],
                        names=[conv_column, *FACTS, "audit", "repaired_sha256"],
                    )
                    digest, audit, empty = hashlib.sha256(), [], True

    schema = (
        f"`{conv_column}` {kind}, " + ", ".join(f"{f} long" for f in FACTS)
        + ", audit string, repaired_sha256 string"
    )
    return single.unionByName(ordered.mapInArrow(folded, schema))
