from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from panelwright.llm import repair
from panelwright.llm.repair import conversation_reports, repaired_conversations

WHITE = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    for conv, turn, role, text in rows:
        shown = [" " if v is None else v for v in (conv, turn)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, role, text


def faults(rows):
    seen, kinds = set(), []
    for _, role, text in rows:
        marks = WHITE.findall(text)
        if not marks:
            kinds.append("blank")
        elif (role, text) in seen:
            kinds.append("duplicate")
        else:
            kinds.append("" if marks[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return kinds


def shape_of(roles):
    """Roles so far stand for their pattern: 0 nothing, 1 s, 2 ends in u, 3 ends in a."""
    return {"": 0, "s": 1}.get(roles, 2 if roles[-1:] == "u" else 3)


def cheapest(rows, kinds):
    """(cost, audit, repaired turns) by keeping the least whole string per pattern."""
    best = {0: (0, "", [])}

    def inserted(table):
        table = dict(table)
        for _ in range(3):
            for shape, (cost, audit, out) in list(table.items()):
                target, role = (3, "assistant") if shape == 2 else (2, "user")
                new = (cost + 3, audit + "I", [*out, (role, "")])
                table[target] = min(table.get(target, (1 << 60,)), new)
        return table

    for (_, role, text), kind in zip(rows, kinds):
        table = {}

        def offer(shape, value):
            table[shape] = min(table.get(shape, (1 << 60,)), value)

        for shape, (cost, audit, out) in inserted(best).items():
            offer(shape, (cost + 4, audit + "D", out))
            if kind not in ("blank", "duplicate"):
                cost += 3 * (kind == "truncated")
                steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[shape]
                if role[:1] in steps:
                    offer(steps[role[:1]], (cost, audit + "K", [*out, (role, text)]))
                target, name = (3, "assistant") if shape == 2 else (2, "user")
                offer(target, (cost + 3, audit + "R", [*out, (name, text)]))
        best = table
    return min(v for shape, v in inserted(best).items() if shape in (0, 3))


def plain(rows, damage=True):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], [])
    for conv, turn, role, text in damaged(rows) if damage else rows:
        groups[conv].append((turn, *(" " if v is None else v for v in (role, text))))
    out = []
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds = faults(turns)
        dates = [t for t, _, _ in turns if t is not None]
        gaps = max(dates) - min(dates) + 1 - len(set(dates)) if dates else 0
        initials = [role[:1] for _, role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, fixed = cheapest(turns, kinds)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
                    illegal, cost, audit, digest))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def reports(df, **options):
    return conversation_reports(repaired_conversations(df, **options))


SCHEMA = "conv_id long, turn long, role string, text string"


def made(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "a", "u", "student"]
    texts = ["One.", "Two!", "three", "", " \n", "Four? ", "five\x0b", "\x1c", "é.", "One."]
    rows = []
    for conv in range(convs):
        for i in range(rng.randint(1, most)):
            turn = None if rng.random() < 0.05 else i + rng.randint(-1, 2)
            rows.append((conv, turn, rng.choice(roles), f"{rng.choice(texts)}" if rng.random() < 0.6 else f"t{i}."))
    return rows


def test_query_equals_brute_force(spark):
    from panelwright.llm.queries import PLANS

    sf = "/root/testdata/sf0.1"
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text"))
            for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert rows_of(PLANS["op13_conversation_repair"](spark, sf)) == plain(rows)


@pytest.mark.parametrize("long_rows,piece_rows", [(4096, 4096), (6, 2), (2, 3), (1, 1)])
def test_pieces_give_the_same_repair(spark, monkeypatch, long_rows, piece_rows):
    monkeypatch.setattr(repair, "LONG_ROWS", long_rows)
    monkeypatch.setattr(repair, "PIECE_ROWS", piece_rows)
    rows = made(7, 60, 14)
    rows += [(1000, 5, "user", "same.")] * 40 + [(1001, i // 3, "user", "same") for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(reports(df)) == plain(rows, damage=False)


def test_all_edit_sequences_of_small_conversations():
    """Every sequence of edits, tried one by one, gives nothing cheaper or smaller."""
    pattern = re.compile(r"(s?(ua)+)?")
    for roles in product("sua", repeat=3):
        rows = [(i, {"s": "system", "u": "user", "a": "assistant"}[r], f"x{i}." if i else "y") for i, r in enumerate(roles)]
        kinds = faults(rows)
        best = (1 << 60, "")
        for gaps in product(["", "u", "a", "ua", "au"], repeat=4):
            for edits in product("KDua", repeat=3):
                shown, audit, cost = gaps[0], "I" * len(gaps[0]), 3 * sum(map(len, gaps))
                for role, kind, edit, gap in zip(roles, kinds, edits, gaps[1:]):
                    shown += {"K": role, "D": ""}.get(edit, edit)
                    cost += {"K": 0, "D": 4}.get(edit, 3) + 3 * (kind == "truncated" and edit != "D")
                    audit += (edit if edit in "KD" else "R") + "I" * len(gap)
                    shown += gap
                if pattern.fullmatch(shown):
                    best = min(best, (cost, audit))
        search = repair._Open("k")
        for turn, role, text in rows:
            search.row(turn, role, text)
        found = search.close()
        assert (found["cost"], found["audit"]) == best


def test_decided_steps_leave_the_tree():
    search, undecided, most = repair.Survivors(), 0, 0
    for i in range(5000):
        decided = search.advance(repair.row_moves("ua"[i % 2], False))
        undecided += 1 - len(decided)
        most = max(most, undecided)
    assert most < 10


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a."), (None, None, None, None), (1, None, None, "x."), (2, 3, "user", None),
            (3, 1, "user", "q."), (3, 1, "user", "q."), (3, 1, "assistant", "w" * 100000 + "."), (4, 9, "system", "s."),
            (5, None, "user", "n."), (5, None, "assistant", "m.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "'x' as piece", "2 as copies", "3 as audit")
    assert rows_of(reports(df)) == plain(rows, damage=False)
    none = reports(df.selectExpr("conv_id", "turn", "role", "text", "0 as n"), copies_column="n")
    empty = hashlib.sha256(b"").hexdigest()
    assert rows_of(none) == sorted(
        [(c, 0, 0, 0, 0, 0, 0, "", empty) for c in (None, 1, 2, 3, 4, 5)], key=str)
    assert reports(df.limit(0)).count() == 0
