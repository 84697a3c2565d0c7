from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from panelwright.llm import components as joined
from panelwright.llm import simhash
from panelwright.llm.simhash import block_masks, fingerprint, simhash_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Component of each id by comparing all fingerprints with all others."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def found(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def expected(rows):
    prints = {i: plain_print(t) for i, t in rows}
    return {i: ("%016x" % prints[i], c) for i, c in components(prints).items()}


def test_query_equals_brute_force(spark):
    from panelwright.llm.queries import PLANS

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = PLANS["op11_simhash_duplicates"](spark, sf)
    assert found(got) == expected(rows)


@pytest.mark.parametrize("crowded", [2, 5, 200])
def test_crowded_blocks_give_the_same_components(spark, monkeypatch, crowded):
    rng = random.Random(3)
    base = ["t%d" % i for i in range(70)]
    rows = []
    for i in range(500):
        text = list(base)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(70)] = "x%d" % rng.randrange(9)
        rows.append((i * 7 % 3001, " ".join(text)))
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    got = found(simhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    want = expected(rows)
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < 500


def test_blocks_cover_all_close_pairs():
    masks = [m % (1 << 64) for m in block_masks(3)]
    assert len(masks) == 20 and all(30 <= m.bit_count() <= 33 for m in masks)
    rng = random.Random(1)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(flips & m == 0 for m in masks)


def test_long_text_in_blocks(monkeypatch):
    rng = random.Random(2)
    text = " \n".join("W%d" % rng.randrange(5000) for _ in range(9000)) + "\x1cend"
    whole = fingerprint(text)
    monkeypatch.setattr(simhash, "TEXT_BLOCK", 100)
    assert fingerprint(text) == whole
    assert whole % (1 << 64) == plain_print(text)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Aa b"), (9, "aA\x0bB"), (5, "aa b c"), (None, "aa b"),
            (None, None), (7, "É b"), (8, "é b"), (5, "zz yy"), (6, "ZZ yy"), (5, "zz yy"), (4, "Aa b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 as id", "'x' as print", "2 as key", "3 as rep"
    )
    got = sorted(map(tuple, simhash_duplicates(df).collect()), key=str)
    component = {None: None, 1: 1, 2: 1, 3: 1, 4: 4, 9: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    assert got == sorted([(i, "%016x" % plain_print(t), component[i]) for i, t in rows], key=str)
    assert simhash_duplicates(df.limit(0)).count() == 0
    assert {r.component_id for r in simhash_duplicates(df.where("text is null")).collect()} == {1, None}


def test_nothing_is_broadcast_by_the_size_of_small_files(spark, monkeypatch):
    """A fingerprint of a few bytes grows into twenty keys that the driver need not hold."""
    plans = []

    def seen(df, label, staged=simhash.staged):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, label)

    monkeypatch.setattr(simhash, "staged", seen)
    monkeypatch.setattr(joined, "staged", seen)
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40 + 3))) for i in range(200)]
    out = simhash_duplicates(spark.createDataFrame([*rows, (7, "one more")], "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and sum("Join" in p for p in plans) >= 4
    assert not [p for p in plans if "Broadcast" in p]
