from __future__ import annotations

import random

import pytest

from panelwright.llm.components import connected_components
from panelwright.llm.neardup import near_duplicates


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> (n_shingles, component) by an inverted index and union-find."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index = {}
    for i, s in sets.items():
        for k in s:
            index.setdefault(k, []).append(i)
    seen = set()
    for members in index.values():
        for at, i in enumerate(members):
            for j in members[:at]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    common = len(sets[i] & sets[j])
                    if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                        a, b = sorted((find(i), find(j)))
                        root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def variants(seed, groups, size):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 % 10007, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_components_as_brute_force(spark, seed):
    rows = variants(seed, 60, 14)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates(df)) == brute(rows)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = ["t%d" % i for i in range(120)]
    rows = []
    for i in range(400):
        text = list(base)
        text[rng.randrange(120)] = "x%d" % i
        rows.append((i, " ".join(text)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found(got) == brute(rows)


def test_odd_rows(spark):
    long = " ".join("v%d" % (i % 911) for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Aa b"), (9, "aA\x0bB"), (5, "aa b c"), (None, "aa b"),
            (7, long), (8, long + " end"), (4, "Aa b"), (6, "É b"), (10, "é b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 as id", "'x' as key", "2 as n", "3 as component"
    )
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True),
         (9, 1, 4, False), (5, 1, 5, True), (None, 1, None, True), (6, 1, 6, True), (10, 1, 10, True),
         (7, 911, 7, True), (8, 912, 7, False)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 50), (7, 3), (None, 2), (100, 50)]
    got = {r.node: r.component for r in connected_components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 100: 50}


def test_query_equals_brute_force(spark):
    from panelwright.llm.queries import PLANS

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = PLANS["op3_near_duplicates"](spark, sf)
    assert found(got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_rows_that_repeat_an_id_join_what_their_texts_link_with(spark):
    a, b = (" ".join(f"{t}{i}" for i in range(60)) for t in "ab")
    rows = [(3, a), (5, a), (5, b), (9, b), (11, "alone here"), (12, None), (12, b), (None, b)]
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted(
        [(3, 3), (5, 3), (5, 3), (9, 3), (11, 11), (12, 12), (12, 3), (None, None)], key=str)


def test_texts_of_one_template_form_no_pairs(spark):
    """Texts that share a frame but not enough of it leave before any pair is formed."""
    frame = ["f%d" % i for i in range(60)]
    rows = [(i, " ".join(frame + [f"own{i}_{k}" for k in range(18)])) for i in range(300)]
    rows += [(i + 1000, t + " tail") for i, t in rows[:20]]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found(got) == brute(rows)
