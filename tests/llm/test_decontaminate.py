from __future__ import annotations

import hashlib
import random
import re

from panelwright.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item_id, item in items:
        v = words(item)
        size = min(13, len(v))
        for k in range(len(v) - size + 1 if size else 0):
            windows.setdefault(tuple(v[k : k + size]), set()).add("" if item_id is None else str(item_id))
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                owners = windows.get(tuple(w[i : i + size]))
                if owners:
                    hit |= set(range(i, i + size))
                    found |= owners
        names = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items):
    got = contamination(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "'a' as hits"),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id"),
    )
    return sorted(map(tuple, got.collect()), key=str)


def test_same_as_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["a", "b", "c", "dé", "E", "f1"] + ["w%d" % i for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 8, 13, 14, 30]))))
             for i in range(25)]
    docs = []
    for i in range(80):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if i % 2:
            item = rng.choice(items)[1].split()
            at = rng.randint(0, len(parts))
            parts[at:at] = item[: rng.randint(1, len(item))]
        docs.append((i, rng.choice([" ", "-", ".\n"]).join(parts)))
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = [(1, item), (1, item), (2, None), (3, ""), (None, "Zebra crossing"), (10, item.upper())]
    docs = [(1, None), (2, ""), (None, item), (3, "x " * 300 + item), (3, "x " * 300 + item),
            (4, "zebra-CROSSING"), (5, item + " " + item), (6, "!!!"), (7, "word " * 50000 + item)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []
