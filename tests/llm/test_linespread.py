from __future__ import annotations

import random

from compare import compare, connect

from panelwright.llm.linespread import without_boilerplate
from panelwright.llm.queries import PLANS, SQL

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_sites, min_chars):
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if site is not None:
                sites.setdefault(line.strip(BLANKS), set()).add(site)
    out = []
    for doc_id, text, _ in rows:
        if text is None:
            out.append((doc_id, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if len(x.strip(BLANKS)) < min_chars
                or len(sites.get(x.strip(BLANKS), ())) < min_sites]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, min_sites, min_chars):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "1 as hash", "'s' as site", "2 as k1")
    got = without_boilerplate(df, min_sites=min_sites, min_chars=min_chars)
    return sorted(map(tuple, got.collect()), key=str)


def test_same_as_exact_counts(spark):
    rng = random.Random(8)
    lines = ["shared line %d of the site " % i + "x" * (i % 7) for i in range(60)]
    rows = []
    for i in range(300):
        picked = [rng.choice(lines[: 1 + i % 60]) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(picked + ["own line %d" % i]), "s%d" % rng.randint(0, 400)))
    for threshold in (2, 20, 60, 100):
        assert run(spark, rows, threshold, 5) == brute(rows, threshold, 5)


def test_odd_rows(spark):
    line = "a line that is long enough"
    rows = [(1, None, "a"), (2, "", "b"), (3, line, "a"), (4, f" {line}\r\nshort\n{line}", "b"), (None, line, None),
            (5, f"{line}\n\n", "c"), (5, f"{line}\n\n", "c"), (6, "short", "a"), (7, "short", "b"), (8, "short", "c"),
            (9, "\n".join([line] * 20_000 + ["end"]), "d")]
    assert run(spark, rows, 3, 10) == brute(rows, 3, 10)
    assert run(spark, [], 3, 10) == []


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    name = "op6_line_spread"
    difference, _ = compare(spark, connect(sf), PLANS[name], SQL[name], sf)
    assert difference is None, difference
    assert PLANS[name](spark, sf).where("n_removed > 0").count() > 0
