"""Validity of whole features: odd rows, and random boxes against a plain check of cells."""

from __future__ import annotations

import random

from panelwright.operators import geo as G

SCHEMA = "id int, parts array<array<array<struct<x:double,y:double>>>>"


def box(x, y, w, h):
    return [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]


def test_odd_features(spark):
    square = box(0, 0, 8, 8)
    rows = [(1, None), (2, []), (3, [[]]), (4, [[square], []]), (5, [[square[:-1]]]), (6, [[square, box(1, 1, 0, 3)]]),
            (7, [[square]]), (None, [[square, box(9, 9, 1, 1)]]), (8, [[square, None]]), (9, [None])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.problem for r in G.multipolygon_problems(df, "id", "parts").collect()}
    assert got.pop(1) == "null_geometry" and got.pop(None) == "hole_outside"
    assert {got.pop(i) for i in (2, 3, 4, 9)} == {"empty_geometry"}
    assert got.pop(5) == "open_ring" and got.pop(6) == "zero_area"
    got.pop(8, None)
    assert not got
    assert G.multipolygon_problems(df.limit(0), "id", "parts").count() == 0


def cells(b):
    x, y, w, h = b
    return {(i, j) for i in range(x, x + w) for j in range(y, y + h)}


def apart(a, b):
    """Boxes whose outlines share no point."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    return ax + aw < bx or bx + bw < ax or ay + ah < by or by + bh < ay


def strictly_in(a, b):
    return b[0] < a[0] and a[0] + a[2] < b[0] + b[2] and b[1] < a[1] and a[1] + a[3] < b[1] + b[3]


def plain(parts):
    """Problem of parts of boxes whose outlines share no point."""
    for outline, *holes in parts:
        if not all(strictly_in(h, outline) for h in holes):
            return "hole_outside"
    for _, *holes in parts:
        if any(a is not b and strictly_in(a, b) for a in holes for b in holes):
            return "nested_holes"
    areas = [cells(o).difference(*[cells(h) for h in holes]) for o, *holes in parts]
    if any(areas[i] & areas[j] for i in range(len(areas)) for j in range(i)):
        return "overlapping_parts"
    return None


def test_random_boxes_equal_a_plain_check(spark):
    rng = random.Random(6)
    features = []
    while len(features) < 150:
        boxes = [(0, 0, 24, 24)] if rng.random() < 0.7 else []
        for _ in range(rng.randint(1, 12)):
            new = (rng.randrange(12), rng.randrange(12), rng.randint(1, 12), rng.randint(1, 12))
            if all(apart(new, b) or strictly_in(new, b) or strictly_in(b, new) for b in boxes):
                boxes.append(new)
        parts = []
        for b in sorted(boxes, key=lambda b: -b[2] * b[3]):
            homes = [p for p in parts if rng.random() < 0.7 and strictly_in(b, p[0])]
            if homes or (parts and rng.random() < 0.1):
                (homes or parts)[0].append(b)
            else:
                parts.append([b])
        features.append(parts)
    rows = [(i, [[box(*b) for b in part] for part in parts]) for i, parts in enumerate(features)]
    want = {i: plain(parts) for i, parts in enumerate(features)}
    assert {"hole_outside", "nested_holes", "overlapping_parts", None} == set(want.values())
    got = {r.id: r.problem for r in G.multipolygon_problems(
        spark.createDataFrame(rows, SCHEMA), "id", "parts").collect()}
    for i, problem in want.items():
        assert got.get(i) == problem, features[i]
