from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from panelwright.llm.shards import balanced_shards, text_size


def place(df, n, **more):
    return [r.asDict() for r in balanced_shards(df, n, text_size(F.col("text")), **more).collect()]


def check(rows, n, sizes):
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    target, most = sum(sizes) / n, max(sizes)
    for k in range(n):
        own = [r for r in rows if r["shard"] == k]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - target) <= most
    assert all(0 <= r["shard"] < n for r in rows)


def test_shards_are_contiguous_and_near_equal(spark):
    texts = [(i, "x" * (i * 37 % 211)) for i in range(500)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    rows = place(df, 8)
    check(rows, 8, [len(t) + 16 for _, t in texts])
    ordered = sorted(rows, key=lambda r: r["doc_id"])
    assert [r["shard"] for r in ordered] == sorted(r["shard"] for r in ordered)


def test_odd_rows(spark):
    rows = [(None, "a"), (None, None), (1, "é"), (1, "é"), (2, "y" * 5000)] + [(5, "same")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "0 as _part", "1 as shard", "'z' as slot"
    )
    sizes = [len((t or "").encode()) + 16 for _, t in rows]
    check(place(df, 6), 6, sizes)
    assert place(df.limit(0), 6) == []
    one = place(df, 1)
    assert {r["shard"] for r in one} == {0}


def test_query_keeps_the_contract(spark):
    from panelwright.llm.queries import PLANS

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r.asDict() for r in PLANS["op8_sharding"](spark, sf).collect()]
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    check(rows, 40, [len(t.encode()) + 16 for t in texts.values()])
    for r in rows:
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None
