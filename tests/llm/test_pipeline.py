"""The pipeline against plain Python, stage by stage."""

from __future__ import annotations

import struct

import numpy as np
import test_decontaminate
import test_neardup
import test_quality
import xxhash

import corpus_pipeline
from panelwright.llm.mixing import SEED, inclusion, rake
from panelwright.llm.queries import MIX, SHARDS

SF = "/root/testdata/sf0.01"


def draw(doc_id):
    first = xxhash.xxh64_intdigest(struct.pack("<i", SEED), seed=42)
    return (xxhash.xxh64_intdigest(str(doc_id).encode(), seed=first) >> 11) / 2**53


def topic(text):
    if len(text) < 400:
        return "note"
    if sum("0" <= c <= "9" for c in text) * 20 > len(text):
        return "numbers"
    return "markup" if sum(c in "#*$%&|<>" for c in text) * 20 > len(text) else "prose"


def mixed(rows):
    names = [[*m] for m in (MIX.source, MIX.language, MIX.topic)]
    grid, at = np.zeros([len(n) for n in names]), []
    for _, text, lang, source in rows:
        values = (source, lang, topic(text))
        at.append(tuple(n.index(v if v in n else "*") for n, v in zip(names, values)))
        grid[at[-1]] += len(text.split())
    shares = rake(grid, [np.array([*m.values()]) for m in (MIX.source, MIX.language, MIX.topic)])
    chance = inclusion(grid, shares, MIX.budget)
    return [r for r, i in zip(rows, at) if draw(r[0]) < chance[i]]


def sharded(rows):
    sizes = sorted((r[0], len(r[1].encode()) + 16) for r in rows)
    total, before, out, slots = sum(s for _, s in sizes), 0, [], {}
    for doc_id, size in sizes:
        shard = min(SHARDS - 1, (2 * before + size) * SHARDS // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        out.append((doc_id, size, shard, slots[shard]))
        before += size
    return out


def test_run_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet")
            .select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r[0] for r in test_quality.brute([r[:3] for r in rows]) if r[-1]}
    rows = [r for r in rows if r[0] in good]
    groups = test_neardup.brute([r[:2] for r in rows])
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    dirty = {r[0] for r in test_decontaminate.brute([r[:2] for r in rows], items) if r[-1]}
    rows = [r for r in rows if r[0] not in dirty]
    assert dirty and len(groups) < len(good) + 1
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sharded(mixed(rows))


def test_stages_keep_the_columns_and_odd_rows(spark):
    text = " ".join("word%d is the of and to" % (i * 7 % 50) for i in range(60))
    rows = [(1, text, "en", "src0", 1, "x"), (1, text, "en", "src0", 1, "x"), (None, text, None, None, None, "x"),
            (2, None, "en", "src1", 0, None), (3, "", "de", "src2", 0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "sharding":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
        docs.collect()


def test_near_duplicate_stage_keeps_one_row_of_each_text(spark):
    """Rows that share an id or have none are judged by their own texts."""
    a, b, c = (" ".join(f"{t}{i}" for i in range(80)) for t in "abc")
    near = a.replace("a5 ", "zz ")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (7, c, 4), (7, c, 4), (None, a, 5), (None, "only here", 6),
            (9, near, 7), (None, None, 8), (None, None, 8), (11, None, 9), (12, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert got.columns == ["doc_id", "text", "row"]
    kept = sorted((r.doc_id, r.row) for r in got.where("doc_id is not null").collect())
    assert kept == [(3, 1), (5, 3), (7, 4), (11, 9), (12, 10)]
    assert sorted((r.row for r in got.where("doc_id is null").collect())) == [6, 8]


def test_stages_leave_columns_of_their_own_names_alone(spark):
    text = " ".join("word%d is the of and to" % (i * 7 % 50) for i in range(60))
    rows = [(1, text, "en", "src0", 1, "mine"), (2, text + " more", "en", "src1", 2, "yours")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int, _digest string")
    got = corpus_pipeline.decontamination_stage(spark, docs, SF)
    assert sorted(map(tuple, got.collect())) == rows
