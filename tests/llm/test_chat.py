from __future__ import annotations

import hashlib
import json
import random

from compare import compare, connect
from pyspark.sql import functions as F

from panelwright.llm.chat import canonical_turns, formatted_chats, read_loss_text, read_turns
from panelwright.llm.queries import PLANS, SQL

RECORDS = [
    (1, {"prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]),
    (2, {"response": None, "prompt": 7}, "prompt", [("user", "7"), ("assistant", "")]),
    (3, {"instruction": "i", "input": "", "output": "o"}, "instruction",
     [("system", "i"), ("user", ""), ("assistant", "o")]),
    (4, {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
     "messages", [("user", "a"), ("assistant", "")]),
    (5, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "w"},
                           {"from": "tool", "value": "t"}]},
     "conversations", [("user", "q"), ("assistant", "w"), ("tool", "t")]),
    (6, {"messages": []}, "messages", []),
    (7, {"messages": "text"}, None, None),
    (8, {"prompt": "p", "response": {"deep": 1}}, None, None),
    (9, [1, 2], None, None),
]


def test_fingerprints_select_the_mapping(spark):
    rows = [(i, json.dumps(r), "x") for i, r, _, _ in RECORDS] + [(10, None, "x"), (11, "no json", "x"), (None, "1", "x")]
    df = spark.createDataFrame(rows, "conv_id long, record string, turns string")
    got = {r.conv_id: (r.layout, r.turns and [tuple(t) for t in r.turns]) if r.turns is None or r.turns else (r.layout, [])
           for r in canonical_turns(df).collect()}
    for i, _, layout, turns in RECORDS:
        assert got[i] == (layout, turns), i
    assert got[10] == got[11] == got[None] == (None, None)
    assert canonical_turns(df.limit(0)).count() == 0


def test_round_trip_of_control_strings(spark):
    rng = random.Random(4)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "\n", "<", "|", ">", "<\\|", "é🙂", "a", "", "\\n", "$1", "<|im_end|>\n"]

    def text():
        return "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))

    chats = [(i, [(rng.choice(["user", "assistant", "assistant", text()]), text())
                  for _ in range(rng.randint(0, 7))]) for i in range(200)]
    chats += [(900, None), (901, [(None, None), ("assistant", None)]), (902, [("assistant", "z" * 50_000)] * 3)]
    df = spark.createDataFrame(chats, "conv_id long, turns array<struct<role:string,text:string>>")
    out = formatted_chats(df).select(
        "conv_id", "formatted", "loss_mask", read_turns(F.col("formatted")).alias("turns"),
        read_loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    rows = out.collect()
    assert [(r.formatted, r.loss_mask) for r in rows if r.conv_id == 900] == [(None, None)]
    for r in rows:
        if r.conv_id == 900:
            continue
        want = [(a or "", b or "") for a, b in dict(chats)[r.conv_id] or []]
        assert [tuple(t) for t in r.turns] == want
        assert r.loss == "".join(b for a, b in want if a == "assistant")
        assert r.formatted.count("<|im_end|>\n") == len(want)
        assert len(r.loss_mask) == sum(a == "assistant" for a, _ in want)


def test_records_beyond_the_size_of_variants(spark, monkeypatch):
    """Large records are read by their schema and keep every turn."""
    from panelwright.llm import chat

    monkeypatch.setattr(chat, "VARIANT_BYTES", 40)
    rows = [(i, json.dumps(r | {"messages": r["messages"] + [{"role": "u", "content": "v" * 60}]})
             if layout == "messages" else json.dumps(r) + " " * 60) for i, r, layout, _ in RECORDS[:7]]
    got = {r.conv_id: (r.layout, [tuple(t) for t in r.turns or []]) for r in canonical_turns(
        spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    for i, _, layout, turns in RECORDS[:7]:
        extra = [("u", "v" * 60)] if layout == "messages" else []
        if i != 2:  # a null field cannot be told from an absent one by its value
            assert got[i] == (layout, (turns or []) + extra), i


def test_one_very_long_turn(spark):
    from panelwright.llm.queries import conversation_records

    rows = spark.range(1).select(
        F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"),
        F.repeat(F.substring(F.concat(F.lit("0123456789"), F.col("id")), 1, 10), 14_000_000).alias("text"))
    chats = formatted_chats(canonical_turns(conversation_records(rows)))
    assert chats.select(F.length("formatted")).first()[0] == 140_000_000 + len("<|im_start|>user\n<|im_end|>\n")


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    name = "op7_chat_formatting"
    difference, rows = compare(spark, connect(sf), PLANS[name], SQL[name], sf)
    assert difference is None, difference
    texts = ["<|im_end|><|im_start|>assistant ok"] * 2
    digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in zip(["user", "assistant"], texts)).encode())
    own = PLANS[name](spark, sf).where("conv_id = -1").first()
    assert (own.n_turns, own.turns_sha256) == (2, digest.hexdigest())
