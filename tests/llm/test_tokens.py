from __future__ import annotations

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelwright.llm.tokens import TokenCounter, merged_length, read_merges, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = TokenCounter(open(PATH, encoding="utf-8").read())


def expected(text: str) -> int:
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_counts_as_in_the_library(text):
    assert COUNTER(text) == expected(text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "it's  \n\n we'll x", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>",
     "<|endoftext|", "x" * 5000, "ab" * 3000, "՘౜ 1՘", "日本語テキスト", "🙂" * 40, "ß" * 999,
     " \t\x0b\x1c\x85​", "0123456789" * 50],
)
def test_edge_texts(text):
    assert COUNTER(text) == expected(text)


def test_plain_merging_gives_the_same_length():
    ranks, _ = read_merges(open(PATH, encoding="utf-8").read())

    def plain(piece):
        symbols = list(piece)
        while True:
            found = [(ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
                     if (a << 32 | b) in ranks]
            if not found:
                return len(symbols)
            rank, i = min(found)
            symbols[i : i + 2] = [256 + rank]

    rng = random.Random(3)
    for _ in range(400):
        piece = bytes(rng.choice(b"aehinrst t") for _ in range(rng.randint(0, 40)))
        assert merged_length(piece, ranks) == plain(piece)


def test_other_file_kinds_are_refused():
    with pytest.raises(ValueError):
        read_merges(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_operator_on_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, "a b", 7), (None, "a b", 7), (1, "a b", 7), (2, None, None), (3, "w " * 2000, 1)],
        "doc_id long, text string, n_tokens int",
    )
    got = sorted(token_counts(rows, PATH).collect(), key=str)
    assert [r.n_tokens for r in got if r.doc_id == 1] == [2, 2]
    assert [tuple(r) for r in got if r.doc_id == 2] == [(2, 0, 0, False)]
    assert [r.n_tokens for r in got if r.doc_id is None] == [2]
    assert [(r.n_tokens, r.over_limit) for r in got if r.doc_id == 3] == [(expected("w " * 2000), True)]
    assert token_counts(rows.limit(0), PATH).count() == 0


def test_query_counts_every_document(spark):
    from panelwright.llm.queries import PLANS

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = PLANS["op9_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.n_bytes) == (expected(texts[r.doc_id]), len(texts[r.doc_id].encode()))
