from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelwright.llm import alignment as module
from panelwright.llm.alignment import UNIT, alignment, pack, pack_sorted, unpack, unpack_sorted

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
A_TOKENS = Tokenizer.from_file(A)
A_TOKENS.encode_special_tokens = True
B_TOKENS = sentencepiece.SentencePieceProcessor(model_file=B)


def letter_bytes():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


LETTERS = letter_bytes()


def ranges(parts):
    at = 0
    for part in parts:
        yield at, at + len(part)
        at += len(part)


def plain(rows):
    """All columns by whole-text calls of both libraries, sets of byte ends and dictionaries."""
    facts, links = [], []
    for doc_id, text in rows:
        a = A_TOKENS.encode(" " + text, add_special_tokens=False).ids if text else []
        b = B_TOKENS.encode(text) if text else []
        a_parts = [bytes(LETTERS[c] for c in A_TOKENS.id_to_token(i)) for i in a]
        b_parts = [
            bytes([int(p[3:5], 16)]) if B_TOKENS.is_byte(i) else p.replace("▁", " ").encode()
            for i in b
            for p in [B_TOKENS.id_to_piece(i)]
        ]
        data = (" " + text).encode() if text else b""
        if not data or b"".join(a_parts) != data or b"".join(b_parts) != data:
            facts.append((doc_id, 0, 0, 0, ""))
            links.append([])
            continue
        ra, rb = list(ranges(a_parts)), list(ranges(b_parts))
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        owner = np.searchsorted(cuts, np.arange(1, len(data) + 1))
        ga, gb = defaultdict(list), defaultdict(list)
        for i, (s, e) in zip(a, ra):
            ga[owner[s]].append(str(i))
        for i, (s, e) in zip(b, rb):
            gb[owner[s]].append(str(i))
        text_groups = ";".join(",".join(ga[g]) + "|" + ",".join(gb[g]) for g in range(len(cuts)))
        found, j = [], 0
        for i, (s, e) in zip(b, rb):
            while ra[j][1] <= s:
                j += 1
            k = j
            while k < len(ra) and ra[k][0] < e:
                found.append((i, a[k]))
                k += 1
        facts.append((doc_id, len(a), len(b), len(cuts), hashlib.sha256(text_groups.encode()).hexdigest()))
        links.append(found)
    counts = Counter(p for found in links for p in found)
    high = Counter()
    for (b, _), n in counts.items():
        high[b] = max(high[b], n)
    return [
        (i, n_a, n_b, n_groups, len(found), sum(counts[p] == high[p[0]] for p in found),
         sum(counts[p] for p in found), digest)
        for (i, n_a, n_b, n_groups, digest), found in zip(facts, links)
    ]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_brute_force(spark):
    from panelwright.llm.queries import PLANS

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = PLANS["op12_tokenizer_alignment"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == sorted(plain(rows), key=str)


def odd_texts():
    rng = random.Random(4)
    marks = ["a", "B", "é", " ", "  ", "\n", "\t ", " ", "　", "\x1c", " ", "'s", "12", "…", "漢", "\U0001f600",
             "<|endoftext|>", "</s>", "<0x41>", "\x00", "\r\n", "word", "The", "​"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return [*texts, "a▁b", "▁", " ", "   ", "x ", " x", "x  \n  y", "  \n", None, "", "x" * 5000, "é" * 3000]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:  # many runs, many lists of units, several groups of runs
        for name, value in {"RUN_LINKS": 50, "RUN_RECORDS": 40, "QUEUED_UNITS": 7, "RUNS_MERGED": 3,
                            "STORED_UNITS": 20, "JOINED_UNITS": 3}.items():
            monkeypatch.setattr(module, name, value)
    rows = [(i % 290, t) for i, t in enumerate(odd_texts())] + [(None, "word word"), (None, None), (3, "The word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 as run", "'x' as radix", "2 as pair", "3 as n_a"
    )
    assert rows_of(alignment(df.repartition(3), A, B)) == sorted(plain(rows), key=str)
    assert alignment(df.limit(0), A, B).count() == 0


def test_units_keep_the_tokens():
    for text in odd_texts():
        if text:
            line = " " + text
            units = UNIT.findall(line)
            assert "".join(units) == line
            whole = A_TOKENS.encode(line, add_special_tokens=False).ids
            assert [i for u in units for i in A_TOKENS.encode(u, add_special_tokens=False).ids] == whole
            assert [i for u in units for i in B_TOKENS.encode(u[1:])] == B_TOKENS.encode(text)


def test_packing_is_reversible():
    values = np.array([0, 5, 5, 1 << 50, (1 << 50) + 3], np.int64)
    assert (unpack_sorted(pack_sorted(values)) == values).all()
    assert (unpack(pack(values[::-1])) == values[::-1]).all()
    assert len(unpack(pack(np.empty(0, np.int64)))) == 0
