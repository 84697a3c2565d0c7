"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

# Fixed value: the published split pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Below this code point the character classes of all Unicode versions in use agree.
STABLE_BELOW = "԰"
CACHED_PIECES = 400_000  # pieces a worker remembers before it starts afresh
CACHED_BYTES = 48  # longer pieces are merged each time
LONG_TEXT = 1 << 20  # characters; longer texts are split lazily
POSITION = (1 << 32) - 1


def _byte_of_letter() -> dict[str, int]:
    """Byte of each letter of the byte-level alphabet: printable Latin-1 characters stand
    for themselves, the other bytes for the code points from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_merges(text: str) -> tuple[dict[int, int], list[str]]:
    """(rank of each pair, special strings) of a byte-level tokenizer file.

    A symbol is a byte or 256 + the rank of the merge that made it; the key of a pair is
    ``left << 32 | right``. Files with other normalizers or splitters are refused, because
    this module could not give the counts of their library.
    """
    spec = json.loads(text)
    splitter = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    if (
        spec.get("normalizer") is not None
        or splitter.get("type") != "ByteLevel"
        or splitter.get("add_prefix_space")
        or not splitter.get("use_regex", True)
        or model.get("ignore_merges")
        or model.get("dropout")
        or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    ):
        raise ValueError("only plain byte-level BPE files can be counted")
    letters = _byte_of_letter()
    symbols = {letter: byte for letter, byte in letters.items()}
    ranks = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks[symbols[left] << 32 | symbols[right]] = rank
        symbols.setdefault(left + right, 256 + rank)
    return ranks, [t["content"] for t in spec["added_tokens"]]


def merged_length(piece: bytes, ranks: dict[int, int]) -> int:
    """Symbols left in ``piece`` after all merges: initial symbols minus merges.

    Adjacent pairs wait in a heap, lowest rank first and leftmost among equal ranks; the
    symbols form a doubly linked list. Entries whose pair has changed meanwhile are
    skipped. No identifiers of the vocabulary are looked up.
    """
    count = len(piece)
    if count < 2:
        return count
    end = count
    symbol = list(piece)
    after = list(range(1, end + 1))
    before = list(range(-1, end - 1))
    heap = []
    for i in range(end - 1):
        rank = ranks.get(symbol[i] << 32 | symbol[i + 1])
        if rank is not None:
            heap.append(rank << 32 | i)
    heapify(heap)
    while heap:
        entry = heappop(heap)
        rank, i = entry >> 32, entry & POSITION
        j = after[i]
        if j == end or symbol[i] < 0 or ranks.get(symbol[i] << 32 | symbol[j]) != rank:
            continue
        symbol[i], symbol[j] = 256 + rank, -1
        k = after[i] = after[j]
        count -= 1
        if k < end:
            before[k] = i
            following = ranks.get(symbol[i] << 32 | symbol[k])
            if following is not None:
                heappush(heap, following << 32 | i)
        h = before[i]
        if h >= 0:
            leading = ranks.get(symbol[h] << 32 | symbol[i])
            if leading is not None:
                heappush(heap, leading << 32 | h)
    return count


class _Pieces(dict):
    """Token count of each piece met so far; a worker's bounded memory."""

    def __init__(self, ranks: dict[int, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        data = piece.encode()
        count = merged_length(data, self.ranks)
        if len(data) <= CACHED_BYTES:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = count
        return count


class TokenCounter:
    """Counts tokens of whole texts as the tokenizer library gives them by default."""

    def __init__(self, file_text: str):
        ranks, self.special = read_merges(file_text)
        self.pieces = _Pieces(ranks)
        self.split = regex.compile(SPLIT)
        self.unstable = regex.compile(f"[{STABLE_BELOW}-\U0010ffff]")
        self.specials = (
            regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
            if self.special
            else None
        )
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def _plain(self, text: str) -> int:
        known = self.pieces.__getitem__
        if self.unstable.search(text):  # classes of newer letters: as the library has them
            spans = self.library.pre_tokenize_str(text)
            return sum(known(text[a:b]) for _, (a, b) in spans)
        if len(text) > LONG_TEXT:
            return sum(known(m.group()) for m in self.split.finditer(text))
        return sum(map(known, self.split.findall(text)))

    def __call__(self, text: str) -> int:
        if self.specials is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_counters: dict[int, TokenCounter] = {}  # of a Python worker, by digest of the file


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Bytes and tokens of every whole text, with a flag for texts over ``limit`` tokens.

    Rows are independent: one narrow Arrow map, no shuffle. The driver reads the tokenizer
    file once and sends its text (bounded by the vocabulary) to the executors; each worker
    remembers the counts of frequent pieces. Special strings inside a text are one token
    each, as the library has it by default. Result: the id column, ``n_bytes``,
    ``n_tokens``, ``over_limit``; other columns are ignored, so their names cannot clash.
    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows
    are counted each; an empty table gives an empty result.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(id_column, text_column)
    id_field = rows.schema.fields[0]
    schema = f"`{id_column}` {id_field.dataType.simpleString()}, n_bytes long, n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_text = shipped.value
        key = xxhash.xxh3_64_intdigest(file_text)
        counter = _counters.get(key)
        if counter is None:
            _counters.clear()
            counter = _counters[key] = TokenCounter(file_text)
        for batch in batches:
            sizes, tokens = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(counter(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                names=[id_column, "n_bytes", "n_tokens"],
            )

    counted = rows.mapInArrow(count, schema)
    return counted.withColumn("over_limit", counted["n_tokens"] > limit)
