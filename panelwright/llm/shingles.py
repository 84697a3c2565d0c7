"""Hashes of word runs, shared by the operators that compare texts."""

from __future__ import annotations

import numpy as np
import xxhash


def run_hashes(words: list[bytes], length: int) -> np.ndarray:
    """64-bit hash of each run of ``length`` words, by position; empty if there are fewer."""
    count = len(words) - length + 1
    if count < 1:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    view = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: count - 1].tolist()]
    stops = (ends[length - 1 :] - 1).tolist()
    return np.fromiter((digest(view[i:j]) for i, j in zip(starts, stops)), np.uint64, count)
