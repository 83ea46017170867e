"""Hashes of words and of runs of words, shared by the operators on shingles."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS_KEPT = 500_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


class Words(dict):
    """The 8-byte hashes of words, each computed when first asked for; emptied when it holds too many."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        got = self[word] = xxhash.xxh64_digest(word.encode("utf-8", "replace"))
        return got

    def hashes(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """The 64-bit hashes of all runs of ``width`` words, in order; of fewer words the hash of the one run."""
    if not len(h):
        return np.empty(0, np.uint64)
    k = min(width, len(h))
    s = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        s = (s ^ (s >> np.uint64(31))) * (_A if i % 2 else _B) + h[i : len(h) - k + 1 + i]
    s ^= s >> np.uint64(29)
    s *= _C
    s ^= s >> np.uint64(32)
    return s
