"""Hashed character n-grams of whole texts."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngram_codes(text: str, shortest: int, longest: int, bits: int) -> np.ndarray:
    """A code below ``2 ** bits`` for every n-gram of the lower-cased text between two spaces, with repeats."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams = np.zeros(len(points), np.uint64)
    found = []
    for n in range(1, min(longest, len(points)) + 1):
        grams = grams[: len(points) - n + 1] * _STEP + points[n - 1 :] + np.uint64(n)
        if n >= shortest:
            mixed = grams ^ (grams >> np.uint64(31))
            mixed *= _MIX
            found.append(mixed >> np.uint64(64 - bits))
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)
