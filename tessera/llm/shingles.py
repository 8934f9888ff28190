"""Word hashes and word shingles of a text, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive items (empty, if fewer): polynomial in doubling steps,
    O(n log k)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    base, part, width, out, done = int(_MIX), h, 1, None, 0
    n = len(h) - k + 1
    while True:
        if k & width:
            piece = part[done:done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(base, width, 1 << 64)) + piece
            done += width
        if done == k:
            return mixed(out)
        part = part[:len(part) - width] * np.uint64(pow(base, width, 1 << 64)) + part[width:]
        width *= 2


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a text, A-Z in lower case; with fewer
    words, of the whole sequence; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()   # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(word_hashes(words), min(k, len(words))))
