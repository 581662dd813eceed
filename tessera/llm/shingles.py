"""Word shingles as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5
CACHE_WORDS = 60_000
_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_words: dict[bytes, int] = {}


def forget() -> None:
    _words.clear()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    known = _words
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; with fewer words the whole sequence is one, without words none."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(size, len(h))
    n = len(h) - width + 1
    total = h[:n] * _MULTIPLIERS[0]
    for j in range(1, width):
        total = mix(total) + h[j : j + n] * _MULTIPLIERS[j]
    return np.unique(mix(total + np.uint64(width)))
