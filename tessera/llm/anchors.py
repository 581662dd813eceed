"""Positions in byte strings that equal passages have in common: local minima of a rolling hash.

``anchor_positions`` marks every position whose GRAM-byte hash is the least of some window of SPAN - GRAM + 1
positions. Any two equal strings of SPAN bytes have the same marks at the same offsets, at least one each.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

GRAM = 64
SEGMENT = 1 << 18
_BYTES = np.random.default_rng(6).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache
def _powers(gram: int) -> list[tuple[int, np.uint64]]:
    """Steps of doubling: (length so far, base to that power)."""
    out, n, p = [], 1, 0x9E3779B97F4A7C15
    while n < gram:
        out.append((n, np.uint64(p)))
        p, n = p * p % (1 << 64), 2 * n
    assert n == gram, "a power of two is needed"
    return out


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position on."""
    h = _BYTES[data]
    for n, p in _powers(gram):
        h = h[:-n] * p + h[n:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each window of ``width`` (the result is width - 1 shorter)."""
    n = 1
    while 2 * n <= width:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def anchor_positions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in data) and hashes; data is many texts in a row, text i from starts[i] to ends[i]."""
    windows = span - gram + 1
    if len(data) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, gram)
    low = _sliding(h, windows, np.minimum)
    valid = np.zeros(len(low) + 1, np.int32)
    long = ends - starts >= span
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - span + 1, -1)
    low[np.cumsum(valid[:-1]) == 0] = 0  # windows that cross a text's end
    padded = np.concatenate([np.zeros(windows - 1, np.uint64), low, np.zeros(windows - 1, np.uint64)])
    top = _sliding(padded, windows, np.maximum)
    at = np.nonzero(top == h)[0]
    return at, h[at]


def anchors_of(text: np.ndarray, span: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The same of one text of any length, in segments that overlap."""
    if len(text) <= 2 * SEGMENT:
        return anchor_positions(text, np.array([0]), np.array([len(text)]), span, gram)
    found = []
    for at in range(0, len(text), SEGMENT):
        part = text[at : at + SEGMENT + 2 * span]
        p, h = anchor_positions(part, np.array([0]), np.array([len(part)]), span, gram)
        found.append((p + at, h))
    p, h = (np.concatenate(x) for x in zip(*found, strict=True))
    p, first = np.unique(p, return_index=True)
    return p, h[first]


def neighbours(at: np.ndarray, h: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the nearest one before it whose hash is not larger, and the nearest after it whose hash is
    smaller, within ``reach``; otherwise places beyond reach. Positions that are no anchors cannot come between: the
    window that starts (or ends) at such a position would make it an anchor."""
    n = len(at)
    before, after = at - reach - 1, at + reach + 1
    open_ = np.arange(n)
    for k in range(1, n):
        open_ = open_[open_ >= k]
        open_ = open_[at[open_] - at[open_ - k] <= reach]
        if not len(open_):
            break
        hit = h[open_ - k] <= h[open_]
        before[open_[hit]] = at[open_[hit] - k]
        open_ = open_[~hit]
    open_ = np.arange(n)
    for k in range(1, n):
        open_ = open_[open_ + k < n]
        open_ = open_[at[open_ + k] - at[open_] <= reach]
        if not len(open_):
            break
        hit = h[open_ + k] < h[open_]
        after[open_[hit]] = at[open_[hit] + k]
        open_ = open_[~hit]
    return before, after
