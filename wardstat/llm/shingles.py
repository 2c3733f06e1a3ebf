"""Vectorised hashes of words and of five-word shingles (numpy)."""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)    # fixed value: the odd fraction of the golden ratio
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd number modulo 2**64, and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            ones = np.ones(size, np.uint64)
            self.up, self.down = ones.copy(), ones.copy()
            self.up[1:], self.down[1:] = _ODD, self.inverse
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)
        return self.up[:n], self.down


_powers = _Powers()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word (run of characters between ASCII blanks) of the
    lower-cased text."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    inner = ~_BLANK[b]
    edge = np.flatnonzero(np.diff(inner.astype(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers.of(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def shingle_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hash of each run of ``size`` words, in text order; fewer words make
    one shingle, no word none."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h = h * _ODD + words[k:n - size + 1 + k]
    return mix(h + np.uint64(size))


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Each shingle hashed with its occurrence number in the text, so that all
    are different."""
    if len(shingles) < 2:
        return shingles
    order = np.argsort(shingles, kind="stable")
    same = np.concatenate([[False], shingles[order][1:] == shingles[order][:-1]])
    if not same.any():
        return shingles
    run = np.arange(len(same))
    first = np.maximum.accumulate(np.where(same, 0, run))
    out = np.empty_like(shingles)
    number = (run - first).astype(np.uint64)
    out[order] = np.where(number > 0, mix(shingles[order] + number * _ODD), shingles[order])
    return out
