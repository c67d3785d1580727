"""Vectorised words and windows of blocks of texts.

Words are runs of bytes other than space and 0x09-0x0D, which is what bytes.split() gives. A block's words
are hashed to 64 bits each in NumPy; windows of k words get hashes of their words' hashes by doubling.
"""

from __future__ import annotations

import numpy as np

P1, Q1 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
P2, Q2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(words: list[bytes], p: np.uint64 = P1, step: int = 100_000) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, mixed with its length. Takes step words at a time."""
    if len(words) > step:
        return np.concatenate([word_hashes(words[k : k + step], p) for k in range(0, len(words), step)])
    if not words:
        return np.empty(0, np.uint64)
    blob = b" ".join(words)
    b = np.frombuffer(blob, np.uint8)
    gaps = np.flatnonzero(b == 32)
    starts = np.concatenate(([0], gaps + 1))
    lengths = np.diff(np.concatenate((starts, [len(b) + 1]))) - 1
    powers = np.cumprod(np.full(int(lengths.max()) + 1, p))
    at = np.arange(len(b)) - np.repeat(starts, lengths + 1)[: len(b)]
    value = powers[at]
    value *= b
    value[gaps] = 0
    return mixed(np.add.reduceat(value, starts) + lengths.astype(np.uint64) * p)


def windows(h: np.ndarray, k: int, q: np.uint64 = Q1) -> np.ndarray:
    """Hashes of all windows of k consecutive words (len(h) - k + 1 of them, none if there are fewer words)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, size, step, width, power = None, 0, h, 1, q
    while True:
        if k & width:  # these words go before what there is
            if out is None:
                out = step
            else:
                m = min(len(step), len(out) - width)
                out = step[:m] * q_power(q, size) + out[width : width + m]
            size += width
        width *= 2
        if width > k:
            return mixed(out[:n].copy())
        step = step[: len(step) - width // 2] * power + step[width // 2 :]
        power = q_power(power, 2)


def q_power(q: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(q), n, 1 << 64))


def block_windows(counts: np.ndarray, k: int) -> np.ndarray:
    """Of documents with these word counts, laid end to end: the starts of windows that lie in one document."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    if total < k:
        return np.empty(0, np.int64)
    inside = np.ones(total, bool)
    for back in range(1, k):
        bad = ends - back
        inside[bad[(bad >= ends - counts)]] = False
    return np.flatnonzero(inside)
