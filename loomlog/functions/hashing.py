"""Seeded hashes that Spark has no exact function for, vectorised over Arrow batches.

MurmurHash3 (x86, 32 bits; x64, the first 64 of 128 bits) is computed column-wise in NumPy, a step for each block of the
longest key of a batch; xxHash by its own library.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def laid_out(keys: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys' bytes in rows, filled with zeros to a multiple of width, and their lengths."""
    sizes = np.array([len(k) for k in keys], np.int64)
    columns = max(1, -(-int(sizes.max(initial=0)) // width)) * width
    return np.frombuffer(b"".join(k.ljust(columns, b"\0") for k in keys), np.uint8).reshape(len(keys), columns), sizes


def turned(x: np.ndarray, by: int) -> np.ndarray:
    bits = 8 * x.itemsize
    kind = x.dtype.type
    return x << kind(by) | x >> kind(bits - by)


def murmur3_32(keys: list[bytes], seed: int = 0) -> np.ndarray:
    rows, sizes = laid_out(keys, 4)
    words, c1, c2 = rows.view("<u4"), np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    h = np.full(len(keys), seed, np.uint32)
    for j in range(words.shape[1]):
        k = turned(words[:, j] * c1, 15) * c2
        whole, part = sizes >= 4 * j + 4, (sizes > 4 * j) & (sizes < 4 * j + 4)
        h = np.where(whole, turned(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(part, h ^ k, h))
    h ^= sizes.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    return h ^ h >> np.uint32(16)


def murmur3_64(keys: list[bytes], seed: int = 0) -> np.ndarray:
    rows, sizes = laid_out(keys, 16)
    words, c1, c2 = rows.view("<u8"), np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
    a, b = (np.full(len(keys), seed, np.uint64) for _ in range(2))
    for j in range(words.shape[1] // 2):
        k = turned(words[:, 2 * j] * c1, 31) * c2
        m = turned(words[:, 2 * j + 1] * c2, 33) * c1
        left = sizes - 16 * j
        a1 = (turned(a ^ k, 27) + b) * np.uint64(5) + np.uint64(0x52DCE729)
        b1 = (turned(b ^ m, 31) + a1) * np.uint64(5) + np.uint64(0x38495AB5)
        a, b = np.where(left >= 16, a1, np.where(left > 0, a ^ k, a)), np.where(left >= 16, b1, np.where(left > 8, b ^ m, b))
    a, b = a ^ sizes.astype(np.uint64), b ^ sizes.astype(np.uint64)
    a = a + b
    b = b + a
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        a, b = ((x ^ x >> np.uint64(33)) * np.uint64(factor) for x in (a, b))
    return (a ^ a >> np.uint64(33)) + (b ^ b >> np.uint64(33))


def xxhash_32(keys: list[bytes], seed: int = 0) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(k, seed) for k in keys], np.uint32)


def xxhash_64(keys: list[bytes], seed: int = 0) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], np.uint64)


KINDS = {"murmur3_32": murmur3_32, "murmur3_64": murmur3_64, "xxhash_32": xxhash_32, "xxhash_64": xxhash_64}


def hashed(key: Column, kind: str, seed: int = 0) -> Column:
    """A hash of KINDS of a string or binary column; 64-bit ones as the signed long of the same bits. A null key has none."""
    of = KINDS[kind]

    @F.pandas_udf(LongType())
    def values(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        out = pd.Series(pd.NA, index=keys.index, dtype="Int64")
        if known.any():
            h = of([bytes(k) for k in keys[known]], seed)
            out[known] = h.astype(np.int64) if h.dtype == np.uint32 else h.view(np.int64)
        return out

    return values(key.cast("binary"))
