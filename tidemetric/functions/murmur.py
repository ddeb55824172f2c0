"""MurmurHash3 x86-32 over string columns, in numpy on whole Arrow batches.

Spark's own ``hash`` has another seed and another tail rule, so it cannot stand in where
buckets must agree with other runtimes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
C1, C2, M5, N5, F1, F2 = 0xCC9E2D51, 0x1B873593, 5, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))


def _scrambled(k: np.ndarray) -> np.ndarray:
    return _rotated(k * np.uint32(C1), 15) * np.uint32(C2)


def murmur3(texts: list[bytes], seed: int = 0) -> np.ndarray:
    """uint32 hash of each byte string; strings of one length are hashed together."""
    lengths = np.array([len(t) for t in texts])
    out = np.zeros(len(texts), np.uint32)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        padded = np.zeros((len(at), -(-n // 4) * 4), np.uint8)
        if n:
            padded[:, :n] = np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(len(at), n)
        blocks = padded.view("<u4")
        h = np.full(len(at), seed, np.uint32)
        for b in range(n // 4):
            h = _rotated(h ^ _scrambled(blocks[:, b]), 13) * np.uint32(M5) + np.uint32(N5)
        if n % 4:
            h ^= _scrambled(blocks[:, n // 4])
        h ^= np.uint32(n)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(F1)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(F2)
        out[at] = h ^ (h >> np.uint32(16))
    return out


def murmur3_of(text: Column) -> Column:
    """Hash of a string column as a long; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        hashed = pd.Series(pd.array([None] * len(texts), "Int64"))
        hashed[known] = murmur3([t.encode() for t in texts[known]]).astype(np.int64)
        return hashed

    return F.pandas_udf(run, "long")(text)


def bucket_of(unit: Column, salt: Column | str, buckets: int) -> Column:
    """Bucket of a unit: hash of ``unit NUL salt`` modulo the number of buckets."""
    if buckets <= 0:
        raise ValueError("there must be a bucket")
    name = F.lit(salt) if isinstance(salt, str) else salt
    return (murmur3_of(F.concat(unit.cast("string"), F.lit("\0"), name)) % buckets).cast("int")
