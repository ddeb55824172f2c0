"""A Bloom filter of 64-bit hashes: built in Spark, of bounded size, for pre-filters inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25
BITS_A_HASH = 48
#: Probes are runs of the hash's own bits, from these places on.
PROBES = (0, 19, 38)


def bit_table(hashes: DataFrame, column: str, count: int) -> np.ndarray:
    """uint64 words with a bit set at every probe of every hash; ``MOST_BITS`` at most.

    Words are merged by ``bit_or`` in Spark, so no more than the table reaches the driver.
    A full table only lets more through.
    """
    bits = LEAST_BITS
    while bits < min(BITS_A_HASH * count, MOST_BITS):
        bits *= 2
    at = F.explode(F.array(*[F.shiftrightunsigned(F.col(column), p).bitwiseAND(F.lit(bits - 1)) for p in PROBES])).alias("at")
    words = hashes.select(at).select(F.shiftright("at", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    out = np.zeros(bits // 64, np.int64)
    merged = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # a row for each word of the table at most
    out[merged["word"].to_numpy()] = merged["bits"].to_numpy()
    return out.view(np.uint64)


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the table may hold each hash (always true for those put in)."""
    hashes = hashes.view(np.uint64)
    out = np.ones(len(hashes), bool)
    for p in PROBES:
        at = (hashes >> np.uint64(p)) & np.uint64(len(bits) * 64 - 1)
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return out
