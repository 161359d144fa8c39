"""Bit filters of bounded size: what tasks may know of a set of any size.

A filter only spares rows that a later join would drop, so a saturated one costs
time and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, MOST_BITS = 22, 26


def bits_for(count: int) -> int:
    """Size of a filter that is an eighth full at most, if that is within bounds."""
    return min(MOST_BITS, max(BITS, (8 * count - 1).bit_length()))


def bit_filter(df: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Bits of the low ends of all numbers in ``column``, gathered by Spark in words of 64;
    at most ``2**bits / 64`` rows reach the driver."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = df.select(
        F.shiftright(slot, 6).cast("int").alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
        .alias("bit"),
    ).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    packed = np.zeros(1 << (bits - 6), dtype=np.int64)
    packed[words["word"].to_numpy()] = words["bits"].to_numpy()
    return packed.view(np.uint64)


def tester(packed: np.ndarray):
    mask, low = np.uint64(64 * len(packed) - 1), np.uint64(63)

    def test(hashes: np.ndarray) -> np.ndarray:
        slot = hashes & mask
        return (packed[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & low)) & np.uint64(1) != 0

    return test
