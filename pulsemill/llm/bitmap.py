"""A bitmap of 64-bit hashes of fixed size: a filter without false negatives, whatever it holds."""

import numpy as np
from pyspark.sql import DataFrame, functions as F

# 2^BITS bits (2 MB), in words of 2^SLOT bits.
BITS = 24
SLOT = 6


def bitmap(hashes: DataFrame, column: str):
    """Broadcast bitmap of a bigint column; the driver gets 2^(BITS - SLOT) words at most."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - BITS}) & {(1 << SLOT) - 1} AS int))")
    slot = F.shiftrightunsigned(column, 64 - BITS + SLOT)
    out = np.zeros(1 << (BITS - SLOT), np.uint64)
    for at, bits in hashes.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).collect():
        out[at] = bits % (1 << 64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def in_bitmap(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes may be held."""
    place = h >> np.uint64(64 - BITS)
    return ((words[place >> np.uint64(SLOT)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
