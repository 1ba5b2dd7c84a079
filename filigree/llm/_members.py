"""Which of many 64-bit numbers may be in a set: a bit table of fixed size, broadcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the table, as a power of 2: 8 MB. A larger set lets more strangers pass; joins drop them afterwards.
BITS = 26


def members(df: DataFrame, column: str):
    """A broadcast table of the numbers in a column of well-mixed longs. The driver sees at most 2**BITS bits."""
    at = F.shiftrightunsigned(column, 64 - BITS)
    pages = df.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).collect()
    table = np.zeros(1 << BITS - 3, np.uint8)
    for page, bits in pages:
        table[page * 4096 : page * 4096 + 4096] = np.frombuffer(bytes(bits), np.uint8)
    return df.sparkSession.sparkContext.broadcast(table)


def may_have(table: np.ndarray, number: int) -> bool:
    slot = (number & 0xFFFFFFFFFFFFFFFF) >> 64 - BITS
    return bool(table[slot >> 3] >> (slot & 7) & 1)


def may_have_each(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """may_have() of each of an array of unsigned 64-bit numbers."""
    slot = numbers >> np.uint64(64 - BITS)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
