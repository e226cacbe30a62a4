"""A set of 64-bit keys in a bit array of bounded size, which may also say yes to keys that are not in it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MiB at most. With more than 8 million keys the filter lets more through; results do not depend on it.
MOST_BITS = 1 << 27
BITS_PER_KEY = 16


class Bloom:
    """One bit per key: a share of at most 1/BITS_PER_KEY of other keys passes, below the bound."""

    def __init__(self, bits: int):
        self.mask = bits - 1
        self.bytes = np.zeros(bits // 8, dtype=np.uint8)

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Bloom:
        """Bits are put together on the executors; the driver gets at most one row for each eight bits."""
        wanted, bits = df.count() * BITS_PER_KEY, 1 << 13
        while bits < min(wanted, MOST_BITS):
            bits *= 2
        bloom = cls(bits)
        bit = F.col(column).bitwiseAND(bits - 1)
        rows = df.groupBy(F.shiftright(bit, 3).cast("int").alias("at")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(7).cast("int"))).cast("short").alias("byte")
        )
        table = rows.toArrow()
        bloom.bytes[table["at"].to_numpy()] = table["byte"].to_numpy().astype(np.uint8)
        return bloom

    def has(self, key: int) -> bool:
        bit = key & self.mask
        return bool(self.bytes[bit >> 3] >> (bit & 7) & 1)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """`has` for an array of 64-bit keys."""
        bit = keys.astype(np.int64, copy=False) & self.mask
        return (self.bytes[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
