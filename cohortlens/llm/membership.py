"""A membership filter of bounded size, built by Spark and shipped to tasks that read text.

The filter only spares work: it lets through everything that is in the set and some of what is
not, and every user joins on the real values afterwards. So its size can be capped at
``MAX_BITS`` whatever the set holds; a fuller filter costs time, never rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**28 bits are 32 MB, the most that is ever sent to an executor.
MIN_BITS, MAX_BITS, BITS_PER_KEY, PROBES = 1 << 22, 1 << 28, 32, 3
_BUCKET = 32768


class Membership(NamedTuple):
    """Bit array shared by broadcast; ``probe`` tests a column of 64-bit keys."""

    bits: Broadcast
    size: int

    def probe(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(keys.size, bool)
        packed = self.bits.value
        key = keys.view(np.uint64) if keys.dtype == np.int64 else keys
        for i in range(PROBES):
            alive = np.flatnonzero(found)
            if not alive.size:
                break
            at = ((key[alive] >> np.uint64(17 * i)) % np.uint64(self.size)).astype(np.int64)
            found[alive] = (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def membership(keys: DataFrame, column: str) -> Membership:
    """Filter over the well mixed 64-bit ``column``. Tasks build it, as 4 kB bitmaps per range of bits."""
    spark = keys.sparkSession
    wanted = max(1, keys.count()) * BITS_PER_KEY
    size = MIN_BITS
    while size < min(wanted, MAX_BITS):
        size *= 2
    shifted = F.array(*[F.shiftrightunsigned(F.col(column), 17 * i) for i in range(PROBES)])
    # pmod would see a negative number for the unshifted key; the low bits are the same.
    bit = F.explode(F.transform(shifted, lambda v: v.bitwiseAND(F.lit(size - 1).cast("long"))))
    rows = (
        keys.select(bit.alias("bit"))
        .groupBy((F.col("bit") / _BUCKET).cast("long").alias("bucket"))
        .agg(F.bitmap_construct_agg((F.col("bit") % _BUCKET)).alias("bitmap"))
        .collect()
    )
    packed = np.zeros(size // 8, np.uint8)
    for r in rows:
        at = r["bucket"] * (_BUCKET // 8)
        packed[at : at + _BUCKET // 8] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    return Membership(spark.sparkContext.broadcast(packed), size)
