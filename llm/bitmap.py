"""Fixed-size bitmaps of 64-bit values: a pre-filter before a join, never its replacement.

A bitmap has ``2 ** POWER`` bits (2 MB) whatever the input, so it may travel to every task. A value whose bit is
not set is surely absent; others go on to the join, which decides. With more values than bits it only filters less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POWER = 24
_WORD_BITS = 8 * 4096  # bits of one value of bitmap_construct_agg


def bitmap_of(values: DataFrame, column: str) -> bytes:
    """The bitmap of the lowest bits of a column; at most 512 partial maps reach the driver."""
    bit = F.col(column).bitwiseAND(F.lit((1 << POWER) - 1))
    parts = (
        values.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 15).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(_WORD_BITS - 1))).alias("bits"))
        .collect()
    )
    whole = bytearray(1 << (POWER - 3))
    for row in parts:
        if row.part is not None:
            whole[row.part * 4096 : (row.part + 1) * 4096] = row.bits
    return bytes(whole)


def is_set(bits: bytes, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each unsigned 64-bit value is set."""
    low = (values & np.uint64((1 << POWER) - 1)).astype(np.int64)
    return (np.frombuffer(bits, np.uint8)[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def may_hold(bits: bytes):
    """UDF: whether a value's bit is set; null: false."""

    @F.arrow_udf("boolean")
    def test(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            filled = column.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.array(is_set(bits, filled) & column.is_valid().to_numpy(zero_copy_only=False))

    return test
