"""A broadcast bit map of fixed size that holds hashes: it may pass others, and never misses one that was put in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 16 MB, however many hashes there are; a fuller map only passes more.
FILTER_BITS = 27


def bit_filter(hashes: DataFrame, column: str):
    """The broadcast map of a column of 64-bit hashes. The driver gets its set pages, 4 KB each, 16 MB at most."""
    place = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    maps = hashes.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for row in maps.toLocalIterator():
        part = np.frombuffer(row.m, np.uint8)
        at = (row.b - 1) * 4096  # Spark numbers pages from 1; page 0 holds the value 0 alone
        if at >= 0:
            bits[at : at + len(part)] |= part[: len(bits) - at]
    return hashes.sparkSession.sparkContext.broadcast(bits)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    at = np.maximum(place - 1, 0)
    return (bits[at >> 3] & (1 << (at & 7)).astype(np.uint8) != 0) | (place == 0)


def may_hold(bits, value: Column) -> Column:
    """Whether the map may hold the value's xxhash64; only that hash travels to Python."""

    @F.pandas_udf("boolean")
    def held(h: pd.Series) -> pd.Series:
        return pd.Series(passes(bits.value, h.to_numpy().view(np.uint64)))

    return held(F.xxhash64(value))
