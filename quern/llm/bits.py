"""Bit arrays set on Spark and brought to the driver as words, for Bloom filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bit_array(positions: DataFrame, size: int) -> np.ndarray:
    """``size`` bits (a multiple of 64) as unsigned 64-bit words; those of column ``position`` are set.

    Positions are or-ed per word before and after the shuffle, so that the driver gets at
    most ``size / 64`` rows, whatever the number of positions. The caller bounds ``size``."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("position").bitwiseAND(F.lit(63)).cast("int"))
    words = positions.groupBy(F.shiftright("position", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def is_set(words: np.ndarray, positions: np.ndarray) -> np.ndarray:
    at = positions.astype(np.int64)
    return (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
