"""Small column functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def near_zero(c: Column) -> Column:
    """Values under 1e-6 in size become 0."""
    return F.when(F.abs(c) < 1e-6, 0.0).otherwise(c)


def positive_zero(c: Column) -> Column:
    return F.when(c == 0, 0.0).otherwise(c)


def divide(num: Column, den: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(den != 0, num / den).otherwise(0.0)


def mask_to_null(c: Column, mask) -> Column:
    return F.nullif(c, F.lit(mask)) if mask is not None else c


def above(c: Column, threshold) -> Column:
    """1 where strictly above, else 0."""
    return (c > threshold).cast("int")


def scale(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Min-max over all rows; low where all values are equal."""
    everywhere = Window.partitionBy()
    least, most = F.min(c).over(everywhere), F.max(c).over(everywhere)
    return F.when(most > least, (c - least) / (most - least) * (high - low) + low).otherwise(low)


def min_decimals(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column the fewest characters after the point in any value's text, minus 1 (at least 0)."""
    after = lambda c: F.length(F.substring_index(F.col(c).cast("string"), ".", -1))
    return df.agg(*[F.greatest(F.min(after(c)) - 1, F.lit(0)).alias(c) for c in columns])


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values: the primes of XXH64


def xxhash64_longs(*columns) -> np.ndarray:
    """F.xxhash64() of long columns, in numpy: arrays of int64 or numbers, as int64."""

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    with np.errstate(over="ignore"):
        h = np.array(42, np.uint64)
        for c in columns:
            value = np.asarray(c, np.int64).view(np.uint64)
            h = (h + _P5 + np.uint64(8)) ^ (turned(value * _P2, 31) * _P1)
            h = turned(h, 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)
