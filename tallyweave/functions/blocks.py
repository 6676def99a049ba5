"""Digests and checksums of byte columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Fixed value: the modulus of the weak checksum.
MODULUS = 65521


def content_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def verify_hash(value: Column, expected: Column) -> Column:
    return F.coalesce(content_hash(value) == F.lower(expected), F.lit(False))


def weak_of(data: bytes) -> int:
    """Sum of bytes, and sum of bytes weighted by their distance from the end; both sums start at 0."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    s1 = int(b.sum()) % MODULUS
    s2 = int((b * np.arange(len(b), 0, -1) % MODULUS).sum()) % MODULUS
    return s2 << 16 | s1


@F.pandas_udf(LongType())
def weak_checksum(data: pd.Series) -> pd.Series:
    """Rolling checksum of each block, in Arrow batches; null for null."""
    return pd.Series([None if d is None else weak_of(d) for d in data], dtype="Int64")


def rolling_weak(data: bytes, window: int) -> np.ndarray:
    """The weak checksum at every offset of ``data``, from prefix sums."""
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(b)))
    moment = np.concatenate(([0], np.cumsum(b * np.arange(len(b)))))
    at = np.arange(n)
    s1 = total[at + window] - total[at]
    s2 = (at + window) * s1 - (moment[at + window] - moment[at])
    return (s2 % MODULUS) << 16 | s1 % MODULUS
