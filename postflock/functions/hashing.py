"""MurmurHash 2 of strings, as published by A. Appleby (public domain)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

# Fixed values.
M64, SHIFT64, SEED64 = 0xC6A4A7935BD1E995, 47, 0xE17A1465
M32, SHIFT32, SEED32 = 0x5BD1E995, 24, 0x9747B28C


def _murmur(data: bytes, size: int, m: int, shift: int, h: int) -> int:
    """Whole words of ``size`` bytes are mixed in, then what is left; ``h`` holds
    the seed and the length."""
    top = (1 << 8 * size) - 1
    cut = len(data) // size * size
    for at in range(0, cut, size):
        k = int.from_bytes(data[at : at + size], "little") * m & top
        k = (k ^ k >> shift) * m & top
        h = (h ^ k) * m & top if size == 8 else (h * m & top) ^ k
    if cut < len(data):
        h = (h ^ int.from_bytes(data[cut:], "little")) * m & top
    first, last = (shift, shift) if size == 8 else (13, 15)
    h = (h ^ h >> first) * m & top
    h ^= h >> last
    return h - (1 << 8 * size) if h >> 8 * size - 1 else h


def murmur64(data: bytes, seed: int = SEED64) -> int:
    return _murmur(data, 8, M64, SHIFT64, (seed ^ len(data) * M64) & (1 << 64) - 1)


def murmur32(data: bytes, seed: int = SEED32) -> int:
    return _murmur(data, 4, M32, SHIFT32, seed ^ len(data))


@F.pandas_udf(LongType())
def murmur64_of(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else murmur64(x.encode())).astype("Int64")


@F.pandas_udf(IntegerType())
def murmur32_of(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else murmur32(x.encode())).astype("Int32")
