"""Stable fractions, priorities and seeds: the same for a key wherever and whenever it is computed."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_fraction(key: Column, seed: int) -> Column:
    """In [0, 1), from 52 bits of the MD5 of seed, NUL, key; SQL can compute it too."""
    digest = F.md5(F.concat(F.lit(str(seed)), F.lit("\0"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def stable_fraction_blake(seed: int):
    """Pandas UDF key -> fraction from 64 bits of BLAKE2b of seed, NUL, key: the published split's own rule."""

    @F.pandas_udf("double")
    def fraction(keys: pd.Series) -> pd.Series:
        return pd.Series([int.from_bytes(hashlib.blake2b(f"{seed}\0{k}".encode(), digest_size=8).digest(), "big") / 2**64 for k in keys])

    return fraction


def stable_priority(shape: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(str(seed)), F.lit("\0"), shape), 256)


def attempt_seed(a: int, b: int) -> int:
    """32 bits of BLAKE2b of `a:b`."""
    return int.from_bytes(hashlib.blake2b(f"{a}:{b}".encode(), digest_size=4).digest(), "big")


def safe_ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """0 where the denominator is."""
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), digits), F.lit(0.0))
