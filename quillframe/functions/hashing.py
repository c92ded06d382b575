"""Deterministic order and indices from MD5, alike in Spark and in SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: str | int, *keys: Column | str) -> Column:
    """A digest to order by: replaces seeded shuffles."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in cols)))


def index_from(digest: Column, n: Column | int) -> Column:
    """0..n-1 from the first 32 bits of a digest."""
    value = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.pmod(value, n if isinstance(n, Column) else F.lit(n))


def hashed_index(seed: str | int, n: Column | int, *keys: Column | str) -> Column:
    return index_from(order_key(seed, *keys), n)


def uniform(seed: str | int, *keys: Column | str) -> Column:
    """[0, 1) in steps of a thousandth."""
    return hashed_index(seed, 1000, *keys) / F.lit(1000.0)
