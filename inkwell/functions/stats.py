"""Numeric and key functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(x: Column, y: Column, default: float = 0.0) -> Column:
    """x / y, or the default where y is zero or either is null."""
    return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(default))


def known(x: Column) -> Column:
    """NaN becomes null, which aggregates leave out."""
    return F.when(~F.isnan(x), x)


def length_band(n: Column) -> Column:
    """short below 250, medium below 500, long for all else (negative or missing counts too)."""
    return F.when((n >= 0) & (n < 250), "short").when((n >= 250) & (n < 500), "medium").otherwise("long")


def hash_order(seed: int, key: Column) -> Column:
    """A reproducible random order: SHA-256 of the seed and the key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_unit(seed: int, key: Column) -> Column:
    """A reproducible number from 0 to 1 (both inside)."""
    return F.conv(F.substring(hash_order(seed, key), 1, 4), 16, 10).cast("double") / F.lit(65535.0)


def hash_seed(key: Column, seed: int = 42) -> Column:
    """A reproducible seed below 2^31 for a row."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 31))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k out of n; (0, 1) of none."""
    k, n = k.cast("double"), n.cast("double")
    p, zz = F.try_divide(k, n), z * z
    bottom = 1 + F.try_divide(F.lit(zz), n)
    middle = (p + F.try_divide(F.lit(zz), 2 * n)) / bottom
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(zz), 4 * n * n)) / bottom
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), middle + half)).otherwise(1.0)


def uncertainty(p: Column) -> tuple[Column, Column]:
    """Band around a probability: 0.2 wide either way at one half, 0.05 at the ends, inside 0 to 1."""
    width = 0.15 * (1 - F.abs(p - 0.5) * 2) + 0.05
    return F.greatest(F.lit(0.0), p - width), F.least(F.lit(1.0), p + width)
