"""Seeded md5 hashing: every random choice in the package derives from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


HASH_BITS = 60


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def seeded_hash(seed: int | str, *keys: Column | str) -> Column:
    """md5 of `seed:key:key...` as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_column(k).cast("string") for k in keys]))


def hash_bigint(digest: Column | str) -> Column:
    """The first 15 hex digits as a non-negative BIGINT below 2^HASH_BITS."""
    return F.conv(F.substring(_column(digest), 1, 15), 16, 10).cast("bigint")


def hash_unit(digest: Column | str) -> Column:
    """The digest as a DOUBLE in [0, 1)."""
    return hash_bigint(digest) / F.lit(float(1 << HASH_BITS))
