"""An equi-join that stays even when a few keys hold most of the left rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
"""A key is hot above 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys."""


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = 1_000_000) -> DataFrame:
    """Keys holding more than 1/1000 of the rows and more than `min_rows`.

    Counts are combined before the shuffle; at most 1,000 keys can pass, so the result may
    be broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).scalar()
    return counts.where(
        (F.col("_rows") * HOT_SHARE > total) & (F.col("_rows") > min_rows)
    ).select(*keys)


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
    how: str = "inner", salts: int = 64, min_rows: int = 1_000_000,
) -> DataFrame:
    """Join `left` to the lookup table `right` on `keys`, spreading hot keys over tasks.

    Left rows of a hot key take one of `salts` salts from the hash of `spread_by`; the
    matching right rows are repeated once per salt. All other rows use salt 0 and are not
    repeated. `right` should be unique on `keys`; `how` is inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    marked = F.broadcast(hot_keys(left, keys, min_rows).withColumn("_hot", F.lit(True)))
    # rows without a key match nothing: they only have to be spread
    no_key = F.lit(False)
    for c in keys:
        no_key = no_key | F.col(c).isNull()
    salt = F.when(
        F.col("_hot") | no_key, F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts))
    ).otherwise(F.lit(0).cast("bigint"))
    copies = F.when(
        F.col("_hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    ).otherwise(F.array(F.lit(0).cast("bigint")))
    salted_left = left.join(marked, list(keys), "left").withColumn("_salt", salt).drop("_hot")
    salted_right = right.join(marked, list(keys), "left").withColumn("_salt", F.explode(copies))
    return salted_left.join(salted_right.drop("_hot"), [*keys, "_salt"], how).drop("_salt")
