"""Seeded order: dense index, exact samples and splits, batches.

All of them rank rows by the first 60 bits of `md5(seed:key)`, then by key. The first 16 bits cut
the rows into at most 65,536 even buckets; the per-bucket counts are the only thing summed in
one task or broadcast, so that table has a fixed upper size whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.hashing import HASH_BITS, hash_bigint, hash_unit, seeded_hash
from pairloom.schema import require_columns

BUCKET_BITS = 16


def _rank_hash(key: str, seed: int | str | None) -> Column:
    """The seeded position of a row as a number: cheap to move and to sort. Without a seed
    the key is a seeded hash itself."""
    return hash_bigint(F.col(key) if seed is None else seeded_hash(seed, key))


def _bucketed(df: DataFrame, key: str, seed: int | str | None) -> DataFrame:
    require_columns(df, [key])
    hashed = df.withColumn("_hash", _rank_hash(key, seed))
    return hashed.withColumn("_bucket", F.shiftright("_hash", HASH_BITS - BUCKET_BITS).cast("int"))


def _bucket_offsets(bucketed: DataFrame) -> DataFrame:
    """(_bucket, _size, _offset, _total): at most 2^BUCKET_BITS rows."""
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    running = F.sum("_size").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("_size").over(W.partitionBy())
    return sizes.select(
        "_bucket", "_size", (running - F.col("_size")).alias("_offset"), total.alias("_total")
    )


def dense_index(
    df: DataFrame, key: str = "row_key", seed: int | str | None = 42, out: str = "idx",
    total: str | None = None,
) -> DataFrame:
    """Number the rows 0..N-1 in seeded random order; `key` must be unique. With `seed=None`
    the key already is a seeded hash (see `hashing.seeded_hash`).

    `total` names an optional column that receives N.
    """
    bucketed = _bucketed(df, key, seed)
    in_bucket = F.row_number().over(W.partitionBy("_bucket").orderBy("_hash", key))
    ranked = bucketed.withColumn("_rank", in_bucket).drop("_hash")
    indexed = ranked.join(F.broadcast(_bucket_offsets(bucketed)), "_bucket").withColumn(
        out, (F.col("_offset") + F.col("_rank") - 1).cast("bigint")
    )
    if total:
        indexed = indexed.withColumn(total, F.col("_total").cast("bigint"))
    return indexed.drop("_bucket", "_rank", "_size", "_offset", "_total")


def rank_bands(
    df: DataFrame,
    cuts: Callable[[Column], Sequence[Column]],
    labels: Sequence[str],
    key: str = "row_key",
    seed: int | str = 42,
    out: str = "band",
    by_group: bool = False,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Label rows by where their seeded rank falls between exact cut positions.

    `cuts` maps the row count to ascending ranks; ranks below the first cut get the first
    label and so on. The bucket counts tell which buckets the cuts fall into, a window over
    those few buckets finds the row at each cut, and every row is then labelled by comparing
    its own hash: the data itself is read once and never shuffled. With `by_group` the key
    may repeat and its distinct values are what is ranked and counted. `keys` holds the same
    keys in a table that is cheaper to read.
    """
    keys = (df if keys is None else keys).select(key)
    keys = keys.distinct() if by_group else keys
    keys = _bucketed(keys, key, seed)
    offsets = _bucket_offsets(keys)
    n_cuts = len(labels) - 1
    found = []
    for i, cut in enumerate(cuts(F.col("_total"))):
        inside = (F.col("_offset") <= cut) & (cut < F.col("_offset") + F.col("_size"))
        found += [
            F.max(F.when(inside, F.col("_bucket"))).alias(f"bucket{i}"),
            F.max(F.when(inside, cut - F.col("_offset"))).alias(f"rank{i}"),
        ]
    place = offsets.agg(F.struct(*found).alias("place")).scalar()
    # One look-up, as a filter would hash the key again for every comparison.
    holds_cut = F.array_contains(
        F.array(*[place[f"bucket{i}"] for i in range(n_cuts)]), F.col("_bucket")
    )
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy("_hash", key)) - 1
    edges = keys.where(holds_cut).withColumn("_rank", rank)
    first = [
        F.max(
            F.when(
                (F.col("_bucket") == place[f"bucket{i}"]) & (F.col("_rank") == place[f"rank{i}"]),
                F.struct("_hash", F.col(key).alias("_key")),
            )
        ).alias(f"cut{i}")
        for i in range(n_cuts)
    ]
    edge = edges.agg(F.struct(*first).alias("edge")).scalar()
    own = F.struct("_hash", F.col(key).alias("_key"))
    chosen = F.lit(labels[-1])
    for i in reversed(range(n_cuts)):
        # No row at a cut means that the cut is the end: all rows are below it.
        below = edge[f"cut{i}"].isNull() | (own < edge[f"cut{i}"])
        chosen = F.when(below, F.lit(labels[i])).otherwise(chosen)
    return df.withColumn("_hash", _rank_hash(key, seed)).withColumn(out, chosen).drop("_hash")


def sample_n(df: DataFrame, n: int, key: str = "row_key", seed: int | str = 42) -> DataFrame:
    """Exactly n rows in seeded order, or all rows if there are no more than n."""
    bands = rank_bands(df, lambda total: [F.lit(n).cast("bigint")], ["in", "out"], key, seed, "_in")
    return bands.where(F.col("_in") == "in").drop("_in")


def _split_cuts(ratios: Sequence[float]) -> Callable[[Column], list[Column]]:
    train, val, test = (float(r) for r in ratios)
    if not math.isclose(train + val + test, 1.0, abs_tol=1e-9):
        raise ValueError("split ratios must sum to 1")
    held_share = round(val + test, 12)
    test_share = round(test / held_share, 12)

    def cuts(total: Column) -> list[Column]:
        held = F.ceil(total * F.lit(held_share))
        tested = F.ceil(held * F.lit(test_share))
        return [total - held, total - tested]

    return cuts


def split_exact(
    df: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int | str = 42,
    key: str = "row_key", group_key: str | None = None, out: str = "split",
    keys: DataFrame | None = None,
) -> DataFrame:
    """Train/val/test of exact size: ceil(0.2 n) held out, ceil of its half for test.

    With `group_key` the sizes count groups, and all rows of one group share a split.
    """
    labels = ["train", "val", "test"]
    return rank_bands(
        df, _split_cuts(ratios), labels, group_key or key, seed, out, by_group=bool(group_key), keys=keys
    )


def split_hash(
    df: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int | str = 42,
    key: str = "row_key", group_key: str | None = None, out: str = "split",
) -> DataFrame:
    """Train/val/test by hash threshold: one map pass, sizes within sampling error.

    With `group_key` all rows of one group land in the same split.
    """
    train, val, _ = ratios
    unit = hash_unit(seeded_hash(seed, group_key or key))
    return require_columns(df, [group_key or key]).withColumn(
        out,
        F.when(unit < F.lit(float(train)), F.lit("train"))
        .when(unit < F.lit(round(float(train + val), 12)), F.lit("val"))
        .otherwise(F.lit("test")),
    )


def dataset_versions(df: DataFrame) -> DataFrame:
    """Both dataset versions in one pass over rows that carry `source_kind` and `split`.

    Supervised rows belong to both versions; detailed rows only to the train split of
    `supervised_with_detailed`.
    """
    require_columns(df, ["source_kind", "split"])
    supervised = F.col("source_kind") == "supervised"
    versions = F.when(
        supervised, F.array(F.lit("supervised_only"), F.lit("supervised_with_detailed"))
    ).otherwise(F.array(F.lit("supervised_with_detailed")))
    return df.withColumn(
        "split", F.when(supervised, F.col("split")).otherwise(F.lit("train"))
    ).withColumn("data_version", F.explode(versions))


def split_versions(
    df: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int | str = 42,
    key: str = "row_key", keys: DataFrame | None = None,
) -> DataFrame:
    """Split the supervised rows exactly, add the detailed rows to train, make both versions.
    `keys` holds the keys of the supervised rows, if a narrow table of them is at hand."""
    require_columns(df, ["source_kind", key])
    supervised = split_exact(df.where(F.col("source_kind") == "supervised"), ratios, seed, key, keys=keys)
    detailed = df.where(F.col("source_kind") != "supervised").withColumn("split", F.lit("train"))
    return dataset_versions(supervised.unionByName(detailed))


def assign_batches(
    df: DataFrame, batch_size: int, key: str = "row_key", seed: int | str = 42, epoch: int = 0,
) -> DataFrame:
    """Shuffle for one epoch and cut into batches; the last may be short."""
    indexed = dense_index(df, key, f"{seed}/{epoch}", "_position")
    return indexed.withColumn(
        "batch_id", F.floor(F.col("_position") / batch_size).cast("bigint")
    ).withColumn("batch_row", F.pmod(F.col("_position"), F.lit(batch_size)).cast("int")).drop(
        "_position"
    )
