"""The preparation stage in one call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.ordering import split_versions
from pairloom.operators.prepare import split_report, union_sources
from pairloom.schema import apply_null_policy, with_row_key_in_place
from pairloom.session import discard, materialise
from pairloom.sources.files import read_detailed, read_supervised
from pairloom.sources.sinks import write_splits


def prepare(
    spark: SparkSession, supervised_pattern: str, detailed_path: str, out: str, seed: int = 42,
    null_policy: str = "drop", after_read: Callable[[], None] | None = None,
) -> DataFrame:
    """Read both sources, split, write both dataset versions; returns their row counts.

    Texts are written twice, as rows read and as versions, and only those of repeated rows are
    shuffled. `after_read` is called when the sources are not needed any more.
    """
    raw = union_sources(
        read_supervised(spark, supervised_pattern),
        read_detailed(spark, detailed_path),
    )
    table = materialise(apply_null_policy(raw, null_policy), "triplets", compression="zstd")
    if after_read:
        after_read()
    keyed = with_row_key_in_place(table).drop("occurrence")
    keys = materialise(keyed.where(F.col("source_kind") == "supervised").select("row_key"), "keys")
    write_splits(split_versions(keyed, seed=seed, keys=keys), out, compression="zstd")
    discard(table, keys)
    return split_report(spark.read.parquet(out))
