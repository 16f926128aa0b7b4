"""Writers: dataset versions, CSV data sets and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter

from pairloom.schema import TRIPLET_COLUMNS, require_columns
from pairloom.session import shuffles_dropped


def csv_writer(df: DataFrame, mode: str = "errorifexists") -> DataFrameWriter:
    """UTF-8 CSV with a header; every value is quoted and kept as it is.

    Commas, quotes, line breaks and outer blanks in texts survive a round trip.
    """
    return (
        df.write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("encoding", "UTF-8")
    )


def write_splits(
    df: DataFrame, path: str, mode: str = "errorifexists", rebalance: bool = False,
    compression: str | None = None,
) -> None:
    """Write all versions and splits as Parquet, in folders
    `data_version=<version>/split=<split>`.

    Rows are written where they are: one pass, no shuffle, and up to six files per task. With
    `rebalance` rows are first shuffled by version and split into partitions of the advisory
    size, large ones split, for few and even files.
    """
    require_columns(df, ["data_version", "split"])
    if rebalance:
        df = df.hint("rebalance", "data_version", "split")
    writer = df.write.option("compression", compression) if compression else df.write
    with shuffles_dropped(df.sparkSession):
        writer.mode(mode).partitionBy("data_version", "split").parquet(path)


def write_csv_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The six CSV data sets with the triplet columns, in the same folders, in one pass."""
    require_columns(df, ["data_version", "split", *TRIPLET_COLUMNS])
    triplets = df.select(*TRIPLET_COLUMNS, "data_version", "split")
    csv_writer(triplets, mode).partitionBy("data_version", "split").csv(path)


def split_folder(path: str, data_version: str, split: str) -> str:
    return f"{path}/data_version={data_version}/split={split}"


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The one-row evaluation report as JSON."""
    report.coalesce(1).write.mode(mode).json(path)
