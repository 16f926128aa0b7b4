"""Projection and union of the raw sources into the triplet table, and its row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import base_name
from pairloom.schema import require_columns


def project_supervised(df: DataFrame) -> DataFrame:
    """Keep anchor, positive and the first negative; other negatives are dropped."""
    require_columns(df, ["anchor", "positive", "negative_1"], "supervised source")
    return df.select(
        "anchor", "positive", F.col("negative_1").alias("negative"), *_file_column(df)
    ).withColumn("source_kind", F.lit("supervised"))


def project_detailed(df: DataFrame) -> DataFrame:
    """Rename the detailed-similarity columns to the triplet schema."""
    require_columns(df, ["anchor", "original_positive", "best_other_positive"], "detailed source")
    return df.select(
        "anchor",
        F.col("original_positive").alias("positive"),
        F.col("best_other_positive").alias("negative"),
        *_file_column(df),
    ).withColumn("source_kind", F.lit("detailed"))


def _file_column(df: DataFrame) -> list:
    if "source_file" in df.columns:
        return [F.col("source_file")]
    return [F.lit(None).cast("string").alias("source_file")]


def union_sources(supervised: DataFrame, detailed: DataFrame) -> DataFrame:
    """All rows of both projected sources, by column name."""
    return project_supervised(supervised).unionByName(project_detailed(detailed))


def source_report(df: DataFrame) -> DataFrame:
    """Rows per source file."""
    return (
        df.withColumn("file_name", base_name("source_file"))
        .groupBy("source_kind", "file_name")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def split_report(df: DataFrame) -> DataFrame:
    """Rows per dataset version, split and kind of source."""
    return df.groupBy("data_version", "split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("source_kind") == "supervised").alias("n_supervised"),
        F.count_if(F.col("source_kind") == "detailed").alias("n_detailed"),
    )
