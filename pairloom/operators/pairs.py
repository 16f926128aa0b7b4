"""Labelled pairs from triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import DEFAULT_LANG, format_passage, format_query, pair_text
from pairloom.schema import require_columns


def format_pairs(df: DataFrame, lang: Column | str = DEFAULT_LANG) -> DataFrame:
    """Triplets with the query and passage templates applied."""
    require_columns(df, ["anchor", "positive", "negative"])
    return df.withColumns(
        {
            "query_text": format_query("anchor", lang),
            "positive_text": format_passage("positive", lang),
            "negative_text": format_passage("negative", lang),
        }
    )


def label_pairs(df: DataFrame, lang: Column | str = DEFAULT_LANG, key: str = "row_key") -> DataFrame:
    """Two rows per triplet: side 0 is the positive with label 1, side 1 the negative with 0."""
    require_columns(df, [key, "anchor", "positive", "negative"])
    sides = F.array(
        F.struct(
            F.lit(0).alias("side"),
            format_passage("positive", lang).alias("passage_text"),
            F.lit(1.0).alias("label"),
        ),
        F.struct(
            F.lit(1).alias("side"),
            format_passage("negative", lang).alias("passage_text"),
            F.lit(0.0).alias("label"),
        ),
    )
    return df.select(
        key, format_query("anchor", lang).alias("query_text"), F.inline(sides)
    ).withColumn("pair_text", pair_text("query_text", "passage_text"))
