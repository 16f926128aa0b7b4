"""Similarity scores of triplets and lists, and teacher scores of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.math import cosine_of, dot, normalize_cosine, relu, sigmoid
from pairloom.functions.text import format_passage, format_query, token_set
from pairloom.operators.encode import DEFAULT_DIM, Encoder, text_cosines
from pairloom.operators.skew import salted_join
from pairloom.schema import require_columns


def pair_cosine(df: DataFrame, a: str, b: str, normalize: bool = True) -> DataFrame:
    """Add `cos_raw` and `score`: (c+1)/2, or c with negatives clipped to 0.

    Each dot product is a column of its own, so it is computed once per row.
    """
    raw = F.col("cos_raw")
    return (
        df.withColumns({"_ab": dot(a, b), "_aa": dot(a, a), "_bb": dot(b, b)})
        .withColumn("cos_raw", cosine_of("_ab", "_aa", "_bb"))
        .withColumn("score", normalize_cosine(raw) if normalize else relu(raw))
        .drop("_ab", "_aa", "_bb")
    )


def _with_margin(df: DataFrame) -> DataFrame:
    """Add normalised scores and the margin to `pos_raw` and `neg_raw`."""
    return df.withColumns(
        {"pos_score": normalize_cosine("pos_raw"), "neg_score": normalize_cosine("neg_raw")}
    ).withColumn("margin", F.col("pos_score") - F.col("neg_score"))


def vector_triplet_scores(df: DataFrame) -> DataFrame:
    """Add raw and normalised positive/negative similarity and the margin.

    Input holds `anchor_vec`, `positive_vec`, `negative_vec`.
    """
    a, p, n = "anchor_vec", "positive_vec", "negative_vec"
    require_columns(df, [a, p, n])
    dots = {"_ap": dot(a, p), "_an": dot(a, n), "_aa": dot(a, a), "_pp": dot(p, p), "_nn": dot(n, n)}
    scored = df.withColumns(dots).withColumns(
        {"pos_raw": cosine_of("_ap", "_aa", "_pp"), "neg_raw": cosine_of("_an", "_aa", "_nn")}
    )
    return _with_margin(scored.drop(a, p, n, *dots))


def triplet_scores(
    df: DataFrame, encoder: Encoder | None = None, dim: int = DEFAULT_DIM,
    lang: Column | str = "(ko)", key: str = "row_key",
) -> DataFrame:
    """Format, encode and score text triplets in one map pass, without a shuffle.

    The vectors stay in the Python batch that made them; only two numbers come back.
    """
    require_columns(df, [key, "anchor", "positive", "negative"])
    cosines = text_cosines(
        format_query("anchor", lang),
        [format_passage("positive", lang), format_passage("negative", lang)],
        encoder,
        dim,
    )
    pair = df.select(key, cosines.alias("cosines"))
    return _with_margin(
        pair.select(
            key,
            F.element_at("cosines", 1).alias("pos_raw"),
            F.element_at("cosines", 2).alias("neg_raw"),
        )
    )


def attach_vectors(
    df: DataFrame, vectors: DataFrame, id_col: str, out: str, spread_by: list[str],
    min_rows: int = 1_000_000,
) -> DataFrame:
    """Look up vectors by id; a row whose id has none keeps a null vector. Ids used by a large
    share of the rows, and missing ones, are salted."""
    lookup = vectors.select(F.col("vec_id").alias(id_col), F.col("vector").alias(out))
    return salted_join(df, lookup, [id_col], spread_by, "left", min_rows=min_rows)


def list_scores(df: DataFrame, normalize: bool = True) -> DataFrame:
    """Student score of every candidate in a long table with `query_vec`, `passage_vec`."""
    require_columns(df, ["query_vec", "passage_vec"])
    scored = pair_cosine(df, "query_vec", "passage_vec", normalize)
    return scored.withColumnRenamed("score", "student").drop("query_vec", "passage_vec", "cos_raw")


FEATURES = ("jaccard", "coverage", "length_ratio")
DEFAULT_WEIGHTS = {"jaccard": 4.0, "coverage": 6.0, "length_ratio": 0.5}
DEFAULT_BIAS = -2.0


def with_features(df: DataFrame, query: str = "query", passage: str = "passage") -> DataFrame:
    """Add the overlap features. The token sets are computed once per row."""
    sets = df.withColumns({"_q": token_set(query), "_p": token_set(passage)})
    sets = sets.withColumn("_shared", F.size(F.array_intersect("_q", "_p")).cast("double"))
    n_q, n_p = F.size("_q").cast("double"), F.size("_p").cast("double")

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    return sets.withColumns(
        {
            "jaccard": ratio(F.col("_shared"), n_q + n_p - F.col("_shared")),
            "coverage": ratio(F.col("_shared"), n_q),
            "length_ratio": ratio(F.least(n_q, n_p), F.greatest(n_q, n_p)),
        }
    ).drop("_q", "_p", "_shared")


def linear_logit(weights: dict[str, float] | None = None, bias: float | None = None) -> Column:
    weights = DEFAULT_WEIGHTS if weights is None else weights
    logit = F.lit(DEFAULT_BIAS if bias is None else float(bias))
    for name in FEATURES:
        logit = logit + F.col(name) * F.lit(float(weights[name]))
    return logit


def teacher_scores(
    df: DataFrame, query: str = "query", passage: str = "passage",
    weights: dict[str, float] | None = None, bias: float | None = None,
) -> DataFrame:
    """Built-in teacher: sigmoid of a linear model over the overlap features.

    A fitted model (see `fit.load_teacher`) plugs in through `weights` and `bias`.
    """
    featured = with_features(df, query, passage)
    return featured.withColumn("logit", linear_logit(weights, bias)).withColumn(
        "teacher", sigmoid("logit")
    )


Scorer = Callable[[pd.DataFrame], pd.Series]
"""User teacher: a frame with `query` and `passage` in, one score per row out."""


def teacher_scores_with(
    df: DataFrame, scorer: Scorer, query: str = "query", passage: str = "passage",
) -> DataFrame:
    """Score pairs with a user function, one Arrow batch at a time, next to the data.

    Only the two texts go to Python. Score once and write the result: the teacher is the
    costly part.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, passages in batches:
            pairs = pd.DataFrame({"query": queries, "passage": passages})
            yield pd.Series(scorer(pairs), index=pairs.index).astype(float)

    return df.withColumn("teacher", run.asNondeterministic()(query, passage))
