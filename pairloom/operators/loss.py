"""Listwise distillation loss as windows and two-level aggregates.

Input is the long score table (batch_id, qid, slot, teacher, student). Everything is keyed by
batch: one shuffle on `batch_id` serves the softmax windows, the per-query and the per-batch
aggregates, and every batch has the same bounded number of rows, so there are no hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.math import bce_with_logits, relu
from pairloom.schema import require_columns

# The loss settings of the training method.
TAU = 0.2
MARGIN_WEIGHT = 0.3
PENALTY_WEIGHT = 0.4
POSITIVE_THRESHOLD = 0.5
TARGET_MARGIN = 0.7
TARGET_NEGATIVE = 0.15
PER_QUERY_SHARE = 0.5
LOG_GUARD = 1e-12

SCORE_COLUMNS = ("batch_id", "qid", "slot", "teacher", "student")


def listwise_softmax(df: DataFrame, tau: float = TAU) -> DataFrame:
    """Add `p` and `q`: softmax of teacher and student within each query's list."""
    require_columns(df, SCORE_COLUMNS)
    one_list = W.partitionBy("batch_id", "qid")

    def exponent(name: str):
        scaled = F.col(name) / F.lit(float(tau))
        return F.exp(scaled - F.max(scaled).over(one_list))

    return (
        df.repartition("batch_id")
        .withColumns({"_et": exponent("teacher"), "_es": exponent("student")})
        .withColumns(
            {
                "p": F.col("_et") / F.sum("_et").over(one_list),
                "q": F.col("_es") / F.sum("_es").over(one_list),
            }
        )
        .drop("_et", "_es")
    )


def query_losses(df: DataFrame, tau: float = TAU) -> DataFrame:
    """Per query: KL(p||q), mean positive and negative score, negative sum and count."""
    positive = F.col("teacher") > POSITIVE_THRESHOLD
    return (
        listwise_softmax(df, tau)
        .groupBy("batch_id", "qid")
        .agg(
            F.sum(
                F.col("p") * (F.ln(F.col("p") + LOG_GUARD) - F.ln(F.col("q") + LOG_GUARD))
            ).alias("kl"),
            F.avg(F.when(positive, F.col("student"))).alias("pos_mean"),
            F.avg(F.when(~positive, F.col("student"))).alias("neg_mean"),
            F.sum(F.when(~positive, F.col("student"))).alias("neg_sum"),
            F.count_if(~positive).alias("neg_count"),
        )
    )


def batch_losses(
    df: DataFrame, tau: float = TAU, target_margin: float = TARGET_MARGIN,
    target_negative: float = TARGET_NEGATIVE,
) -> DataFrame:
    """Per batch: mean KL, margin loss and negative penalty.

    The penalty is not linear in the batch (a hinge of the batch mean), so it is formed from
    sums and counts of the whole batch, never averaged over parts.
    """
    both = F.col("pos_mean").isNotNull() & F.col("neg_mean").isNotNull()
    margin = relu(F.lit(target_margin) - (F.col("pos_mean") - F.col("neg_mean")))
    query_penalty = relu(F.col("neg_mean") - target_negative)
    batch_negative = F.sum("neg_sum") / F.sum("neg_count")
    return (
        query_losses(df, tau)
        .groupBy("batch_id")
        .agg(
            F.avg("kl").alias("kl"),
            F.coalesce(F.avg(F.when(both, margin)), F.lit(0.0)).alias("margin_loss"),
            F.when(
                F.sum("neg_count") > 0,
                relu(batch_negative - target_negative)
                + PER_QUERY_SHARE
                * F.avg(F.when(F.col("neg_mean").isNotNull(), query_penalty)),
            )
            .otherwise(F.lit(0.0))
            .alias("penalty"),
        )
    )


def distill_loss(
    df: DataFrame, tau: float = TAU, w_margin: float = MARGIN_WEIGHT,
    w_penalty: float = PENALTY_WEIGHT, target_margin: float = TARGET_MARGIN,
    target_negative: float = TARGET_NEGATIVE,
) -> DataFrame:
    """Per batch: the three parts and their weighted total."""
    return batch_losses(df, tau, target_margin, target_negative).withColumn(
        "total",
        F.col("kl") + w_margin * F.col("margin_loss") + w_penalty * F.col("penalty"),
    )


def bce_loss(df: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    """Mean binary cross-entropy and row count."""
    return df.agg(
        F.avg(bce_with_logits(logit, label)).alias("bce"), F.count(F.lit(1)).alias("n_rows")
    )
