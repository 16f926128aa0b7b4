"""Epoch metrics from a table of batch results, and the choice of the best epoch.

Batch rows are (run_id, phase, epoch, batch_id, loss, status) with phase `train` or `val`
and status `ok` or `skipped`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.schema import require_columns


def epoch_loss(batches: DataFrame, denominator: str = "processed") -> DataFrame:
    """Mean loss and skipped batches per run and epoch, train and validation side by side.

    `denominator="processed"` divides by the batches that ran; `"all"` also counts the
    skipped ones in the divisor.
    """
    require_columns(batches, ["run_id", "phase", "epoch", "loss", "status"])
    if denominator not in ("processed", "all"):
        raise ValueError(f"unknown denominator: {denominator}")

    def mean(phase: str):
        of_phase = F.col("phase") == phase
        done = of_phase & (F.col("status") == "ok")
        counted = of_phase if denominator == "all" else done
        n = F.count_if(counted)
        return F.when(n > 0, F.coalesce(F.sum(F.when(done, F.col("loss"))), F.lit(0.0)) / n)

    return batches.groupBy("run_id", "epoch").agg(
        mean("train").alias("train_loss"),
        mean("val").alias("val_loss"),
        F.count_if((F.col("phase") == "train") & (F.col("status") == "ok")).alias("n_processed"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped"),
    )


def best_epoch(epochs: DataFrame) -> DataFrame:
    """Lowest validation loss per run; the first epoch wins a tie."""
    best = F.min(F.struct("val_loss", "epoch"))
    return (
        epochs.where(F.col("val_loss").isNotNull())
        .groupBy("run_id")
        .agg(best.alias("best"))
        .select("run_id", F.col("best.epoch").alias("epoch"), F.col("best.val_loss").alias("val_loss"))
    )


def checkpoint_flags(epochs: DataFrame) -> DataFrame:
    """Running best validation loss and whether the epoch's model is to be saved.

    A window group is the epochs of one run: few rows however large the run's batches are.
    """
    before = (
        W.partitionBy("run_id").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    )
    previous = F.min("val_loss").over(before)
    return epochs.withColumn("previous_best", previous).select(
        "run_id",
        "epoch",
        "val_loss",
        F.least("previous_best", "val_loss").alias("best_loss"),
        F.coalesce(
            F.col("previous_best").isNull() | (F.col("val_loss") < F.col("previous_best")),
            F.lit(False),
        ).alias("save_model"),
    ).withColumn("save_model", F.col("save_model") & F.col("val_loss").isNotNull())
