"""Exact dedup by distributed MSD radix partitioning.

The digits of a text are its normalised byte length and then its successive bytes, taken in
blocks that grow from round to round. A round groups the rows that are still together by
their next digit; groups of one row and groups whose texts have ended leave, the others go
on with their remaining bytes. Equality is decided by the bytes alone, no digest is used.

Scale: the first round settles nearly all texts that have no copy, with one shuffle of
digits (combined before the shuffle, so that a group of copies of any size arrives as one
row per task) and one shuffle of the rows. Later rounds carry copies only. Hot groups lie
in the left side of an outer join, which adaptive execution splits. Every round ends in a
written table, so lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import one_space, text_or_empty
from pairloom.session import discard, materialise

FIRST_WIDTH = 64
GROWTH = 64


def exact_dedup(
    docs: DataFrame, carry: Sequence[str] = (), first_width: int = FIRST_WIDTH, growth: int = GROWTH
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, and in the
    struct `row` the columns named by `carry`.

    Texts are equal when they are identical after each run of ASCII white space is replaced
    by one space. Of equal texts the row with the smallest doc_id stays. A null text counts
    as empty, and all empty texts are equal. A row without doc_id stays only if no equal text
    has one. If several equal rows share the smallest doc_id, exactly one of them stays.
    Extra columns are ignored unless carried; an empty table gives an empty result.
    """
    data = F.encode(one_space(text_or_empty()), "utf-8")
    rows = docs.select(
        F.col("doc_id").alias("_id"),
        F.struct(*[F.col(c) for c in carry]).alias("_row") if carry else F.lit(0).alias("_row"),
        data.alias("_rest"),
    ).withColumns(
        {
            "_length": F.length("_rest"),
            "_sha": F.sha2("_rest", 256),
            "_group": F.lit(0).cast("bigint"),
        }
    )
    done, width, depth = [], first_width, 0
    while True:
        depth += width
        found, groups = _round(rows, width, depth)
        table = materialise(found, "radix", ["_active"])
        discard(groups)
        done.append(table.where(~F.col("_active")))
        rows = table.where(F.col("_active")).drop("_active", "_n", "_keep")
        if rows.isEmpty():
            break
        width *= growth
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    return _decide(settled, docs, carry)


def _round(rows: DataFrame, width: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """The rows after one more digit, and the written table of groups they were joined with."""
    digit = ["_group", "_length", "_digit"]
    digits = rows.withColumn("_digit", F.substring("_rest", 1, width))
    groups = (
        digits.groupBy(*digit)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_keep"))
        .where(F.col("_n") > 1)
        .withColumn("_next", F.monotonically_increasing_id())
    )
    groups = materialise(groups, "radix_groups")
    active = F.col("_n").isNotNull() & (F.col("_length") > depth)
    found = (
        digits.join(groups.hint("shuffle_hash"), digit, "left")
        .withColumn("_active", active)
        .select(
            "_id", "_row", "_length", "_sha", "_n", "_keep", "_active",
            F.col("_next").alias("_group"),
            F.when(F.col("_active"), F.substring("_rest", width + 1, 2**31 - 1)).alias("_rest"),
        )
    )
    return found, groups


def _decide(settled: DataFrame, docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Mark the row that stays; only rows with the smallest doc_id of a group are ranked."""
    alone = F.col("_n").isNull()
    first = F.col("_id").eqNullSafe(F.col("_keep"))
    rank = F.row_number().over(Window.partitionBy("_group", "_length", "_sha").orderBy("_id"))
    ranked = settled.where(~alone & first).withColumn("_kept", rank == 1)
    others = settled.where(alone | ~first).withColumn("_kept", F.col("_n").isNull())
    return ranked.unionByName(others).select(
        F.col("_id").alias("doc_id"),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce(F.col("_n"), F.lit(1)).cast("bigint").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.col("_row").alias("row")] if carry else []),
    )
