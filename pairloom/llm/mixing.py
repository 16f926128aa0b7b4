"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash in [0, 2^60). A source takes each of its documents a whole number
of times, and once more those whose hash lies below the source's threshold. The threshold
is found without sorting: word counts are summed by source and hash bucket, the bucket in
which the target is reached is split again by the next bits of the hash, and so on until it
holds one document. The mix is then a filter.

Scale: documents are read once into a narrow table of hashes and sizes. Each level is one
aggregation, combined before its shuffle, whose result has at most 1,024 rows per source;
from the second level on only the boundary buckets are read. The decision joins one row per
source, which Spark broadcasts only while that table is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.hashing import HASH_BITS, hash_bigint
from pairloom.llm.common import text_or_empty, word_count
from pairloom.session import materialise

LEVEL_BITS = 10
MOST_TIMES = 3


def document_hash(seed: int = 0) -> Column:
    """Hash of doc_id and text; rows that repeat both share it and are taken alike."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return hash_bigint(F.md5(F.concat_ws(":", F.lit(str(seed)), key, text_or_empty())))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source of `sizes` (source, size): source_size and target.

    Sources in code point order, null last, get the weights in turn and share all words by
    weight. A target stops at `MOST_TIMES` times its source's size; what is cut off is shared
    again among the others until none is above. The loop moves four numbers to the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    values = F.array(*[F.lit(float(w)) for w in weights])
    sources = materialise(
        totals.withColumn("_weight", F.element_at(values, (place + 1).cast("int"))), "sources"
    )
    most = F.col("source_size").cast("double") * MOST_TIMES
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else (most <= F.col("_weight") * level)
        found = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, most)).alias("cut"),
            F.sum(F.when(~full, F.col("_weight"))).alias("free"),
            F.count_if(full).alias("capped"),
        ).first()
        if not found["free"] or found["capped"] == capped:
            break
        capped = found["capped"]
        level = (found["total"] - (found["cut"] or 0.0)) / found["free"]
    target = F.lit(0.0) if level is None else F.least(most, F.col("_weight") * level)
    return sources.select("source", "source_size", target.alias("target"))


def mix_thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: `whole` times every document, and once more where `hash < threshold`.

    `sizes` has source, size, hash. The threshold leaves the source's words as near to its
    target as the document at the boundary allows.
    """
    size, target = F.col("source_size").cast("double"), F.col("target")
    whole = F.when(size > 0, F.least(F.floor(target / size), F.lit(MOST_TIMES))).otherwise(0)
    state = targets.withColumn("whole", whole.cast("bigint")).select(
        "source", "source_size", "target", "whole",
        (target - F.col("whole") * size).alias("_rest"),
        F.lit(0).cast("bigint").alias("_prefix"),
    )
    settled = None
    open_rows = sizes.where(F.col("size") > 0)
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        buckets = (
            open_rows.withColumn("_bucket", F.shiftright("hash", shift))
            .groupBy("source", "_bucket")
            .agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_rows"))
        )
        up_to = Window.partitionBy("source").orderBy("_bucket")
        before = F.sum("_words").over(up_to) - F.col("_words")
        keys = state.withColumnRenamed("source", "_source")
        crossing = (
            buckets.withColumn("_before", before)
            .join(keys, F.col("source").eqNullSafe(F.col("_source")))
            .where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_words") > F.col("_rest")))
            .select(
                "source", "source_size", "target", "whole",
                (F.col("_rest") - F.col("_before")).alias("_rest"),
                F.col("_bucket").alias("_prefix"), "_words", "_rows",
            )
        )
        crossing = materialise(crossing, "boundary")
        last = shift == 0
        final = (F.col("_rows") == 1) | F.lit(last)
        # the boundary bucket is taken as a whole if that comes nearer to the target
        edge = F.col("_prefix") + F.when(F.col("_rest") * 2 > F.col("_words"), 1).otherwise(0)
        ended = crossing.where(final).select(
            "source", F.shiftleft(edge, shift).alias("threshold")
        )
        settled = ended if settled is None else settled.unionByName(ended)
        state = crossing.where(~final).drop("_words", "_rows")
        if last or state.isEmpty():
            break
        bounds = state.select(F.col("source").alias("_source"), F.col("_prefix").alias("_at"))
        open_rows = (
            sizes.where(F.col("size") > 0)
            .join(
                bounds,
                F.col("source").eqNullSafe(F.col("_source"))
                & (F.shiftright("hash", shift) == F.col("_at")),
                "left_semi",
            )
        )
    found = materialise(settled.withColumnRenamed("source", "_source"), "thresholds")
    return (
        targets.withColumn("whole", whole.cast("bigint"))
        .join(found, F.col("source").eqNullSafe(F.col("_source")), "left")
        .select(
            "source", "source_size", "target", "whole",
            # a source that never crosses its rest has a rest of all words or of none
            F.coalesce(
                F.col("threshold"),
                F.when(
                    target - F.col("whole") * size > size / 2, F.lit(1 << HASH_BITS)
                ).otherwise(0).cast("bigint"),
            ).alias("threshold"),
        )
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 0
) -> DataFrame:
    """Per row of `docs`: the row as struct `row`, doc_id, size, source_size, target and
    times (how often the mix takes the row).

    A null text has size 0, a null source is a source of its own. Rows that repeat doc_id
    and text are taken alike. Documents without words are taken as their source's whole
    times. An empty table gives an empty result; columns of any other name stay in `row`.
    """
    marked = docs.select(
        F.struct(*docs.columns).alias("row"),
        "doc_id",
        "source",
        word_count(text_or_empty()).alias("size"),
        document_hash(seed).alias("hash"),
    )
    sizes = materialise(marked.select("source", "size", "hash"), "sizes")
    targets = materialise(source_targets(sizes, weights), "targets")
    plan = materialise(
        mix_thresholds(sizes, targets).withColumnRenamed("source", "_source"), "mix"
    )
    times = F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return marked.join(plan, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "row", "doc_id", "size", "source_size", "target",
        F.least(times, F.lit(MOST_TIMES)).cast("bigint").alias("times"),
    )


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken."""
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))
    return mixed.where(F.col("times") > 0).select("row", copies.alias("_copy")).select("row.*")
