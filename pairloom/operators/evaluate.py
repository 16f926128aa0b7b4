"""Evaluation of triplet scores: report, chart tables, targets and samples.

Input rows carry `pos_score`, `neg_score` and `margin`. The chart tables read the scores
several times; pass a written table (see `session.materialise`) when scoring is costly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom.functions.text import format_passage, format_query
from pairloom.operators.encode import Encoder
from pairloom.operators.score import triplet_scores
from pairloom.schema import require_columns
from pairloom.session import materialise

# The goals of the training method.
TARGET_NEGATIVE_MEAN = 0.15
TARGET_MARGIN_MEAN = 0.7

SERIES = {"positive": "pos_score", "negative": "neg_score", "margin": "margin"}


def eval_report(scores: DataFrame) -> DataFrame:
    """One row of ten metrics from one aggregate.

    The variance over positives and negatives together follows from the two variances and
    means, as both have the same count, so the rows are not doubled.
    """
    require_columns(scores, SERIES.values())
    moments = scores.agg(
        F.avg("pos_score").alias("pos_cosine_similarity_mean"),
        F.stddev_pop("pos_score").alias("pos_cosine_similarity_std"),
        F.avg("neg_score").alias("neg_cosine_similarity_mean"),
        F.stddev_pop("neg_score").alias("neg_cosine_similarity_std"),
        F.avg("margin").alias("margin_mean"),
        F.stddev_pop("margin").alias("margin_std"),
        F.var_pop("pos_score").alias("pos_uniformity"),
        F.var_pop("neg_score").alias("neg_uniformity"),
        F.count(F.lit(1)).alias("total_samples"),
    )
    half_gap = (F.col("pos_cosine_similarity_mean") - F.col("neg_cosine_similarity_mean")) / 2
    overall = (F.col("pos_uniformity") + F.col("neg_uniformity")) / 2 + half_gap * half_gap
    return moments.withColumn("overall_uniformity", overall)


def evaluate(triplets: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """The report for text triplets: format, encode, score and aggregate in one pass."""
    return eval_report(triplet_scores(triplets, encoder))


def eval_targets(report: DataFrame) -> DataFrame:
    """Whether the report meets the goals for the negative mean and the margin."""
    return report.select(
        "neg_cosine_similarity_mean",
        "margin_mean",
        (F.col("neg_cosine_similarity_mean") <= TARGET_NEGATIVE_MEAN).alias("negative_ok"),
        (F.col("margin_mean") >= TARGET_MARGIN_MEAN).alias("margin_ok"),
    )


def uniformity_bars(report: DataFrame) -> DataFrame:
    """The three variances as rows."""
    return report.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("series"), F.col(column).alias("variance"))
                    for name, column in (
                        ("positive", "pos_uniformity"),
                        ("negative", "neg_uniformity"),
                        ("overall", "overall_uniformity"),
                    )
                ]
            )
        )
    )


def _unpivot(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    return scores.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(n).alias("series"), F.col(SERIES[n]).alias("x")) for n in names]
            )
        )
    )


def _pick(names: Sequence[str], value) -> Column:
    """`value(name)` of the row's series."""
    chosen = F.lit(None)
    for name in names:
        chosen = F.when(F.col("series") == name, value(name)).otherwise(chosen)
    return chosen


def score_histogram(scores: DataFrame, bins: int = 50) -> DataFrame:
    """Equal bins over each series' own range, the last bin closed, empty bins kept.

    A series with one single value gets a range of one around it.
    """
    names = list(SERIES)
    limits = scores.agg(
        F.struct(
            *[F.min(SERIES[n]).alias(f"{n}_lo") for n in names],
            *[F.max(SERIES[n]).alias(f"{n}_hi") for n in names],
        )
    ).scalar()

    def with_limits(df: DataFrame) -> DataFrame:
        lo, hi = _pick(names, lambda n: limits[f"{n}_lo"]), _pick(names, lambda n: limits[f"{n}_hi"])
        pad = F.when(lo == hi, F.lit(0.5)).otherwise(F.lit(0.0))
        return df.withColumns({"lo": lo - pad, "hi": hi + pad})

    share = (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    counts = (
        with_limits(_unpivot(scores, names))
        .withColumn("bin", F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int"))
        .groupBy("series", "bin")
        .agg(F.count(F.lit(1)).alias("found"))
    )
    frame = scores.sparkSession.range(len(names) * bins).select(
        F.element_at(
            F.array(*[F.lit(n) for n in names]), (F.floor(F.col("id") / bins) + 1).cast("int")
        ).alias("series"),
        F.pmod("id", F.lit(bins)).cast("int").alias("bin"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        with_limits(frame)
        .join(counts, ["series", "bin"], "left")
        .select(
            "series",
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("bin_from"),
            (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_to"),
            F.coalesce("found", F.lit(0)).cast("bigint").alias("n_rows"),
        )
    )


LEVEL_BINS = 1 << 16


SMALL_SLIVER = 1 << 16


def exact_quantiles(
    long: DataFrame, probabilities: Sequence[float], bins: int = LEVEL_BINS, small: int = SMALL_SLIVER
) -> DataFrame:
    """(series, probability, value): exact linear-interpolated quantiles of (series, x).

    Spark's `percentile` holds all distinct values of a group in one task. Here the range of a
    series is cut into equal bins, the bin that holds a wanted rank becomes the new range,
    from its least to its largest value, and so on until it has one value or at most `small`
    rows, which are then ordered. The scores are written once and read once per level. The
    number of series must be small; broadcast tables have a few rows per series.
    """
    rows = materialise(long.where(F.col("x").isNotNull()).select("series", "x"), "quantiles")
    limits = rows.groupBy("series").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")
    )
    limits = materialise(limits, "limits")
    wanted = limits.select(
        "series",
        F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability"),
        (F.col("n") - 1).alias("last"),
    ).withColumn("position", F.col("probability") * F.col("last"))
    ranks = wanted.select(
        "series",
        F.explode(F.array(F.floor("position"), F.ceil("position"))).alias("rank"),
    ).distinct()
    hits = materialise(
        ranks.join(limits, "series").select(
            "series", "rank", F.col("rank").alias("left_rank"), "lo", "hi", F.col("n").alias("size")
        ),
        "ranks",
    )
    sliver = ["series", "lo", "hi"]

    def within(slivers: DataFrame) -> DataFrame:
        near = rows.join(F.broadcast(slivers.select(*sliver).distinct()), "series")
        return near.where(F.col("x").between(F.col("lo"), F.col("hi")))

    def reached(sizes: DataFrame, slivers: DataFrame, order: str) -> DataFrame:
        """The groups of `sizes` that hold the wanted ranks, and the ranks inside them."""
        upto = F.sum("found").over(
            W.partitionBy(*sliver).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        )
        placed = sizes.withColumn("before", upto - F.col("found"))
        left = F.col("left_rank")
        inside = (left >= F.col("before")) & (left < F.col("before") + F.col("found"))
        return placed.join(F.broadcast(slivers), sliver).where(inside)

    wide = (F.col("lo") < F.col("hi")) & (F.col("size") > small)
    while not hits.where(wide).isEmpty():
        scaled = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
        sizes = (
            within(hits.where(wide)).withColumn("bin", F.least(F.lit(bins - 1), scaled))
            .groupBy(*sliver, "bin")
            .agg(F.count(F.lit(1)).alias("found"), F.min("x").alias("low"), F.max("x").alias("high"))
        )
        narrowed = reached(sizes, hits.where(wide), "bin").select(
            "series", "rank", (F.col("left_rank") - F.col("before")).alias("left_rank"),
            F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("found").alias("size"),
        )
        hits = materialise(narrowed.unionByName(hits.where(~wide)), "ranks")
    counted = within(hits).groupBy(*sliver, "x").agg(F.count(F.lit(1)).alias("found"))
    values = reached(counted, hits, "x").select("series", "rank", "x")
    low = values.select("series", F.col("rank").alias("low_rank"), F.col("x").alias("low"))
    high = values.select("series", F.col("rank").alias("high_rank"), F.col("x").alias("high"))
    return (
        wanted.withColumns(
            {
                "low_rank": F.floor("position"),
                "high_rank": F.ceil("position"),
            }
        )
        .join(low, ["series", "low_rank"])
        .join(high, ["series", "high_rank"])
        .select(
            "series",
            "probability",
            (
                F.col("low")
                + (F.col("high") - F.col("low")) * (F.col("position") - F.col("low_rank"))
            ).alias("value"),
        )
    )


def _quartiles(long: DataFrame) -> DataFrame:
    def at(p: float, name: str) -> Column:
        return F.max(F.when(F.col("probability") == p, F.col("value"))).alias(name)

    table = exact_quantiles(long, [0.25, 0.5, 0.75])
    table = table.groupBy("series").agg(at(0.25, "q1"), at(0.5, "median"), at(0.75, "q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return table.withColumns({"fence_low": F.col("q1") - reach, "fence_high": F.col("q3") + reach})


def score_boxplot(scores: DataFrame) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR and outlier counts of positives and negatives."""
    long = _unpivot(scores, ["positive", "negative"])
    quartiles = _quartiles(long)
    x = F.col("x")
    inside = x.between(F.col("fence_low"), F.col("fence_high"))
    return (
        long.join(F.broadcast(quartiles), "series")
        .groupBy("series")
        .agg(
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, x)).alias("lowest"),
            F.max(F.when(inside, x)).alias("highest"),
            F.count_if(x < F.col("fence_low")).alias("n_low_outliers"),
            F.count_if(x > F.col("fence_high")).alias("n_high_outliers"),
        )
        .select(
            "series", "q1", "median", "q3",
            F.least("q1", "lowest").alias("whisker_low"),
            F.greatest("q3", "highest").alias("whisker_high"),
            "n_low_outliers", "n_high_outliers",
        )
    )


def score_outliers(scores: DataFrame) -> DataFrame:
    """(series, x) of the points a box plot draws outside the whiskers."""
    long = _unpivot(scores, ["positive", "negative"])
    fences = _quartiles(long).select("series", "fence_low", "fence_high")
    return (
        long.join(F.broadcast(fences), "series")
        .where(~F.col("x").between(F.col("fence_low"), F.col("fence_high")))
        .select("series", "x")
    )


def sample_scores(
    triplets: DataFrame, n: int = 1, encoder: Encoder | None = None, key: str = "row_key",
) -> DataFrame:
    """The first n triplets by key with their formatted texts and scores.

    Only those n are encoded; n is meant to be small.
    """
    first = triplets.orderBy(key).limit(n)
    return first.join(triplet_scores(first, encoder, key=key), key).select(
        key,
        format_query("anchor").alias("query_text"),
        format_passage("positive").alias("positive_text"),
        format_passage("negative").alias("negative_text"),
        "pos_raw", "pos_score", "neg_raw", "neg_score", "margin",
    )
