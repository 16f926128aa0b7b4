"""Views of the given tables in the shapes the operators read.

All views cover whole tables and whole texts, and join on unique keys only. Triplets are written
as tables first, as several operators read their input more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.math import sigmoid
from pairloom.operators.negatives import candidate_lists
from pairloom.operators.ordering import assign_batches
from pairloom.operators.score import pair_cosine
from pairloom.session import materialise
from pairloom.sources.files import number_lines

BATCH_SIZE = 16
LIST_SIZE = 8
TEACHER_SLOPE = 4.0
RUN_USERS = 10
ATTEMPT_DAYS = 15
EPOCH_DAYS = 5
FAILURE_VALUE = 250
POLL_SECONDS = 6 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_neighbour(
    df: DataFrame, column: str, step: int, out: str, key: str = "row_key", within: tuple[str, ...] = ()
) -> DataFrame:
    """Add `column` of the row whose `key` is `step` higher and that agrees in `within`; a row
    without one takes its anchor."""
    other = df.select((F.col(key) - step).alias(key), *within, F.col(column).alias("_other"))
    # Both sides hold the whole table: merge them, which also spreads the rows evenly.
    other = other.hint("merge")
    found = F.coalesce("_other", "anchor")
    return df.join(other, [key, *within], "left").withColumn(out, found).drop("_other")


def dialogue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows them."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("anchor")
    )
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("positive")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.concat_ws(":", "conv_id", "turn").alias("row_key"), "anchor", "positive", "conv_id", "turn"
    )


def dialogue_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue pairs with the answer of the next conversation as negative."""
    pairs = dialogue_pairs(spark, sf_dir)
    near = _with_neighbour(pairs, "positive", 1, "negative", "conv_id", ("turn",))
    return materialise(near.drop("turn"), "dialogues")


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of a document and all the rest of its text, or the whole text if
    there is no rest."""
    first = F.split_part("text", F.lit("."), F.lit(1))
    rest = F.expr("substr(text, length(split_part(text, '.', 1)) + 2)")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_key"),
        first.alias("anchor"),
        F.when(F.length(rest) > 0, rest).otherwise(F.col("text")).alias("positive"),
        "lang",
    )


def _document_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = document_pairs(spark, sf_dir).drop("lang")
    return _with_neighbour(pairs, "positive", 1, "negative")


def document_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document pairs with the rest of the next document as negative."""
    return materialise(_document_triplets(spark, sf_dir), "documents")


def supervised(spark: SparkSession, sf_dir: str, dialogues: DataFrame | None = None) -> DataFrame:
    """Dialogue triplets as the supervised source: four files, up to three negatives."""
    return (dialogue_triplets(spark, sf_dir) if dialogues is None else dialogues).select(
        "row_key",
        "anchor",
        "positive",
        F.col("negative").alias("negative_1"),
        F.col("anchor").alias("negative_2"),
        F.col("positive").alias("negative_3"),
        F.format_string("f%d_supervised.csv", F.col("conv_id") % 4).alias("source_file"),
    )


def detailed(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """Document triplets as the detailed-similarity source; read `once`, they need no table."""
    triplets = _document_triplets(spark, sf_dir) if once else document_triplets(spark, sf_dir)
    return triplets.select(
        "row_key",
        "anchor",
        F.col("positive").alias("original_positive"),
        F.col("negative").alias("best_other_positive"),
        F.lit("detailed_top20.csv").alias("source_file"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources projected and united, with a unique text key."""
    def keyed(df: DataFrame, prefix: str) -> DataFrame:
        return df.withColumn("row_key", F.concat(F.lit(prefix), F.col("row_key").cast("string")))

    left = supervised(spark, sf_dir).select(
        "row_key", "anchor", "positive", F.col("negative_1").alias("negative"), "source_file",
        F.lit("supervised").alias("source_kind"),
    )
    right = detailed(spark, sf_dir).select(
        "row_key", "anchor", F.col("original_positive").alias("positive"),
        F.col("best_other_positive").alias("negative"), "source_file",
        F.lit("detailed").alias("source_kind"),
    )
    return keyed(left, "c").unionByName(keyed(right, "d"))


def vector_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the next two vectors as positive and negative."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_key"), F.col("embedding").alias("anchor")
    )
    near = _with_neighbour(vectors, "anchor", 1, "positive")
    return materialise(_with_neighbour(near, "anchor", 2, "negative"), "vectors")


def vector_lists(spark: SparkSession, sf_dir: str, k: int = LIST_SIZE) -> DataFrame:
    """Candidate lists of vectors: (qid, slot, query_vec, passage_vec)."""
    lists = candidate_lists(vector_triplets(spark, sf_dir), k, carry=["anchor"])
    return lists.select(
        F.col("row_key").alias("qid"), "slot", F.col("anchor").alias("query_vec"),
        F.col("passage").alias("passage_vec"),
    )


def batched_lists(spark: SparkSession, sf_dir: str, k: int = LIST_SIZE) -> DataFrame:
    """`vector_lists` with a batch and a teacher: a steeper score of the whole vectors."""
    batches = assign_batches(
        table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid")), BATCH_SIZE, "qid"
    ).select("qid", "batch_id")
    scored = pair_cosine(vector_lists(spark, sf_dir, k), "query_vec", "passage_vec")
    teacher = sigmoid(F.col("cos_raw") * TEACHER_SLOPE)
    return scored.withColumn("teacher", teacher).drop("cos_raw", "score").join(batches, "qid")


def score_lists(spark: SparkSession, sf_dir: str, k: int = LIST_SIZE) -> DataFrame:
    """(batch_id, qid, slot, teacher, student) of the vector lists."""
    scored = pair_cosine(batched_lists(spark, sf_dir, k), "query_vec", "passage_vec")
    return scored.select("batch_id", "qid", "slot", "teacher", F.col("score").alias("student"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training-log lines of runs and attempts."""
    day = F.dayofmonth("ts") - 1
    event, value = F.col("event_type"), F.col("value")
    failure = (
        F.when(F.col("event_id") % 4 == 0, F.lit("RuntimeError: CUDA out of memory"))
        .when(F.col("event_id") % 4 == 1, F.lit("cuda driver error: 3"))
        .when(F.col("event_id") % 4 == 2, F.lit("ModuleNotFoundError: No module named x"))
        .otherwise(F.lit("ValueError exception raised"))
    )
    line = (
        F.when(
            event == "view",
            F.concat(F.lit("Training: "), F.pmod(F.floor(value), F.lit(101)).cast("string"), F.lit("%")),
        )
        .when(event == "click", F.concat(F.lit("[Train] Loss: "), value.cast("string")))
        .when(
            event == "signup",
            F.concat(
                F.lit("[Epoch "),
                (F.floor((day % ATTEMPT_DAYS) / EPOCH_DAYS) + 1).cast("string"),
                F.lit("/3]"),
            ),
        )
        .when(
            event == "purchase",
            F.when(F.col("event_id") % 50 == 0, F.lit("학습 완료!")).otherwise(F.lit("batch done")),
        )
        .otherwise(F.when(value > FAILURE_VALUE, failure).otherwise(F.lit("retry scheduled")))
    )
    lines = table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("run-"), F.floor(F.col("user_id") / RUN_USERS).cast("string")).alias("run_id"),
        F.floor(day / ATTEMPT_DAYS).cast("int").alias("attempt"),
        F.col("ts").cast("timestamp").alias("ts"),
        line.alias("line"),
    )
    return number_lines(lines, ["run_id", "attempt"], "event_id").select(
        "run_id", "attempt", "line_no", "ts", "line"
    )


def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as batch results of runs: one epoch per day."""
    event = F.col("event_type")
    skipped = event == "error"
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / RUN_USERS).cast("string").alias("run_id"),
        F.when(event.isin("view", "signup"), F.lit("val")).otherwise(F.lit("train")).alias("phase"),
        F.dayofmonth("ts").cast("bigint").alias("epoch"),
        F.col("event_id").alias("batch_id"),
        F.when(~skipped, F.log1p("value")).alias("loss"),
        F.when(skipped, F.lit("skipped")).otherwise(F.lit("ok")).alias("status"),
    )
