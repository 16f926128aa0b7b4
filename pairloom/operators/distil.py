"""From text triplets to the scored, batched candidate table a student is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import DEFAULT_LANG, format_passage, format_query
from pairloom.operators.encode import DEFAULT_DIM, Encoder, encoded
from pairloom.operators.negatives import candidate_lists
from pairloom.operators.ordering import assign_batches
from pairloom.operators.score import Scorer, list_scores, teacher_scores, teacher_scores_with
from pairloom.operators.skew import salted_join
from pairloom.schema import require_columns
from pairloom.session import materialise


def distil_table(
    df: DataFrame, k: int = 16, batch_size: int = 16, mining: bool = True, seed: int = 42,
    epoch: int = 0, encoder: Encoder | None = None, dim: int = DEFAULT_DIM,
    scorer: Scorer | None = None, weights: dict[str, float] | None = None,
    bias: float | None = None, lang: str = DEFAULT_LANG, key: str = "row_key",
) -> DataFrame:
    """(batch_id, qid, slot, origin, teacher, query_vec, passage_vec) for text triplets.

    Lists are assembled from 128-bit references. Every distinct passage is formatted and
    encoded once and written, and joins the lists once, passages that many lists hold being
    salted. The teacher scores each pair once: `scorer` is a user function, otherwise the
    linear teacher with `weights` and `bias` is used.
    """
    require_columns(df, [key, "anchor", "positive", "negative"])
    batches = assign_batches(df.select(key), batch_size, key, seed, epoch).select(key, "batch_id")
    query = format_query("anchor", lang)
    queries = df.select(
        F.col(key).alias("qid"), query.alias("query"), encoded(query, encoder, dim).alias("query_vec")
    )
    texts = df.select(F.explode(F.array("positive", "negative")).alias("text"))
    texts = texts.where(F.col("text").isNotNull()).select(F.md5("text").alias("ref"), "text")
    distinct = texts.groupBy("ref").agg(F.first("text").alias("text"))
    passage = format_passage("text", lang)
    passages = distinct.select(
        "ref", passage.alias("passage"), encoded(passage, encoder, dim).alias("passage_vec")
    )
    passages = materialise(passages, "passages")
    refs = df.select(key, "anchor", *[F.md5(name).alias(name) for name in ("positive", "negative")])
    refs = materialise(refs.join(batches, key), "distil")
    lists = candidate_lists(refs, k, carry=["batch_id"], mining=mining, seed=seed, key=key).select(
        "batch_id", F.col(key).alias("qid"), "slot", "origin", F.col("passage").alias("ref")
    )
    lists = lists.join(materialise(queries, "queries"), "qid")
    lists = salted_join(lists, passages, ["ref"], ["qid", "slot"], "left").drop("ref")
    if scorer is not None:
        scored = teacher_scores_with(lists, scorer)
    else:
        scored = teacher_scores(lists, weights=weights, bias=bias)
    return scored.select(
        "batch_id", "qid", "slot", "origin", "teacher", "query_vec", "passage_vec"
    )


def student_scores(table: DataFrame, normalize: bool = True) -> DataFrame:
    """(batch_id, qid, slot, teacher, student): the input of the losses."""
    return list_scores(table, normalize).select("batch_id", "qid", "slot", "teacher", "student")
