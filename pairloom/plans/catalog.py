"""Registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.functions.math import sigmoid
from pairloom.operators import (
    distil, epochs, evaluate, fit, loss, negatives, ordering, pairs, prepare, retrieval, score, sketches,
)
from pairloom.operators.encode import DEFAULT_DIM, encode, hashed_encoder, projected_encoder
from pairloom.plans import views
from pairloom import schema
from pairloom.session import discard, discard_path, materialise, shared_path, shuffles_dropped
from pairloom.sources import files, prepared, sinks
from pairloom.streaming import monitor
from pairloom.streaming.rules import REFERENCE_RULES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def digest(name: str) -> Column:
    """Short stand-in for a whole text in a result."""
    return F.md5(name).alias(name)


# Sources and sinks


def _write_packed(frame: DataFrame, path: str) -> None:
    """A folder of gzip files: whole texts as plain CSV would be the most that a query keeps."""
    writer = sinks.csv_writer(frame).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    with shuffles_dropped(frame.sparkSession):
        # a gzip file is read by one task
        writer.option("maxRecordsPerFile", 1 << 16).csv(path)


def _write_supervised(spark, sf_dir) -> str:
    """Four files with their own column order and negatives; returns their pattern."""
    dialogues = views.dialogue_triplets(spark, sf_dir)
    frame = views.supervised(spark, sf_dir, dialogues)
    layouts = {
        "f0_supervised.csv": ["anchor", "positive", "negative_1"],
        "f1_supervised.csv": ["positive", "negative_2", "anchor", "negative_1"],
        "f2_supervised.csv": ["negative_3", "negative_1", "positive", "negative_2", "anchor"],
        "f3_supervised.csv": ["anchor", "positive"],
    }
    folder = shared_path(spark, "supervised")
    for name, columns in layouts.items():
        one_file = frame.where(F.col("source_file") == name).select(*columns)
        _write_packed(one_file, f"{folder}/{name}")
    discard(dialogues)
    return f"{folder}/*_supervised.csv"


def _write_detailed(spark, sf_dir) -> str:
    path = f"{shared_path(spark, 'detailed')}/detailed_top20.csv"
    frame = views.detailed(spark, sf_dir, once=True).select(
        "best_other_positive", "anchor", F.length("anchor").alias("rank"), "original_positive"
    )
    _write_packed(frame, path)
    return path


@query
def scan_supervised(spark, sf_dir):
    return files.read_supervised(spark, _write_supervised(spark, sf_dir))


@query
def scan_detailed(spark, sf_dir):
    return files.read_detailed(spark, _write_detailed(spark, sf_dir))


@query
def prepare_versions(spark, sf_dir):
    """CSV sources to split and versioned triplets; the file without negatives drops out."""
    supervised, detailed = _write_supervised(spark, sf_dir), _write_detailed(spark, sf_dir)

    def drop_sources() -> None:
        for path in (supervised, detailed):
            discard_path(spark, path.rpartition("/")[0])

    return prepared.prepare(spark, supervised, detailed, shared_path(spark, "versions"), after_read=drop_sources)


@query
def read_triplets(spark, sf_dir):
    """Raw triplets with copies from CSV, given unique keys."""
    path = shared_path(spark, "triplets.csv")
    sinks.csv_writer(
        views.document_pairs(spark, sf_dir).select(
            "anchor", "positive", F.col("lang").alias("negative")
        )
    ).csv(path)
    found = files.read_triplets(spark, path)
    return found.select("row_key", digest("anchor"), digest("positive"), "negative")


@query
def write_splits(spark, sf_dir):
    path = shared_path(spark, "versions")
    sinks.write_splits(ordering.split_versions(views.sources(spark, sf_dir)), path)
    return spark.read.parquet(path).select(
        "data_version", "split", "row_key", "source_kind", digest("positive"), digest("negative")
    )


@query
def scan_version_split(spark, sf_dir):
    path = shared_path(spark, "versions")
    sinks.write_splits(ordering.split_versions(views.sources(spark, sf_dir)), path)
    found = files.read_version_split(spark, path, "supervised_with_detailed", "train")
    return found.select("row_key", "source_kind", digest("anchor"))


@query
def write_csv_splits(spark, sf_dir):
    """Six CSV data sets; one of them read back as triplets."""
    path = shared_path(spark, "csv-versions")
    sinks.write_csv_splits(ordering.split_versions(views.sources(spark, sf_dir)), path)
    train = sinks.split_folder(path, "supervised_with_detailed", "train")
    found = files.read_triplets(spark, train)
    return found.select(digest("anchor"), digest("positive"), digest("negative"))


@query
def write_report(spark, sf_dir):
    path = shared_path(spark, "report")
    report = _rounded_report(evaluate.eval_report(_vector_scores(spark, sf_dir)))
    sinks.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query
def log_stream(spark, sf_dir):
    """Rolled log files read as a stream to the end."""
    source, target = shared_path(spark, "log"), shared_path(spark, "log-out")
    views.log_lines(spark, sf_dir).repartitionByRange(4, "ts").write.parquet(source)
    (
        files.stream_log(spark, source, files_per_trigger=2)
        .writeStream.option("checkpointLocation", shared_path(spark, "log-state"))
        .trigger(availableNow=True)
        .start(target, format="parquet")
        .awaitTermination()
    )
    return files.read_log(spark, target).select("run_id", "attempt", "line_no", "line")


# Projection, union, text


@query
def project_supervised(spark, sf_dir):
    return prepare.project_supervised(views.supervised(spark, sf_dir))


@query
def project_detailed(spark, sf_dir):
    return prepare.project_detailed(views.detailed(spark, sf_dir)).select(
        digest("anchor"), digest("positive"), digest("negative"), "source_kind"
    )


@query
def union_sources(spark, sf_dir):
    both = prepare.union_sources(views.supervised(spark, sf_dir), views.detailed(spark, sf_dir))
    return both.select(
        digest("anchor"), digest("positive"), digest("negative"), "source_file", "source_kind"
    )


@query
def source_report(spark, sf_dir):
    with_path = views.sources(spark, sf_dir).withColumn(
        "source_file", F.concat(F.lit("/data/"), "source_file")
    )
    return prepare.source_report(with_path)


@query
def split_report(spark, sf_dir):
    return prepare.split_report(ordering.split_versions(views.sources(spark, sf_dir)))


@query
def format_pairs(spark, sf_dir):
    formatted = pairs.format_pairs(views.dialogue_triplets(spark, sf_dir))
    return formatted.select("row_key", "query_text", "positive_text", "negative_text")


@query
def format_pairs_by_language(spark, sf_dir):
    """The language tag taken from a column."""
    triplets = views.document_pairs(spark, sf_dir).withColumn("negative", F.col("anchor"))
    tag = F.concat(F.lit("("), "lang", F.lit(")"))
    formatted = pairs.format_pairs(triplets, tag)
    return formatted.select("row_key", "query_text", digest("positive_text"))


@query
def label_pairs(spark, sf_dir):
    return pairs.label_pairs(views.document_triplets(spark, sf_dir)).select(
        "row_key", "side", "query_text", digest("passage_text"), "label"
    )


@query
def pair_text(spark, sf_dir):
    return pairs.label_pairs(views.dialogue_triplets(spark, sf_dir)).select(
        "row_key", "side", "pair_text"
    )


def _with_missing(spark, sf_dir) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents")
    labels = views.table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_key"),
        F.col("lang").alias("anchor"),
        F.col("source").alias("positive"),
        F.col("quality").cast("string").alias("negative"),
    )


@query
def null_policy(spark, sf_dir):
    return schema.apply_null_policy(_with_missing(spark, sf_dir), "literal")


@query
def null_drop(spark, sf_dir):
    return schema.apply_null_policy(_with_missing(spark, sf_dir), "drop")


@query
def clip_tokens(spark, sf_dir):
    return (
        views.table(spark, sf_dir, "documents")
        .select("doc_id", text.clip_tokens("text", 256).alias("clip"))
        .select("doc_id", F.md5("clip.text").alias("clipped"), "clip.n_tokens", "clip.was_clipped")
    )


@query
def null_report(spark, sf_dir):
    """Rows the drop policy keeps and drops."""
    return schema.null_report(_with_missing(spark, sf_dir))


# Order, samples, splits, batches


def _documents(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", "lang")


@query
def dense_index(spark, sf_dir):
    return ordering.dense_index(_documents(spark, sf_dir), "doc_id", total="n_rows")


@query
def sample_n(spark, sf_dir):
    return ordering.sample_n(_documents(spark, sf_dir), 300, "doc_id")


@query
def split_exact(spark, sf_dir):
    return ordering.split_exact(_documents(spark, sf_dir), key="doc_id")


@query
def split_exact_grouped(spark, sf_dir):
    """Exact shares of the distinct first sentences; equal ones stay together."""
    pairs_table = views.document_pairs(spark, sf_dir)
    return ordering.split_exact(pairs_table, group_key="anchor").select("row_key", "split")


@query
def split_hash(spark, sf_dir):
    return ordering.split_hash(_documents(spark, sf_dir), key="doc_id")


@query
def split_hash_grouped(spark, sf_dir):
    """All documents with the same first sentence land in one split."""
    return ordering.split_hash(views.document_pairs(spark, sf_dir), group_key="anchor").select(
        "row_key", "split"
    )


@query
def dataset_versions(spark, sf_dir):
    return ordering.split_versions(views.sources(spark, sf_dir)).select(
        "row_key", "source_kind", "split", "data_version"
    )


@query
def assign_batches(spark, sf_dir):
    return ordering.assign_batches(_documents(spark, sf_dir), 16, "doc_id", epoch=1)


# Negatives and candidate lists


@query
def random_negatives(spark, sf_dir):
    found = negatives.random_negatives(views.document_triplets(spark, sf_dir), 7)
    return found.select("row_key", "draw", "neg_key", digest("neg_positive"), digest("neg_negative"))


@query
def random_negatives_other_anchor(spark, sf_dir):
    found = negatives.random_negatives(
        views.document_triplets(spark, sf_dir), 7, exclude_same_anchor=True
    )
    return found.select("row_key", "draw", "neg_key")


@query
def passage_pool(spark, sf_dir):
    return negatives.passage_pool(views.document_triplets(spark, sf_dir)).select(
        "pid", digest("passage")
    )


def _keyed_documents(spark, sf_dir) -> DataFrame:
    """Document triplets whose passages are content keys: lists then move no texts."""
    return views.document_triplets(spark, sf_dir).withColumns(
        {"positive": F.md5("positive"), "negative": F.md5("negative")}
    )


@query
def fill_candidates(spark, sf_dir):
    """Lists without drawn rows, filled from the pool."""
    triplets = _keyed_documents(spark, sf_dir)
    lists = negatives.query_lists(triplets, 0)
    pool = negatives.passage_pool(triplets, total="n_pool")
    return negatives.explode_lists(negatives.fill_candidates(lists, pool, 6))


@query
def repeat_candidates(spark, sf_dir):
    lists = negatives.query_lists(_keyed_documents(spark, sf_dir), 0)
    return negatives.explode_lists(negatives.repeat_candidates(lists, 7))


@query
def candidate_lists(spark, sf_dir):
    """Lists of 15: an odd size, so every list is filled up from the pool by one."""
    return negatives.candidate_lists(_keyed_documents(spark, sf_dir), 15)


@query
def candidate_lists_other_anchor(spark, sf_dir):
    """Lists that neither draw nor fill with what belongs to the query's own anchor."""
    return negatives.candidate_lists(
        _keyed_documents(spark, sf_dir), 15, exclude_same_anchor=True
    )


@query
def candidate_stats(spark, sf_dir):
    lists = negatives.query_lists(_keyed_documents(spark, sf_dir), 3)
    return rounded(negatives.candidate_stats(lists), "mean_candidates")


@query
def mined_negatives(spark, sf_dir):
    """The four passages nearest to each anchor that are no positive of it, by an index of cells."""
    triplets = views.vector_triplets(spark, sf_dir).withColumns({"anchor_vector": F.col("anchor"), "positive_vector": F.col("positive")})
    found = retrieval.mined_negatives(triplets, 4, shared_path(spark, "mined"))
    return rounded(found, "score")


@query
def retrieve_passages(spark, sf_dir):
    """The ten nearest of all vectors for every twentieth, from a written index."""
    table = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    path = shared_path(spark, "index")
    retrieval.build_index(table, path)
    asked = table.where(F.col("id") % 20 == 0)
    own = asked.select(F.col("id").alias("query_id"), "id")
    found = retrieval.search(retrieval.open_index(spark, path), asked, 10, barred=own)
    return rounded(found, "score")


@query
def top_labelled_vectors(spark, sf_dir):
    """The three vectors of each label with the largest first component."""
    table = views.table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("score"))
    best = retrieval.top_k(table, ["label"], [F.col("score").desc(), F.col("vec_id")], 3)
    return rounded(best.select("label", "rank", "vec_id", "score"), "score")


@query
def merged_sketches(spark, sf_dir):
    """Sketches per language and source, stored and merged per language: whether the distinct
    texts and the median length are within the stated errors of the exact ones."""
    docs = views.table(spark, sf_dir, "documents").select("lang", "source", "text", "n_chars")
    stored = materialise(sketches.sketch(docs, ["lang", "source"], "text", "n_chars"), "sketches")
    found = sketches.estimates(sketches.merge_sketches(stored, ["lang"]), [0.5]).select(
        "lang", "n", "n_distinct", F.col("quantiles")[0].alias("median")
    )
    exact = docs.join(F.broadcast(found), "lang").groupBy("lang", "n").agg(  # one row per language
        F.count_distinct("text").alias("d"), F.first("n_distinct").alias("n_distinct"),
        F.avg((F.col("n_chars") < F.col("median")).cast("int")).alias("below"),
        F.avg((F.col("n_chars") <= F.col("median")).cast("int")).alias("upto"),
    )
    slack = sketches.RANK_ERROR + 1 / F.col("n")
    return exact.select(
        "lang", "n", (F.abs(F.col("n_distinct") / F.col("d") - 1) <= sketches.DISTINCT_ERROR).alias("distinct_holds"),
        ((F.col("below") - slack <= 0.5) & (F.col("upto") + slack >= 0.5)).alias("median_holds"),
    )


# Vectors and scores


@query
def encode_hashed(spark, sf_dir):
    encoded = encode(views.table(spark, sf_dir, "documents"), "text")
    return rounded(
        encoded.select("doc_id", F.posexplode("vector").alias("lane", "value")).where(
            F.col("value") != 0
        ),
        "value",
    )


@query
def pair_cosine(spark, sf_dir):
    scored = score.pair_cosine(views.vector_triplets(spark, sf_dir), "anchor", "positive")
    return rounded(scored.select("row_key", "cos_raw", "score"), "cos_raw", "score")


@query
def pair_cosine_relu(spark, sf_dir):
    scored = score.pair_cosine(views.vector_triplets(spark, sf_dir), "anchor", "negative", False)
    return rounded(scored.select("row_key", "cos_raw", "score"), "cos_raw", "score")


SCORES = ("pos_raw", "neg_raw", "pos_score", "neg_score", "margin")


@query
def triplet_scores(spark, sf_dir):
    """Whole texts encoded and scored."""
    scores = score.triplet_scores(views.document_triplets(spark, sf_dir))
    return rounded(scores, *SCORES, digits=8).select("row_key", *SCORES)


def _triplet_vectors(spark, sf_dir) -> DataFrame:
    names = {"anchor": "anchor_vec", "positive": "positive_vec", "negative": "negative_vec"}
    return views.vector_triplets(spark, sf_dir).withColumnsRenamed(names)


def _vector_scores(spark, sf_dir) -> DataFrame:
    return score.vector_triplet_scores(_triplet_vectors(spark, sf_dir))


@query
def vector_triplet_scores(spark, sf_dir):
    scores = rounded(_vector_scores(spark, sf_dir), *SCORES, digits=8)
    return scores.select("row_key", *SCORES)


@query
def attach_vectors(spark, sf_dir):
    """Vectors looked up by id for lists of ids, then scored."""
    base = views.table(spark, sf_dir, "embeddings")
    vectors = base.select("vec_id", F.col("embedding").alias("vector"))
    ids = views.vector_triplets(spark, sf_dir).select(
        "row_key", F.col("row_key").alias("query_id"), F.pmod("row_key", F.lit(7)).alias("passage_id")
    )
    with_query = score.attach_vectors(ids, vectors, "query_id", "query_vec", ["row_key"], min_rows=50)
    both = score.attach_vectors(
        with_query, vectors, "passage_id", "passage_vec", ["row_key"], min_rows=50
    )
    return rounded(score.list_scores(both), "student")


@query
def list_scores(spark, sf_dir):
    return rounded(score.list_scores(views.vector_lists(spark, sf_dir)), "student")


def _dialogue_candidates(spark, sf_dir) -> DataFrame:
    triplets = views.dialogue_triplets(spark, sf_dir)
    lists = negatives.candidate_lists(triplets, 8, carry=["anchor"])
    return lists.withColumnRenamed("anchor", "query")


@query
def teacher_scores(spark, sf_dir):
    names = ["jaccard", "coverage", "length_ratio", "logit", "teacher"]
    scored = score.teacher_scores(_dialogue_candidates(spark, sf_dir))
    return rounded(scored.select("row_key", "slot", *names), *names)


@query
def teacher_scores_with(spark, sf_dir):
    """A user scorer: the ratio of the two text lengths."""

    def by_length(pairs):
        a, b = pairs["query"].str.len(), pairs["passage"].str.len()
        return a / (a + b)

    scored = score.teacher_scores_with(_dialogue_candidates(spark, sf_dir), by_length)
    return rounded(scored.select("row_key", "slot", "teacher"), "teacher")


# Losses


@query
def listwise_softmax(spark, sf_dir):
    shares = loss.listwise_softmax(views.score_lists(spark, sf_dir))
    return rounded(shares.select("batch_id", "qid", "slot", "p", "q"), "p", "q")


@query
def query_losses(spark, sf_dir):
    names = ["kl", "pos_mean", "neg_mean", "neg_sum"]
    return rounded(loss.query_losses(views.score_lists(spark, sf_dir)), *names)


@query
def loss_kl(spark, sf_dir):
    parts = loss.batch_losses(views.score_lists(spark, sf_dir))
    return rounded(parts.select("batch_id", "kl"), "kl")


@query
def loss_margin(spark, sf_dir):
    parts = loss.batch_losses(views.score_lists(spark, sf_dir))
    return rounded(parts.select("batch_id", "margin_loss"), "margin_loss")


@query
def loss_penalty(spark, sf_dir):
    parts = loss.batch_losses(views.score_lists(spark, sf_dir))
    return rounded(parts.select("batch_id", "penalty"), "penalty")


@query
def distill_loss(spark, sf_dir):
    names = ["kl", "margin_loss", "penalty", "total"]
    return rounded(loss.distill_loss(views.score_lists(spark, sf_dir)), *names)


@query
def distil_text_loss(spark, sf_dir):
    """Losses of whole dialogues: encoded once, listed, scored by the teacher and batched."""
    table = distil.distil_table(views.dialogue_triplets(spark, sf_dir), 8)
    names = ["kl", "margin_loss", "penalty", "total"]
    return rounded(loss.distill_loss(distil.student_scores(table)), *names)


def _pair_features(spark, sf_dir) -> DataFrame:
    labelled = pairs.label_pairs(views.document_triplets(spark, sf_dir))
    return score.with_features(labelled, "query_text", "passage_text").drop(
        "query_text", "passage_text", "pair_text"
    )


@query
def bce_loss(spark, sf_dir):
    logits = _pair_features(spark, sf_dir).withColumn("logit", score.linear_logit())
    return rounded(loss.bce_loss(logits), "bce")


# Epoch metrics


@query
def epoch_loss(spark, sf_dir):
    return rounded(
        epochs.epoch_loss(views.batch_results(spark, sf_dir)), "train_loss", "val_loss"
    )


@query
def epoch_loss_all_batches(spark, sf_dir):
    found = epochs.epoch_loss(views.batch_results(spark, sf_dir), denominator="all")
    return rounded(found, "train_loss", "val_loss")


def _rounded_epochs(spark, sf_dir) -> DataFrame:
    found = epochs.epoch_loss(views.batch_results(spark, sf_dir))
    return found.withColumn("val_loss", F.round("val_loss", 4))


@query
def best_epoch(spark, sf_dir):
    return epochs.best_epoch(_rounded_epochs(spark, sf_dir))


@query
def checkpoint_flags(spark, sf_dir):
    return epochs.checkpoint_flags(_rounded_epochs(spark, sf_dir))


# Evaluation


def _text_report(spark, sf_dir) -> DataFrame:
    return evaluate.evaluate(views.document_triplets(spark, sf_dir))


def _rounded_report(report: DataFrame) -> DataFrame:
    return rounded(report, *[c for c in report.columns if c != "total_samples"])


@query
def eval_report(spark, sf_dir):
    return _rounded_report(_text_report(spark, sf_dir))


@query
def eval_report_projected(spark, sf_dir):
    """The report of a user encoder: the built-in one, its dimensions reversed by a projection."""
    encoder = projected_encoder(hashed_encoder(), np.eye(DEFAULT_DIM)[::-1])
    return _rounded_report(evaluate.evaluate(views.document_triplets(spark, sf_dir), encoder))


@query
def vector_eval_report(spark, sf_dir):
    return _rounded_report(evaluate.eval_report(_vector_scores(spark, sf_dir)))


@query
def eval_targets(spark, sf_dir):
    found = evaluate.eval_targets(_text_report(spark, sf_dir))
    return rounded(found, "neg_cosine_similarity_mean", "margin_mean")


@query
def uniformity_bars(spark, sf_dir):
    return rounded(evaluate.uniformity_bars(_text_report(spark, sf_dir)), "variance")


@query
def score_histogram(spark, sf_dir):
    scores = materialise(_vector_scores(spark, sf_dir), "scores")
    return rounded(evaluate.score_histogram(scores), "bin_from", "bin_to")


@query
def score_boxplot(spark, sf_dir):
    scores = materialise(_vector_scores(spark, sf_dir), "scores")
    return rounded(
        evaluate.score_boxplot(scores), "q1", "median", "q3", "whisker_low", "whisker_high"
    )


@query
def score_outliers(spark, sf_dir):
    scores = materialise(_vector_scores(spark, sf_dir), "scores")
    return rounded(evaluate.score_outliers(scores), "x")


@query
def sample_scores(spark, sf_dir):
    triplets = views.document_triplets(spark, sf_dir)
    found = evaluate.sample_scores(triplets, 5)
    return rounded(found, *SCORES, digits=8).select(
        "row_key", "query_text", digest("positive_text"), digest("negative_text"), *SCORES
    )


# Logs and monitor


@query
def log_rules(spark, sf_dir):
    return monitor.log_rules(views.log_lines(spark, sf_dir)).drop("ts")


@query
def log_progress(spark, sf_dir):
    return monitor.log_progress(views.log_lines(spark, sf_dir)).drop("ts")


@query
def log_tail(spark, sf_dir):
    return monitor.log_tail(views.log_lines(spark, sf_dir), 50).drop("ts")


@query
def log_complete(spark, sf_dir):
    return monitor.log_complete(views.log_lines(spark, sf_dir))


@query
def log_complete_reference(spark, sf_dir):
    return monitor.log_complete(views.log_lines(spark, sf_dir), REFERENCE_RULES)


@query
def log_errors(spark, sf_dir):
    return monitor.log_errors(views.log_lines(spark, sf_dir))


@query
def log_errors_reference(spark, sf_dir):
    return monitor.log_errors(views.log_lines(spark, sf_dir), REFERENCE_RULES)


@query
def log_status(spark, sf_dir):
    return monitor.log_status(views.log_lines(spark, sf_dir))


@query
def error_streaks(spark, sf_dir):
    polls = monitor.poll_status(views.log_lines(spark, sf_dir), poll_seconds=views.POLL_SECONDS)
    return monitor.error_streaks(polls).select(
        "run_id", "attempt", "poll", "status", "error_type", "streak", "halted"
    )


def _monitored(spark, sf_dir) -> DataFrame:
    return monitor.monitor_batch(
        views.log_lines(spark, sf_dir), poll_seconds=views.POLL_SECONDS
    )


@query
def monitor_batch(spark, sf_dir):
    return _monitored(spark, sf_dir)


@query
def missing_runs(spark, sf_dir):
    """Runs that are silent for more than three hours at the end of the whole log."""
    newest = views.table(spark, sf_dir, "events").agg(F.max("ts")).scalar()
    return monitor.missing_runs(_monitored(spark, sf_dir), newest, 3 * 3600)


@query
def recovery_plan(spark, sf_dir):
    plan = monitor.recovery_plan(_monitored(spark, sf_dir))
    return plan.select(
        "run_id", "attempt", "poll", "error_type", F.explode("parameters").alias("name", "setting")
    )


@query
def monitor_stream(spark, sf_dir):
    """The whole log as one stream trigger: the status of every attempt at its end."""
    source, out = shared_path(spark, "log"), shared_path(spark, "status")
    views.log_lines(spark, sf_dir).write.parquet(source)
    statuses = monitor.monitor_stream(files.stream_log(spark, source), silence_seconds=None)
    monitor.write_monitor(
        statuses, f"{out}/status", f"{out}/actions", f"{out}/state", available_now=True
    ).awaitTermination()
    return spark.read.parquet(f"{out}/status").select(
        "run_id", "attempt", "last_line", "status", "error_type", "error_message", "progress",
        "streak", "action",
    )


# Fitting


@query
def fit_teacher(spark, sf_dir):
    """Mean of every feature times the fitted teacher's score. At the optimum it is the mean
    of the feature times the label."""
    featured = materialise(_pair_features(spark, sf_dir), "features")
    fitted = fit.fit_teacher(featured, featured, epochs=1, iterations=300, tolerance=1e-12)
    scored = featured.withColumn(
        "teacher", sigmoid(score.linear_logit(fitted.weights, fitted.bias))
    )
    means = scored.agg(
        *[F.avg(F.col(name) * F.col("teacher")).alias(name) for name in score.FEATURES],
        F.avg("teacher").alias("bias"),
    )
    return rounded(means.unpivot([], means.columns, "feature", "mean"), "mean", digits=3)


@query
def fitted_teacher_scores(spark, sf_dir):
    """Fit a teacher, save it, load it: whether the dialogue candidates keep their scores."""
    featured = materialise(_pair_features(spark, sf_dir), "features")
    path = shared_path(spark, "teacher")
    fitted = fit.fit_teacher(featured, featured, epochs=1)
    fit.save_teacher(fitted, path)
    weights, bias = fit.load_teacher(path)
    candidates = _dialogue_candidates(spark, sf_dir)
    before = score.teacher_scores(candidates, weights=fitted.weights, bias=fitted.bias)
    scored = score.teacher_scores(
        before.withColumnRenamed("teacher", "_before"), weights=weights, bias=bias
    )
    return scored.select("row_key", "slot", (F.col("teacher") == F.col("_before")).alias("kept"))


@query
def fit_student(spark, sf_dir):
    """The first step of a student over all vector lists: the loss of the base vectors."""
    settings = fit.StudentSettings(epochs=1, lr=0.01)
    metrics = fit.fit_student(
        views.batched_lists(spark, sf_dir), dim_in=64, steps_per_epoch=1, settings=settings
    ).metrics
    return rounded(metrics, "loss")


@query
def student_eval_report(spark, sf_dir):
    """Fit a student that is held at its start, save it, load it and report its triplet scores,
    which are those of the base vectors."""
    settings = fit.StudentSettings(epochs=1, lr=0.0)
    fitted = fit.fit_student(
        views.batched_lists(spark, sf_dir), dim_in=64, steps_per_epoch=2, settings=settings,
        batch_size=views.BATCH_SIZE,
    )
    path = shared_path(spark, "student")
    fit.save_student(spark, fitted.weights, path)
    weights = fit.load_student(spark, path)
    return _rounded_report(
        evaluate.eval_report(fit.student_triplet_scores(_triplet_vectors(spark, sf_dir), weights))
    )
