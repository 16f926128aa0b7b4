"""Plan shapes that must hold at scale."""

import re

import pytest

from __spark_entry__ import queries
from pairloom.operators import ordering, score
from pairloom.plans import views
from pairloom.schema import with_row_key
from pairloom.streaming import monitor

QUERIES = queries()
EAGER = {
    "fit_teacher", "fit_student", "monitor_stream", "log_stream", "fitted_teacher_scores",
    "student_eval_report",
}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_pairing_joins(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_scoring_texts_needs_no_shuffle(spark, sf_dir):
    text = plan(score.triplet_scores(views.document_triplets(spark, sf_dir)))
    assert "Exchange" not in text and text.count("ArrowEvalPython") == 1


def test_hash_split_needs_no_shuffle(spark, sf_dir):
    frame = views.table(spark, sf_dir, "documents")
    assert "Exchange" not in plan(ordering.split_hash(frame, key="doc_id"))


def test_exact_split_labels_rows_in_place(spark, sf_dir):
    frame = views.table(spark, sf_dir, "documents")
    text = plan(ordering.split_exact(frame, key="doc_id"))
    rows = text.split("Subquery")[0]
    assert "Exchange" not in rows and "Window" not in rows
    # Only the labelling pass reads anything but the key.
    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", text))
    assert text.count("text:string") <= 1 and "struct<doc_id:bigint>" in schemas


def test_counting_pass_reads_the_key_only(spark, sf_dir):
    text = plan(ordering.dense_index(views.table(spark, sf_dir, "documents"), "doc_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in text


def test_losses_share_one_shuffle(spark):
    from pairloom.operators import loss

    frame = spark.range(100).selectExpr(
        "id % 3 batch_id", "id % 9 qid", "cast(id as int) slot", "rand(1) teacher", "rand(2) student"
    )
    assert plan(loss.distill_loss(frame)).count("Exchange") == 1


def test_only_bucket_counts_meet_in_one_task(spark, sf_dir):
    text = plan(ordering.dense_index(views.table(spark, sf_dir, "documents"), "doc_id", total="n"))
    lines = text.splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert single and all("HashAggregate(keys=[_bucket" in lines[i + 1] for i in single)


def test_log_status_combines_before_its_shuffle(spark):
    lines = spark.range(100).selectExpr(
        "concat('r', id % 5) run_id", "cast(id % 2 as int) attempt", "id line_no",
        "timestamp_seconds(id) ts", "cast(id as string) line",
    )
    text = plan(monitor.log_status(lines)).splitlines()
    shuffle = next(i for i, line in enumerate(text) if "Exchange hashpartitioning(run_id" in line)
    assert "partial_max" in text[shuffle + 1]


def test_copies_combine_before_their_shuffle(spark):
    frame = spark.range(100).selectExpr(
        "cast(id % 3 as string) anchor", "cast(id % 5 as string) positive", "'n' negative"
    )
    text = plan(with_row_key(frame)).splitlines()
    shuffles = [
        i for i, line in enumerate(text)
        if "Exchange hashpartitioning(anchor" in line and "ENSURE_REQUIREMENTS" in line
    ]
    assert shuffles and all("partial_count" in text[i + 1] for i in shuffles)
