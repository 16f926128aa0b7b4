"""The registered trainings against the same training in plain numpy."""

import numpy as np
import pytest

from __spark_entry__ import queries
from pairloom.operators import evaluate, fit
from pairloom.plans import views
from pairloom.plans.catalog import QUERIES, _triplet_vectors
from pairloom.plans.training import SETTINGS, STEPS


@pytest.fixture(scope="module")
def sequential(spark, sf_dir):
    """Weights and losses; a step takes the mean gradient of its batches."""
    batches = {}
    for r in views.batched_lists(spark, sf_dir).collect():
        batches.setdefault(r.batch_id, {}).setdefault(r.qid, []).append(r)
    arrays = {}
    for b, lists in batches.items():
        lists = [sorted(lists[q], key=lambda r: r.slot) for q in sorted(lists)]
        arrays[b] = (
            np.array([rows[0].query_vec for rows in lists], dtype=np.float64),
            np.array([[r.passage_vec for r in rows] for rows in lists], dtype=np.float64),
            np.array([[r.teacher for r in rows] for rows in lists]),
        )
    weights, optimizer, losses = np.eye(64), fit._AdamW(SETTINGS), []
    for epoch in range(1, SETTINGS.epochs + 1):
        for step in range(STEPS):
            found = [fit.batch_loss_gradient(weights, *arrays[b], SETTINGS) for b in sorted(arrays) if b % STEPS == step]
            losses.append((epoch, step, sum(v for v, _ in found) / len(found)))
            weights = optimizer.update(weights, sum(g for _, g in found) / len(found))
    return weights, losses


def test_losses_of_all_steps(spark, sf_dir, sequential):
    rows = queries()["trained_student"](spark, sf_dir).orderBy("epoch", "batch_id").collect()
    assert SETTINGS.epochs > 1 and STEPS > 1 and SETTINGS.lr > 0
    assert [(r.epoch, r.batch_id) for r in rows] == [x[:2] for x in sequential[1]]
    assert [r.loss for r in rows] == pytest.approx([x[2] for x in sequential[1]], abs=2e-6)


def test_report_is_that_of_the_trained_student(spark, sf_dir, sequential):
    got = queries()["trained_student_report"](spark, sf_dir).first().asDict()
    want = evaluate.eval_report(
        fit.student_triplet_scores(_triplet_vectors(spark, sf_dir), sequential[0])
    ).first().asDict()
    assert got == pytest.approx(want, abs=2e-6)
    base = QUERIES["vector_eval_report"](spark, sf_dir).first().asDict()
    assert any(abs(got[n] - base[n]) > 1e-4 for n in base if isinstance(base[n], float))
