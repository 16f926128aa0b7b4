import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import distil, encode, epochs, fit, loss, score
from pairloom.operators.ordering import assign_batches
from pairloom.operators.quarantine import Quarantine
from pairloom.session import materialise, shared_path


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        label = i % 2
        jaccard, coverage, ratio = np.clip(rng.normal(0.35 + 0.25 * label, 0.15, 3), 0, 1)
        rows.append((float(jaccard), float(coverage), float(ratio), float(label), i % 5 == 0))
    return spark.createDataFrame(
        rows, "jaccard double, coverage double, length_ratio double, label double, val boolean"
    )


def test_teacher_learns_and_round_trips(spark, pairs):
    fitted = fit.fit_teacher(pairs.where("NOT val"), pairs.where("val"), epochs=3, iterations=4)
    rows = fitted.metrics.orderBy("epoch").collect()
    assert len(rows) == 3 and rows[-1]["train_loss"] < math.log(2) * 0.8
    assert rows[0]["save_model"] and min(r["val_loss"] for r in rows) == rows[-1]["best_loss"]
    path = shared_path(spark, "teacher")
    fit.save_teacher(fitted, path)
    weights, bias = fit.load_teacher(path)
    assert weights == fitted.weights and bias == fitted.bias
    table = spark.createDataFrame([("a b c", "a b c"), ("a b", "x y z")], "query string, passage string")
    good, bad = score.teacher_scores(table, weights=weights, bias=bias).orderBy("query", ascending=False).collect()
    assert good["teacher"] > 0.5 > bad["teacher"]


def test_teacher_epochs_go_on_from_each_other(spark, pairs, monkeypatch):
    passes, one_pass = [], fit._teacher_pass
    monkeypatch.setattr(fit, "_teacher_pass", lambda *a: passes.append(1) or one_pass(*a))
    train, val = pairs.where("NOT val"), pairs.where("val")
    parts = fit.fit_teacher(train, val, epochs=4, iterations=3, tolerance=0)
    in_parts = len(passes)
    whole = fit.fit_teacher(train, val, epochs=1, iterations=12, tolerance=0)
    # sums of doubles depend on the order of tasks in their last digits
    assert max(in_parts, len(passes) - in_parts) <= 16
    last = parts.metrics.orderBy("epoch").collect()[-1]
    assert last["train_loss"] == pytest.approx(whole.metrics.first()["train_loss"], rel=1e-9)


def test_stopped_teacher_fit_goes_on(spark, pairs, monkeypatch):
    train, val = pairs.where("NOT val"), pairs.where("val")
    unbroken = fit.fit_teacher(train, val, epochs=4, iterations=2)
    path, calls, one_pass = shared_path(spark, "epochs"), [], fit._teacher_pass

    def stopping(*args):
        calls.append(1)
        if len(calls) == 6:
            raise RuntimeError("driver lost")
        return one_pass(*args)

    monkeypatch.setattr(fit, "_teacher_pass", stopping)
    with pytest.raises(RuntimeError):
        fit.fit_teacher(train, val, epochs=4, iterations=2, checkpoint=path)
    assert 0 < fit._written_epochs(spark, path, "teacher", fit._EPOCH_SCHEMA).count() < 4
    before = len(calls)
    resumed = fit.fit_teacher(train, val, epochs=4, iterations=2, checkpoint=path)
    assert resumed.weights == pytest.approx(unbroken.weights, rel=1e-6) and resumed.bias == pytest.approx(unbroken.bias, rel=1e-6)
    losses = [[r["val_loss"] for r in f.metrics.orderBy("epoch").collect()] for f in (resumed, unbroken)]
    assert len(calls) - before <= 8 and losses[0] == pytest.approx(losses[1], rel=1e-9)
    again = len(calls)
    assert fit.fit_teacher(train, val, epochs=4, iterations=2, checkpoint=path).weights == resumed.weights
    assert len(calls) == again


def test_teacher_reaches_the_optimum(spark, pairs):
    fitted = fit.fit_teacher(pairs, pairs, epochs=1, iterations=100, tolerance=1e-10)
    rows = pairs.collect()
    x = np.array([[r["jaccard"], r["coverage"], r["length_ratio"], 1.0] for r in rows])
    label = np.array([r["label"] for r in rows])
    weights = np.zeros(4)
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-x @ weights))
        weights -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (p - label))
    assert [*fitted.weights.values(), fitted.bias] == pytest.approx(weights.tolist(), rel=1e-6)


def student_lists(rng, batches=6, size=4, k=5, dim=8):
    rows = []
    for b in range(batches):
        for q in range(size):
            query = rng.standard_normal(dim)
            for s in range(k):
                near = s < 2
                passage = query * (0.6 if near else 0.0) + rng.standard_normal(dim)
                rows.append((b, b * size + q, s, 0.9 if near else 0.1, query.tolist(), passage.tolist()))
    return rows


LISTS = "batch_id long, qid long, slot int, teacher double, query_vec array<double>, passage_vec array<double>"


def sequential(rows, settings, dim):
    """The same training, one batch after the other in plain numpy."""
    weights, optimizer = np.eye(dim), fit._AdamW(settings)
    losses = []
    for _ in range(settings.epochs):
        for b in range(max(r[0] for r in rows) + 1):
            part = [r for r in rows if r[0] == b]
            ids = sorted({r[1] for r in part})
            query = np.array([next(r[4] for r in part if r[1] == i) for i in ids])
            passages = np.array([[r[5] for r in part if r[1] == i] for i in ids])
            teacher = np.array([[r[3] for r in part if r[1] == i] for i in ids])
            value, gradient = fit.batch_loss_gradient(weights, query, passages, teacher, settings)
            losses.append(value)
            weights = optimizer.update(weights, gradient)
    return weights, losses


def test_one_batch_per_step_equals_sequential_training(spark):
    rows = student_lists(np.random.default_rng(2), batches=3)
    settings = fit.StudentSettings(epochs=2, lr=0.02)
    frame = spark.createDataFrame(rows, LISTS).repartition(5)
    fitted = fit.fit_student(frame, dim_in=8, steps_per_epoch=3, settings=settings)
    weights, losses = sequential(rows, settings, 8)
    assert np.allclose(fitted.weights, weights)
    assert [r[4] for r in fitted.history] == pytest.approx(losses)


def test_student_improves_and_metrics_feed_epoch_loss(spark):
    rows = student_lists(np.random.default_rng(4))
    settings = fit.StudentSettings(epochs=4, lr=0.05)
    frame = spark.createDataFrame(rows, LISTS)
    fitted = fit.fit_student(frame, dim_in=8, dim_out=6, steps_per_epoch=2, settings=settings)
    assert fitted.weights.shape == (6, 8)
    means = [r["train_loss"] for r in epochs.epoch_loss(fitted.metrics).orderBy("epoch").collect()]
    assert len(means) == 4 and means[-1] < means[0]
    path = shared_path(spark, "student")
    fit.save_student(spark, fitted.weights, path)
    assert np.array_equal(fit.load_student(spark, path), fitted.weights)
    projected = frame.select("query_vec", fit.project("query_vec", fitted.weights).alias("v")).first()
    assert projected["v"] == pytest.approx((fitted.weights @ np.array(projected["query_vec"])).tolist())


def test_identity_student_scores_like_its_base(spark):
    rng = np.random.default_rng(8)
    rows = [(i, *[rng.standard_normal(5).tolist() for _ in range(3)]) for i in range(30)]
    frame = spark.createDataFrame(
        rows, "row_key long, anchor_vec array<double>, positive_vec array<double>, negative_vec array<double>"
    )
    base = score.vector_triplet_scores(frame).orderBy("row_key").collect()
    same = fit.student_triplet_scores(frame, np.eye(5)).orderBy("row_key").collect()
    assert [r["margin"] for r in same] == pytest.approx([r["margin"] for r in base])


def test_text_table_trains_a_student(spark):
    words = ["ant", "bee", "cat", "dog", "eel", "fox"]
    rows = [(i, f"{words[i % 6]} one", f"{words[i % 6]} two", f"{words[(i + 1) % 6]} two") for i in range(36)]
    frame = spark.createDataFrame(rows, "row_key long, anchor string, positive string, negative string")

    def same_word(pairs):
        return (pairs["query"].str.split().str[2] == pairs["passage"].str.split().str[2]) * 0.8 + 0.1

    for k in (4, 5):
        table = materialise(distil.distil_table(frame, k, 8, scorer=same_word), "table")
        assert table.groupBy("qid").count().where(F.col("count") != k).isEmpty()
        assert table.where("slot = 0 AND teacher < 0.5").isEmpty()
        assert table.select("batch_id").distinct().count() == 5
    settings = fit.StudentSettings(epochs=3, lr=0.05)
    fitted = fit.fit_student(table, dim_in=64, steps_per_epoch=2, settings=settings)
    losses = [r[4] for r in fitted.history]
    assert losses[-1] < losses[0]
    first = {r["batch_id"]: r["total"] for r in loss.distill_loss(distil.student_scores(table)).collect()}
    even = [first[b] for b in first if b % 2 == 0]
    assert losses[0] == pytest.approx(sum(even) / len(even))


def test_batch_out_of_memory_is_skipped(spark, monkeypatch):
    rows = student_lists(np.random.default_rng(6), batches=4)
    plain = fit.batch_loss_gradient

    def fails_on_one(weights, query, passages, teacher, settings):
        if abs(query[0, 0] - rows[0][4][0]) < 1e-12:
            raise MemoryError
        return plain(weights, query, passages, teacher, settings)

    monkeypatch.setattr(fit, "batch_loss_gradient", fails_on_one)
    settings = fit.StudentSettings(epochs=1)
    packed = fit.pack_batches(spark.createDataFrame(rows, LISTS), 1)
    sums = fit.step_sums(packed, np.eye(8), settings)
    assert sums[fit._SKIPPED] == 1 and sums[fit._BATCHES] == 3


def ending(marks, error=None):
    """The batch loss, except that batches whose first query entry is marked kill their worker or raise."""
    plain = fit.batch_loss_gradient

    def loss(weights, query, passages, teacher, settings):
        if any(abs(query[0, 0] - mark) < 1e-12 for mark in marks):
            if error:
                raise RuntimeError(error)
            os._exit(1)
        return plain(weights, query, passages, teacher, settings)

    return loss


def first_entries(rows, *batches):
    return [next(r[4][0] for r in rows if r[0] == b) for b in batches]


@pytest.mark.parametrize("error", [None, "CUDA out of memory"])
def test_batches_that_end_their_worker_are_left_out(spark, error):
    rows = student_lists(np.random.default_rng(12), batches=9)
    path = shared_path(spark, "student-quarantine")

    def run(epochs, loss, frame=rows, checkpoint=path, steps=3):
        settings = fit.StudentSettings(epochs=epochs, lr=0.02)
        lists = spark.createDataFrame(frame, LISTS)
        return fit.fit_student(lists, 8, steps_per_epoch=steps, settings=settings, checkpoint=checkpoint, batch_loss=loss)

    loss = ending(first_entries(rows, 1, 4, 6), error)
    run(1, loss)
    written = spark.read.parquet(fit.quarantine_path(path))
    assert {(r["scope"], r["batch_id"]) for r in written.collect()} == {(0, 1), (0, 4), (0, 6)}
    # the second epoch goes on from the written state and does not meet the batches again
    before = written.count()
    fitted = run(2, loss)
    assert spark.read.parquet(fit.quarantine_path(path)).count() == before
    want = run(2, None, [r for r in rows if r[0] not in (1, 4, 6)], None)
    assert np.allclose(fitted.weights, want.weights, rtol=1e-9, atol=1e-12)
    skipped = [(r[2], r[3]) for r in fitted.history if r[5] == "skipped"]
    assert skipped == [(1, 0), (1, 1), (1, 1), (2, 0), (2, 1), (2, 1)]
    assert [r[4] for r in fitted.history if r[5] == "ok"] == pytest.approx([r[4] for r in want.history])


def test_a_fault_of_every_batch_is_raised(spark):
    rows = student_lists(np.random.default_rng(13), batches=5)
    lists = spark.createDataFrame(rows, LISTS)
    loss = ending(first_entries(rows, 0, 1, 2, 3, 4), "wrong")
    for limit in (0, 2):
        with pytest.raises(Exception, match="wrong"):
            fit.fit_student(lists, 8, steps_per_epoch=1, batch_loss=loss, max_quarantined=limit)


def test_batches_dealt_anew_are_left_out_for_one_epoch(spark):
    rows = student_lists(np.random.default_rng(14), batches=4)
    lists = spark.createDataFrame(rows, LISTS)
    bad = rows[0][4][0]
    plain = fit.batch_loss_gradient

    def loss(weights, query, passages, teacher, settings):
        if np.isclose(query[:, 0], bad, rtol=0, atol=1e-12).any():
            os._exit(1)
        return plain(weights, query, passages, teacher, settings)

    fitted = fit.fit_student(
        lists, 8, steps_per_epoch=4, settings=fit.StudentSettings(epochs=2, lr=0.02), batch_size=4, batch_loss=loss
    )
    assert [sum(r[2] == e and r[5] == "skipped" for r in fitted.history) for e in (1, 2)] == [1, 1]
    assert [sum(r[2] == e and r[5] == "ok" for r in fitted.history) for e in (1, 2)] == [3, 3]


def test_a_job_that_passes_when_tried_again_leaves_nothing_out(spark):
    calls = []

    def job(rows):
        calls.append(1)
        if len(calls) == 1:
            return rows.select(F.raise_error(F.lit("lost"))).collect()
        return rows.count()

    kept = Quarantine("id")
    assert kept.run(spark.range(100), job) == 100 and kept.size() == 0


def test_batches_that_are_not_whole_are_skipped(spark):
    rows = student_lists(np.random.default_rng(6), batches=4)
    rows = [r for i, r in enumerate(rows) if i != 3]
    rows = [(*r[:5], None) if r[0] == 2 and r[2] == 1 else r for r in rows]
    settings = fit.StudentSettings(epochs=1)
    fitted = fit.fit_student(spark.createDataFrame(rows, LISTS), 8, steps_per_epoch=1, settings=settings)
    assert [r[5] for r in fitted.history] == ["skipped", "skipped", "ok"]


@pytest.mark.parametrize("normalize", [True, False])
def test_gradient_equals_finite_differences(normalize):
    rng = np.random.default_rng(3)
    settings = fit.StudentSettings(normalize=normalize)
    weights, query = rng.standard_normal((4, 5)), rng.standard_normal((3, 5))
    passages, teacher = rng.standard_normal((3, 6, 5)), rng.random((3, 6))
    _, gradient = fit.batch_loss_gradient(weights, query, passages, teacher, settings)
    for i, j in [(0, 0), (1, 3), (3, 4)]:
        step = np.zeros_like(weights)
        step[i, j] = 1e-6
        up, down = (fit.batch_loss_gradient(weights + s, query, passages, teacher, settings)[0] for s in (step, -step))
        assert gradient[i, j] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)


def test_new_batches_every_epoch_equal_sequential_training(spark):
    rows = student_lists(np.random.default_rng(9), batches=3)
    settings = fit.StudentSettings(epochs=2, lr=0.02, normalize=False)
    frame = spark.createDataFrame(rows, LISTS)
    fitted = fit.fit_student(frame, 8, steps_per_epoch=3, settings=settings, batch_size=4)
    weights, optimizer, losses, seen = np.eye(8), fit._AdamW(settings), [], []
    for epoch in (1, 2):
        dealt = assign_batches(frame.select("qid").distinct(), 4, "qid", 42, epoch).collect()
        for b in range(3):
            ids = sorted(r["qid"] for r in dealt if r["batch_id"] == b)
            seen.append(ids)
            part = {(r[1], r[2]): r for r in rows}
            query = np.array([part[i, 0][4] for i in ids])
            passages = np.array([[part[i, s][5] for s in range(5)] for i in ids])
            teacher = np.array([[part[i, s][3] for s in range(5)] for i in ids])
            value, gradient = fit.batch_loss_gradient(weights, query, passages, teacher, settings)
            losses.append(value)
            weights = optimizer.update(weights, gradient)
    assert seen[:3] != seen[3:]
    assert np.allclose(fitted.weights, weights) and [r[4] for r in fitted.history] == pytest.approx(losses)


@pytest.mark.parametrize("batch_size", [None, 4])
def test_stopped_student_fit_goes_on(spark, monkeypatch, batch_size):
    lists = spark.createDataFrame(student_lists(np.random.default_rng(3)), LISTS)
    settings = fit.StudentSettings(epochs=3, lr=0.02)

    def run(checkpoint=None):
        return fit.fit_student(lists, 8, steps_per_epoch=3, settings=settings, batch_size=batch_size, checkpoint=checkpoint)

    unbroken, path, calls, sums = run(), shared_path(spark, "student-state"), [], fit.step_sums

    def stopping(*args):
        calls.append(1)
        if len(calls) == 5:
            raise RuntimeError("driver lost")
        return sums(*args)

    monkeypatch.setattr(fit, "step_sums", stopping)
    with pytest.raises(RuntimeError):
        run(path)
    resumed = run(path)
    assert len(calls) == 5 + 6  # the first epoch is not repeated
    assert np.allclose(resumed.weights, unbroken.weights, rtol=1e-9, atol=1e-12)
    assert [r[:4] for r in resumed.history] == [r[:4] for r in unbroken.history]
    assert [r[4] for r in resumed.history] == pytest.approx([r[4] for r in unbroken.history], rel=1e-9)
    assert np.array_equal(run(path).weights, resumed.weights) and len(calls) == 11


def test_teacher_needs_rows_to_validate_on(spark, pairs):
    with pytest.raises(ValueError, match="val"):
        fit.fit_teacher(pairs, pairs.where("false"))


def test_fitted_student_is_evaluated_on_text(spark):
    rows = [(i, f"a{i} b", f"a{i} c", f"d{i} e") for i in range(20)]
    frame = spark.createDataFrame(rows, "row_key long, anchor string, positive string, negative string")
    weights = np.random.default_rng(1).standard_normal((16, 64))
    student = encode.projected_encoder(encode.hashed_encoder(), weights)
    found = score.triplet_scores(frame, student).orderBy("row_key").collect()
    vectors = frame.select("row_key", *[
        encode.encoded(F.concat(F.lit(f"{kind}: (ko) "), name)).alias(f"{name}_vec")
        for kind, name in (("query", "anchor"), ("passage", "positive"), ("passage", "negative"))
    ])
    want = fit.student_triplet_scores(vectors, weights).orderBy("row_key").collect()
    assert [r["margin"] for r in found] == pytest.approx([r["margin"] for r in want])


def test_epoch_tables(spark):
    rows = [
        ("r", "train", 1, 0, 2.0, "ok"), ("r", "train", 1, 1, None, "skipped"),
        ("r", "val", 1, 0, 1.0, "ok"), ("r", "train", 2, 0, 1.0, "ok"), ("r", "val", 2, 0, 0.5, "ok"),
        ("r", "val", 3, 0, 0.5, "ok"), ("r", "train", 4, 0, 1.0, "ok"), ("r", "val", 5, 0, 0.4, "ok"),
    ]
    table = spark.createDataFrame(rows, "run_id string, phase string, epoch long, batch_id long, loss double, status string")
    by_epoch = {r["epoch"]: r for r in epochs.epoch_loss(table).collect()}
    assert by_epoch[1]["train_loss"] == 2.0 and by_epoch[1]["n_skipped"] == 1
    assert epochs.epoch_loss(table, "all").where("epoch = 1").first()["train_loss"] == 1.0
    assert by_epoch[3]["train_loss"] is None
    losses = epochs.epoch_loss(table)
    assert tuple(epochs.best_epoch(losses).first()) == ("r", 5, 0.4)
    flags = epochs.checkpoint_flags(losses).orderBy("epoch").collect()
    assert [r["save_model"] for r in flags] == [True, True, False, False, True]
    assert [r["best_loss"] for r in flags] == [1.0, 0.5, 0.5, 0.5, 0.4]
    assert tuple(epochs.best_epoch(losses.where("epoch < 4")).first()) == ("r", 2, 0.5)
    assert losses.where(F.col("epoch") == 4).first()["val_loss"] is None


def test_pair_features_hold_no_texts(spark, sf_dir):
    from pairloom.plans import catalog

    assert not {"query_text", "passage_text", "pair_text"} & set(catalog._pair_features(spark, sf_dir).columns)
