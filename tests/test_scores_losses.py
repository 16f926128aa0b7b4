import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import encode, evaluate, fit, loss, score
from pairloom.operators.skew import hot_keys, salted_join


def test_cosine_of_zero_vector_is_zero(spark):
    frame = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<double>, b array<double>")
    found = score.pair_cosine(frame, "a", "b").collect()
    assert sorted((r["cos_raw"], r["score"]) for r in found) == [(0.0, 0.5), (1.0, 1.0)]


def test_encoder_plug_in_sees_distinct_texts_and_keeps_rows(spark):
    def lengths(batches):
        for texts in batches:
            assert len(texts) == len(set(texts))
            yield np.array([[len(t), 1.0] for t in texts])

    frame = spark.createDataFrame([(i, "x" * (i % 3 + 1)) for i in range(50)], "row_key long, text string")
    for r in encode.encode(frame, "text", encoder=lengths).collect():
        assert r["vector"] == [r["row_key"] % 3 + 1, 1.0]
    triplets = frame.select("row_key", F.col("text").alias("anchor"), F.col("text").alias("positive"), F.lit("zz").alias("negative"))
    for r in score.triplet_scores(triplets, lengths).collect():
        q, p, n = (np.array([len(t), 1.0]) for t in (
            "query: (ko) " + "x" * (r["row_key"] % 3 + 1),
            "passage: (ko) " + "x" * (r["row_key"] % 3 + 1), "passage: (ko) zz"))
        assert r["pos_raw"] == pytest.approx(q @ p / np.linalg.norm(q) / np.linalg.norm(p))
        assert r["neg_raw"] == pytest.approx(q @ n / np.linalg.norm(q) / np.linalg.norm(n))


def test_built_in_scores_agree_with_vectors(spark):
    texts = ["", "a b c a", "b c d", "A  B\nc", "zzz"]
    rows = [(i, texts[i], texts[(i + 1) % 5], texts[(i + 2) % 5]) for i in range(5)]
    frame = spark.createDataFrame(rows, "row_key long, anchor string, positive string, negative string")
    by_text = {r["row_key"]: r for r in score.triplet_scores(frame).collect()}
    vectors = frame.select(
        "row_key",
        encode.encoded(F.concat(F.lit("query: (ko) "), "anchor")).alias("anchor_vec"),
        encode.encoded(F.concat(F.lit("passage: (ko) "), "positive")).alias("positive_vec"),
        encode.encoded(F.concat(F.lit("passage: (ko) "), "negative")).alias("negative_vec"),
    )
    for r in score.vector_triplet_scores(vectors).collect():
        for name in ("pos_raw", "neg_raw", "margin"):
            assert r[name] == pytest.approx(by_text[r["row_key"]][name])


def test_salted_join_equals_plain_join(spark):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k")
    )
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = hot_keys(left, ["k"], min_rows=100).collect()
    assert [r["k"] for r in hot] == [7]
    for how in ("inner", "left"):
        salted = salted_join(left, right, ["k"], ["id"], how, salts=8, min_rows=100)
        plain = left.join(right, ["k"], how)
        assert sorted(salted.select("k", "id", "v").collect(), key=str) == sorted(
            plain.select("k", "id", "v").collect(), key=str
        )


def lists(rng, batches=3, size=5, k=6, mode="mixed"):
    rows = []
    for b in range(batches):
        for q in range(size):
            teacher = rng.random(k)
            if mode == "positive" or (mode == "mixed" and q == 0):
                teacher = 0.5 + teacher / 2 + 1e-6
            if mode == "negative" or (mode == "mixed" and q == 1):
                teacher = teacher / 2
            rows += [(b, b * size + q, s, float(teacher[s]), float(rng.random())) for s in range(k)]
    return rows


def plain_loss(teacher, student, tau=0.2):
    def softmax(x):
        e = np.exp(x / tau - (x / tau).max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    p, q = softmax(teacher), softmax(student)
    kl = (p * (np.log(p + 1e-12) - np.log(q + 1e-12))).sum(axis=1).mean()
    margins, penalties = [], []
    for t, s in zip(teacher, student):
        pos, neg = s[t > 0.5], s[t <= 0.5]
        if len(pos) and len(neg):
            margins.append(max(0.7 - (pos.mean() - neg.mean()), 0))
        if len(neg):
            penalties.append(max(neg.mean() - 0.15, 0))
    margin = np.mean(margins) if margins else 0.0
    penalty = 0.0
    if penalties:
        penalty = max(student[teacher <= 0.5].mean() - 0.15, 0) + 0.5 * np.mean(penalties)
    return kl, margin, penalty, kl + 0.3 * margin + 0.4 * penalty


@pytest.mark.parametrize("mode", ["mixed", "positive", "negative"])
def test_losses_equal_numpy(spark, mode):
    rows = lists(np.random.default_rng(1), mode=mode)
    frame = spark.createDataFrame(rows, "batch_id long, qid long, slot int, teacher double, student double")
    for r in loss.distill_loss(frame).collect():
        block = np.array([x[3:] for x in rows if x[0] == r["batch_id"]]).reshape(5, 6, 2)
        wanted = plain_loss(block[..., 0], block[..., 1])
        found = (r["kl"], r["margin_loss"], r["penalty"], r["total"])
        assert found == pytest.approx(wanted)
        assert r["kl"] >= 0
    shares = loss.listwise_softmax(frame).groupBy("qid").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    assert all(r["p"] == pytest.approx(1) and r["q"] == pytest.approx(1) for r in shares.collect())


def test_score_of_exactly_one_half_is_negative(spark):
    frame = spark.createDataFrame(
        [(0, 0, 0, 0.5, 0.4), (0, 0, 1, 0.9, 0.6)],
        "batch_id long, qid long, slot int, teacher double, student double",
    )
    row = loss.query_losses(frame).first()
    assert (row["neg_count"], row["neg_mean"], row["pos_mean"]) == (1, 0.4, 0.6)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(3)
    settings = fit.StudentSettings()
    query, passages = rng.standard_normal((4, 5)), rng.standard_normal((4, 6, 5))
    teacher = rng.random((4, 6))
    teacher[0], teacher[1] = 0.9, 0.1
    weights = rng.standard_normal((3, 5))
    value, gradient = fit.batch_loss_gradient(weights, query, passages, teacher, settings)
    cos = np.array([[
        (weights @ q) @ (weights @ d) / np.linalg.norm(weights @ q) / np.linalg.norm(weights @ d)
        for d in ds] for q, ds in zip(query, passages)])
    assert value == pytest.approx(plain_loss(teacher, (cos + 1) / 2)[3])
    for i in range(3):
        for j in range(5):
            step = np.zeros_like(weights)
            step[i, j] = 1e-6
            up = fit.batch_loss_gradient(weights + step, query, passages, teacher, settings)[0]
            down = fit.batch_loss_gradient(weights - step, query, passages, teacher, settings)[0]
            assert gradient[i, j] == pytest.approx((up - down) / 2e-6, abs=1e-7)


def scores(spark, values):
    return spark.createDataFrame(
        [(float(p), float(n), float(p - n)) for p, n in values],
        "pos_score double, neg_score double, margin double",
    )


@pytest.mark.parametrize("kind", ["normal", "constant", "hot", "tiny"])
def test_charts_equal_numpy(spark, kind):
    rng = np.random.default_rng(5)
    pairs = {
        "normal": rng.normal(0.5, 0.1, (801, 2)),
        "constant": np.full((40, 2), 0.25),
        "hot": np.where(rng.random((600, 2)) < 0.4, 0.5, rng.random((600, 2))),
        "tiny": np.concatenate([[[0.0, 1.0]], 0.5 + rng.random((500, 2)) * 1e-7]),
    }[kind]
    frame = scores(spark, pairs).cache()
    series = {"positive": pairs[:, 0], "negative": pairs[:, 1], "margin": pairs[:, 0] - pairs[:, 1]}

    found = evaluate.score_histogram(frame).collect()
    assert len(found) == 150
    for name, x in series.items():
        counts = [r["n_rows"] for r in sorted(found, key=lambda r: r["bin"]) if r["series"] == name]
        wanted, _ = np.histogram(x, bins=50)
        assert sum(counts) == len(x)
        # Values on a bin edge may fall to either side by one rounding.
        assert np.abs(np.array(counts) - wanted).sum() <= 4

    for r in evaluate.score_boxplot(frame).collect():
        x = series[r["series"]]
        q1, median, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, median, q3), abs=1e-15)
        reach = 1.5 * (q3 - q1)
        inside = x[(x >= q1 - reach) & (x <= q3 + reach)]
        assert r["whisker_low"] == pytest.approx(min(inside.min(), q1))
        assert r["whisker_high"] == pytest.approx(max(inside.max(), q3))
        assert r["n_low_outliers"] + r["n_high_outliers"] == len(x) - len(inside)

    report = evaluate.eval_report(frame).first()
    both = np.concatenate([pairs[:, 0], pairs[:, 1]])
    assert report["overall_uniformity"] == pytest.approx(both.var(), abs=1e-12)
    assert report["margin_std"] == pytest.approx(series["margin"].std(), abs=1e-12)
    assert report["total_samples"] == len(pairs)


def test_quantiles_of_uneven_sizes(spark):
    rng = np.random.default_rng(9)
    values = {"a": rng.random(1), "b": rng.random(2), "c": rng.exponential(1, 333)}
    rows = [(s, float(x)) for s, xs in values.items() for x in xs] + [("c", None)]
    table = spark.createDataFrame(rows, "series string, x double")
    probabilities = [0.0, 0.1, 0.5, 0.9, 1.0]
    found = evaluate.exact_quantiles(table, probabilities).collect()
    narrow = evaluate.exact_quantiles(table, probabilities, bins=4, small=3).collect()
    assert sorted(map(tuple, narrow)) == sorted(map(tuple, found))
    for r in found:
        wanted = np.quantile(values[r["series"]], r["probability"])
        assert math.isclose(r["value"], wanted, abs_tol=1e-12)


def test_encoder_gets_bounded_runs_of_a_large_batch(spark):
    """Each vector holds the characters its encoder was given at once."""

    def totals(batches):
        for texts in batches:
            yield np.full((len(texts), 1), sum(len(t) for t in texts))

    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 100_000))
    frame = spark.range(0, 60, 1, 1).select("id", text.alias("text"))
    sizes = [r.vector[0] for r in encode.encode(frame, "text", encoder=totals).collect()]
    assert len(sizes) == 60 and max(sizes) < 2 * encode.RUN_CHARS < 60 * 100_000
    plain, cut = (encode.encode(frame.where(w), "text").select("id", "vector") for w in ("true", "id % 7 = 3"))
    assert {r.id: r.vector for r in plain.collect() if r.id % 7 == 3} == {r.id: r.vector for r in cut.collect()}
