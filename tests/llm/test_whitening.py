import math

import numpy as np
import pytest

from pairloom.llm import whitening


def exact(rows, components=8):
    """n, deviations and whitened values per id by plain integer sums and a longer solve."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for d in {len(v) for _, v in good}:
        x = [(i, [math.floor(c * 1024) + 100000 for c in v]) for i, v in good if len(v) == d]
        n = len(x)
        s = [sum(v[j] for _, v in x) for j in range(d)]
        centred = [[n * v[j] - s[j] for j in range(d)] for _, v in x]
        big = [[sum(c[i] * c[j] for c in centred) for j in range(d)] for i in range(d)]
        cov = np.array([[b / n**3 for b in row] for row in big])
        values, basis = np.linalg.eigh(cov)
        values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
        for (i, _), c in zip(x, centred):
            out[i] = n, sum(e * e for e in c), np.array(c) / n @ basis / np.sqrt(np.maximum(values, 1e-300)), values / np.trace(cov)
    return out


def test_table_equals_exact_sums(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in frame.collect()])
    rows = whitening.whiten(frame).collect()
    assert len(rows) == 8 * len(want)
    got = np.zeros((len(want), 8))
    for r in rows:
        n, deviation, _, explained = want[r.id]
        assert (r.n, r.deviation) == (n, deviation)
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-12) and r.identity_error < 1e-10
        got[r.id, r.component - 1] = r.whitened
    need = np.array([want[i][2] for i in range(len(want))])
    sign = np.sign((got * need).sum(axis=0))
    assert np.abs(got * sign - need).max() < 1e-10
    assert np.abs(got.T @ got / len(got) - np.eye(8)).max() < 1e-10


@pytest.mark.parametrize("spectrum", [
    np.arange(1.0, 41), np.ones(40), np.repeat([1.0, 2.0, 5.0, 5.0 + 1e-9], 10), 1 + 1e-8 * np.arange(40), 10.0 ** -np.arange(0, 16, 0.4),
    np.concatenate([np.zeros(20), 1 + 1e-11 * np.arange(20)]),
])
def test_refinement_of_close_eigenvalues(spectrum):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0].astype(np.longdouble)
    for _ in range(3):  # orthonormal to the last digit of the wider type
        q = q @ (1.5 * np.eye(40) - 0.5 * (q.T @ q))
    a = q @ np.diag(spectrum.astype(np.longdouble)) @ q.T
    a = (a + a.T) / 2
    values, x = whitening.eigenvectors(a)
    assert np.abs(values - np.sort(spectrum)[::-1]).max() <= 1e-15 * spectrum.max()
    assert np.abs(x.T @ x - np.eye(40)).max() < 1e-15 * 4
    rest = (x.astype(np.longdouble).T @ a @ x) - np.diag(values)
    assert np.abs(rest).max() < 1e-15 * 4 * spectrum.max()
    order = np.argsort(-spectrum, kind="stable")
    gaps = np.abs(np.diff(spectrum[order]))
    for i in range(40):  # vectors whose eigenvalue stands alone are right one by one
        gap = min(gaps[max(0, i - 1):i + 1]) / spectrum.max()
        if gap > 1e-12:  # the matrix itself is rounded at about 1e-19
            assert np.abs(np.abs(q[:, order[i]]) - np.abs(x[:, i])).max() < 1e-14 + 1e-18 / gap


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [3.0, -1.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
        (7, [float("inf"), 1.0]), (8, [1e30, 1.0]), (9, [0.5, -0.25]), (None, [2.5, 0.125]), (10, [1.0]), (11, [2.0, 3.0, 4.0]),
        (12, [2.0, 3.0, 4.0]),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<double>, n string, component string")
    found = whitening.whiten(frame).collect()
    assert sorted((r.id or 0, r.component) for r in found) == sorted(
        [(i, c) for i in (1, 2, 2, 9, 0) for c in (1, 2)] + [(10, 1)] + [(i, c) for i in (11, 12) for c in (1, 2, 3)]
    )
    two = [r for r in found if r.id in (1, 2, 9, None)]
    assert {r.n for r in two} == {5} and max(r.identity_error for r in two) < 1e-12
    assert math.isclose(sum({r.component: r.explained for r in two}.values()), 1)
    flat = [r for r in found if r.id in (10, 11, 12)]
    assert all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in flat)
    assert {r.id: r.n for r in flat} == {10: 1, 11: 2, 12: 2}
    assert whitening.whiten(frame.limit(0)).collect() == []


@pytest.mark.parametrize("far,components", [(1e4, 2), (1e8, 1)])
def test_far_entries_and_fewer_components(spark, far, components):
    rows = [(i, [float(i % 7), far * (i % 2), -3.0 * i]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = exact(rows, components)
    found = whitening.whiten(frame, components=components).collect()
    assert len(found) == 50 * components and (far < 1e8) == all(r.deviation for r in found)
    for r in found:
        n, deviation, values, explained = want[r.id]
        assert r.n == n and r.deviation == (deviation if deviation < 2**63 else None)
        assert math.isclose(abs(r.whitened), abs(values[r.component - 1]), rel_tol=1e-8, abs_tol=1e-8) and r.identity_error < 1e-9
