"""Embedding whitening by principal components, refined from single to double precision.

Entries c become integers x = floor(1024 * c) + 100000. Their sums are exact; the covariance
is that of the x centred at the integer next to their mean (the rest of the mean, at most a
half, is taken off in the end), so nothing cancels and its sums are integers that a double
holds. Eigenvectors X of the covariance A are first found in float32, then corrected by
Ogita-Aishima iterations, which need only matrix products:

    R = I - X'X,  S = X'AX,  l_i = S_ii / (1 - R_ii)
    E_ij = (S_ij + l_j R_ij) / (l_j - l_i), or R_ij / 2 where l_i and l_j cannot be told apart
    X <- X + XE

The first iteration works in double, the others in extended precision; each squares the
error. Eigenvalues closer than the error bound form a cluster, whose vectors are rotated by a
solve of their own: the covariance, shifted by the cluster's mean and projected on its
vectors, is a small matrix whose gaps are wide relative to its size.

Scale: three scans of the vectors (sums, products, projections), each a map. What leaves a
task is one number per dimension or pair of dimensions, combined before the shuffle; the
driver holds these sums, d * d numbers, and solves on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.session import materialise

STEPS, SHIFT = 1024, 100_000
LIMIT = 2.0**40
"""A row with an entry whose |1024 * c| is beyond has no use, like one with an infinite entry."""
Wide = np.longdouble


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, dims and x as longs of the rows that take part."""
    values = F.col(vector).cast("array<double>")
    fine = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * STEPS) < LIMIT))
    kept = vectors.where(F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0))
    return kept.select(
        F.col(id_column).alias("id"), F.size(vector).alias("dims"),
        F.transform(values, lambda c: F.floor(c * STEPS) + SHIFT).alias("x"),
    )


def _matrices(b: pa.RecordBatch, column: str, key: str = "dims") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Key, places and matrix of a batch's rows of each key; their arrays are equally long."""
    keys = b.column(key).to_numpy(zero_copy_only=False)
    for k in np.unique(keys).tolist():
        places = np.flatnonzero(keys == k)
        flat = b.column(column).take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
        yield k, places, flat.reshape(len(places), -1)


def sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length of vector the number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for d, _, x in _matrices(b, "x"):
                held = total.setdefault(d, [0, [0] * d])
                held[0] += len(x)
                held[1] = [a + s for a, s in zip(held[1], x.sum(axis=0).tolist())]
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_pydict({
                "dims": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()),
                "n": pa.array([n] * d, pa.int64()), "s": pa.array(s, pa.decimal128(38, 0)),
            })

    parts = rows.select("dims", "x").mapInArrow(run, "dims int, i int, n bigint, s decimal(38,0)")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dims", "i").collect():
        found.setdefault(r.dims, (r.n, []))[1].append(int(r.s))
    return found


def centres(fitted: dict[int, tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length the integers next to the means, and the means' rests times n."""
    out = {}
    for d, (n, s) in fitted.items():
        near = [(2 * t + n) // (2 * n) for t in s]
        out[d] = np.array(near, dtype=np.int64), np.array([t - n * m for t, m in zip(s, near)], dtype=np.int64)
    return out


def _gram(
    rows: DataFrame, column: str, key: str = "dims", shift: dict[int, np.ndarray] | None = None
) -> dict[int, np.ndarray]:
    """Per key the sums of all products of two entries of the arrays, after the shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, _, x in _matrices(b, column, key):
                y = (x - shift[k] if shift else x).astype(np.float64)
                total[k] = total.get(k, 0.0) + y.T @ y
        for k, gram in total.items():
            i, j = np.triu_indices(len(gram))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.full(len(i), k), pa.int32()), "i": pa.array(i, pa.int32()),
                "j": pa.array(j, pa.int32()), "v": pa.array(gram[i, j], pa.float64()),
            })

    parts = rows.select(key, column).mapInArrow(run, "key int, i int, j int, v double")
    found = parts.groupBy("key", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for k, cells in found.groupby("key"):
        gram = np.zeros((cells["i"].max() + 1,) * 2)
        gram[cells["i"], cells["j"]] = gram[cells["j"], cells["i"]] = cells["v"]
        out[int(k)] = gram
    return out


def covariance(gram: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """The covariance in extended precision, from sums of centred products."""
    rest = rest.astype(Wide) / n
    return gram.astype(Wide) / n - np.outer(rest, rest)


def _step(a: np.ndarray, x: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One iteration: vectors, eigenvalues, the error bound on them, and the largest change
    to a vector outside of clusters."""
    r = np.eye(x.shape[1], dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else rounding over a narrow gap would cost orthogonality
    values = s.diagonal() / (1 - r.diagonal())
    bound = 2 * float(np.linalg.norm((s - np.diag(values)).astype(np.float64)) + size * np.linalg.norm(r.astype(np.float64)))
    # rounding alone tells no eigenvalues apart
    bound = max(bound, 16 * len(a) * float(np.finfo(x.dtype).eps) * size)
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > bound
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, bound, float(np.abs(np.where(apart, e, 0)).max(initial=0))


def _clusters(values: np.ndarray, bound: float) -> Iterator[np.ndarray]:
    """Places of two and more eigenvalues that follow each other within the bound."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > bound) + 1
    yield from (part for part in np.split(order, cuts) if len(part) > 1)


def eigenvectors(a: np.ndarray, iterations: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors, to double precision.

    Where eigenvalues are equal to the last digit any orthonormal basis of theirs is given.
    """
    a = a.astype(Wide)
    size = float(np.sqrt((a * a).sum()))
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    x = np.linalg.eigh((a / size).astype(np.float32))[1].astype(np.float64)
    x = _step(a.astype(np.float64), x, size)[0].astype(Wide)
    for _ in range(iterations):
        x, values, bound, change = _step(a, x, size)
        clusters = list(_clusters(values, bound))
        for part in clusters:
            own = x[:, part]
            middle = values[part].mean()
            inner = own.T @ (a @ own - middle * own)
            inner = (inner + inner.T) / 2
            spread = np.abs(inner).max()
            if spread:
                x[:, part] = own @ np.linalg.eigh((inner / spread).astype(np.float64))[1].astype(Wide)
        if change < 2.0**-58 and not clusters:
            break
    x = x + x @ (np.eye(len(a), dtype=Wide) - x.T @ x) / 2  # rotations are orthogonal to double precision only
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), x[:, order].astype(np.float64)


def whiten(
    vectors: DataFrame, components: int = 8, id_column: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """One row per vector and component: id, component (from 1, by falling eigenvalue), n,
    deviation, whitened, explained, identity_error.

    `whitened` is x less its mean, projected on the component, over the root of its
    eigenvalue; `explained` the eigenvalue's share of the trace; `deviation` the exact sum of
    (n * x - S)^2 over the dimensions, null where it does not fit a long; `identity_error` the
    largest entry of the measured covariance of `whitened` less the identity. Repeated rows
    count each. Vectors of different lengths are fitted apart (n, too, is of the length).
    Shorter vectors than `components` have as many components as dimensions. A component
    without variance (one row, equal rows) has null in `whitened`, takes no part in
    `identity_error`, and explains 0. Left out: null and empty vectors, those with a null or
    non-finite entry or one beyond `LIMIT`. Without rows there is no result row. Other
    columns are ignored; the id may be null.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector)
    fitted = sums(rows)
    places = centres(fitted)
    grams = _gram(rows, "x", shift={d: near for d, (near, _) in places.items()})
    models, shares = {}, {}
    for d, (n, _) in fitted.items():
        a = covariance(grams[d], places[d][1], n)
        values, basis = eigenvectors(a)
        values, basis, trace = values[:components], basis[:, :components], float(np.trace(a))
        # below the rounding of the covariance there is no variance
        real = values > trace * d * 2.0**-52
        weights = np.where(real, basis / np.sqrt(np.where(real, values, 1)), np.nan)
        models[d] = (n, *places[d], weights)
        shares[d] = np.where(real, values / (trace or 1), 0.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in _matrices(b, "x"):
                n, near, rest, weights = models[d]
                y = x - near
                scores = (y - rest / n) @ weights
                far = float(n) * np.abs(y).max(initial=0) + np.abs(rest).max(initial=0)
                if d * far * far < 2**62:
                    deviation = ((n * y - rest) ** 2).sum(axis=1).tolist()
                else:
                    exact = ((n * y.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
                    deviation = [v if v < 2**63 else None for v in exact]
                bounds = pa.array(np.arange(len(at) + 1) * scores.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").take(pa.array(at)), pa.array([d] * len(at), pa.int32()), pa.array(deviation, pa.int64()),
                        pa.ListArray.from_arrays(bounds, pa.array(scores.ravel(), pa.float64())),
                    ],
                    names=["id", "dims", "deviation", "values"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    done = rows.mapInArrow(project, f"id {kind}, dims int, deviation bigint, values array<double>")
    done = materialise(done, "whitened")
    errors = {}
    for d, gram in _gram(done, "values").items():
        real = ~np.isnan(gram.diagonal())
        off = (gram / fitted[d][0] - np.eye(len(gram)))[np.ix_(real, real)]
        errors[d] = float(np.abs(off).max(initial=0.0))
    facts = spark.createDataFrame(
        pd.DataFrame(
            [(d, i, fitted[d][0], float(share), errors[d]) for d in fitted for i, share in enumerate(shares[d])],
            columns=["dims", "place", "n", "explained", "identity_error"],
        ).astype({"dims": "int32", "place": "int32"}) if fitted else [],
        "dims int, place int, n bigint, explained double, identity_error double",
    )
    # one row per length and component
    each = done.select("id", "dims", "deviation", F.posexplode("values").alias("place", "value"))
    return each.join(F.broadcast(facts), ["dims", "place"]).select(
        "id", (F.col("place") + 1).alias("component"), "n", "deviation",
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"), "explained", "identity_error",
    )
