"""Fitting: a logistic teacher on pair features and a projected student on frozen vectors.

The data stays on the executors. The driver holds the model only: a handful of teacher weights,
or the student's projection matrix, and per step one summed gradient of that size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.math import bce_with_logits, sigmoid
from pairloom.operators import loss as L
from pairloom.operators.epochs import checkpoint_flags
from pairloom.operators.ordering import assign_batches
from pairloom.operators.quarantine import Quarantine
from pairloom.operators.score import FEATURES, linear_logit, vector_triplet_scores
from pairloom.schema import require_columns
from pairloom.session import materialise


@dataclass
class FittedTeacher:
    weights: dict[str, float]
    bias: float
    metrics: DataFrame
    """(run_id, epoch, train_loss, val_loss, best_loss, save_model)"""


MEMORY = 10
"""Pairs of steps and gradient changes that stand for the curvature."""
_EPOCH_SCHEMA = (
    "run_id string, epoch long, train_loss double, val_loss double, point array<double>, gradient array<double>, "
    "steps array<array<double>>, changes array<array<double>>, scale array<double>, ended boolean"
)


@dataclass
class _Descent:
    """Where an L-BFGS run stands: all that its next iteration needs."""

    point: np.ndarray
    scale: np.ndarray
    loss: float
    val_loss: float
    gradient: np.ndarray
    steps: list[np.ndarray] = field(default_factory=list)
    changes: list[np.ndarray] = field(default_factory=list)
    ended: bool = False

    def weights(self) -> tuple[dict[str, float], float]:
        real = self.point / self.scale
        return dict(zip(FEATURES, map(float, real))), float(real[-1])

    def row(self, run_id: str, epoch: int) -> tuple:
        lists = [[v.tolist() for v in vectors] for vectors in (self.steps, self.changes)]
        return (run_id, epoch, self.loss, self.val_loss, self.point.tolist(), self.gradient.tolist(), *lists, self.scale.tolist(), self.ended)

    @classmethod
    def read(cls, row) -> _Descent:
        vectors = [[np.array(v) for v in row[name]] for name in ("steps", "changes")]
        return cls(
            np.array(row["point"]), np.array(row["scale"]), row["train_loss"], row["val_loss"], np.array(row["gradient"]),
            *vectors, row["ended"],
        )


def _teacher_pass(table: DataFrame, label: str, point: np.ndarray, scale: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Train loss, validation loss and the train loss's gradient: one aggregation over the table."""
    real = point / scale
    logit = linear_logit(dict(zip(FEATURES, real)), real[-1])
    rows = table.withColumn("logit", logit).withColumn("_rest", sigmoid("logit") - F.col(label))
    slopes = [F.avg(F.col("_rest") * F.col(name)).alias(f"d_{name}") for name in FEATURES]
    means = rows.groupBy("phase").agg(
        F.avg(bce_with_logits("logit", label)).alias("bce"), *slopes, F.avg("_rest").alias("d_bias")
    )
    found = {row["phase"]: row for row in means.collect()}
    gradient = np.array([found["train"][f"d_{name}"] for name in (*FEATURES, "bias")]) / scale
    return found["train"]["bce"], found["val"]["bce"], gradient


def _direction(state: _Descent) -> np.ndarray:
    """The descent direction by the two-loop recursion over the kept pairs."""
    q, kept = state.gradient.copy(), []
    for s, y in zip(reversed(state.steps), reversed(state.changes)):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append((a, s, y))
    if state.steps:
        s, y = state.steps[-1], state.changes[-1]
        q *= (s @ y) / (y @ y)
    else:
        q /= max(1.0, float(np.linalg.norm(q)))
    for a, s, y in reversed(kept):
        q += (a - (y @ q) / (s @ y)) * s
    return -q


def _iterate(table: DataFrame, label: str, state: _Descent, tolerance: float) -> None:
    """One iteration: steps are halved until the loss falls enough, usually at the first."""
    direction = _direction(state)
    slope, step = float(state.gradient @ direction), 1.0
    rounding = 2.0**-48 * abs(state.loss)
    while True:
        point = state.point + step * direction
        loss, val_loss, gradient = _teacher_pass(table, label, point, state.scale)
        flat = abs(loss - state.loss) <= rounding  # the loss tells no more, the gradient still may
        if loss <= state.loss + 1e-4 * step * slope or flat and np.abs(gradient).max() < np.abs(state.gradient).max():
            break
        step /= 2
        if flat or step < 2.0**-20:
            state.ended = True
            return
    s, y = point - state.point, gradient - state.gradient
    if s @ y > 0:
        state.steps, state.changes = [*state.steps, s][-MEMORY:], [*state.changes, y][-MEMORY:]
    state.point, state.loss, state.val_loss, state.gradient = point, loss, val_loss, gradient
    state.ended = bool(np.abs(gradient).max() <= tolerance)


def fit_teacher(
    train_pairs: DataFrame, val_pairs: DataFrame, epochs: int = 3, iterations: int = 5,
    label: str = "label", run_id: str = "teacher", tolerance: float = 1e-6, checkpoint: str | None = None,
) -> FittedTeacher:
    """Minimise binary cross-entropy and keep the model with the lowest validation loss.

    Pairs carry the feature columns and a label. An epoch is `iterations` L-BFGS iterations
    that go on from the epoch before; each is one pass over the data (more only if a step has
    to be shortened), which gives both losses and the gradient. The narrow feature table is
    written once and every pass reads that. The curvature pairs are a few numbers on the driver.

    With `checkpoint`, a folder of this fit, every epoch's state is written there, and a fit
    that was stopped goes on after the last written epoch with the same result.
    """
    columns = [*FEATURES, label]
    phases = [
        require_columns(pairs, columns).select(*columns, F.lit(phase).alias("phase"))
        for phase, pairs in (("train", train_pairs), ("val", val_pairs))
    ]
    table = materialise(phases[0].unionByName(phases[1]), "teacher", partition_by=["phase"])
    spark = table.sparkSession
    filled = {row["phase"] for row in table.select("phase").distinct().collect()}
    if filled != {"train", "val"}:
        raise ValueError(f"no rows to fit on: {', '.join(sorted({'train', 'val'} - filled))}")
    written = _written_epochs(spark, checkpoint, run_id, _EPOCH_SCHEMA) if checkpoint else None
    done = written.orderBy("epoch").collect() if written is not None else []  # a few numbers each
    if done:
        state = _Descent.read(done[-1])
    else:
        spread = table.where("phase = 'train'").agg(*[F.stddev_pop(name) for name in FEATURES]).first()
        scale = np.array([s if s and s > 0 else 1.0 for s in spread] + [1.0])
        start = np.zeros(len(scale))
        loss, val_loss, gradient = _teacher_pass(table, label, start, scale)
        state = _Descent(start, scale, loss, val_loss, gradient)
    rows = [tuple(row) for row in done[:epochs]]
    for epoch in range(len(rows) + 1, epochs + 1):
        for _ in range(iterations):
            if state.ended:
                break
            _iterate(table, label, state, tolerance)
        rows.append(state.row(run_id, epoch))
        if checkpoint:
            spark.createDataFrame(rows[-1:], _EPOCH_SCHEMA).coalesce(1).write.mode("append").parquet(checkpoint)
    table_of = spark.createDataFrame(rows, _EPOCH_SCHEMA)
    metrics = table_of.select("run_id", "epoch", "train_loss", "val_loss")
    flags = checkpoint_flags(metrics).drop("val_loss")
    best = _Descent.read(min(table_of.collect(), key=lambda row: (row["val_loss"], row["epoch"])))
    return FittedTeacher(*best.weights(), metrics.join(flags, ["run_id", "epoch"]))


def _written_epochs(spark: SparkSession, path: str, run_id: str, schema: str) -> DataFrame | None:
    """The written epochs of a run, one row each; a write that did not end has none."""
    if not _exists(spark, path):
        return None
    return spark.read.schema(schema).parquet(path).where(F.col("run_id") == run_id).dropDuplicates(["epoch"])


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def save_teacher(fitted: FittedTeacher, path: str) -> None:
    """Weights and bias as one row of Parquet."""
    spark = fitted.metrics.sparkSession
    row = [(*(fitted.weights[name] for name in FEATURES), fitted.bias)]
    schema = ", ".join(f"{name} double" for name in (*FEATURES, "bias"))
    spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_teacher(path: str) -> tuple[dict[str, float], float]:
    """Weights and bias for `score.teacher_scores`."""
    row = SparkSession.active().read.parquet(path).first()
    return {name: row[name] for name in FEATURES}, row["bias"]


@dataclass(frozen=True)
class StudentSettings:
    """The defaults of the training method."""

    epochs: int = 3
    lr: float = 2e-5
    weight_decay: float = 0.01
    clip: float = 1.0
    tau: float = L.TAU
    w_margin: float = L.MARGIN_WEIGHT
    w_penalty: float = L.PENALTY_WEIGHT
    target_margin: float = L.TARGET_MARGIN
    target_negative: float = L.TARGET_NEGATIVE
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    normalize: bool = True


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and reciprocal lengths; a zero vector stays zero."""
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    inverse = np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > 0)
    return x * inverse, inverse


def batch_loss_gradient(
    weights: np.ndarray, query: np.ndarray, passages: np.ndarray, teacher: np.ndarray,
    settings: StudentSettings,
) -> tuple[float, np.ndarray]:
    """Loss of one batch and its gradient by the projection.

    Shapes: weights (H', H), query (B, H), passages (B, K, H), teacher (B, K). The student's
    score is (cos + 1) / 2, or without `settings.normalize` the cosine, negatives cut to 0.
    """
    s = settings
    u, u_inv = _unit(query @ weights.T)
    v, v_inv = _unit(passages @ weights.T)
    cos = np.einsum("bh,bkh->bk", u, v)
    student = (cos + 1.0) / 2.0 if s.normalize else np.maximum(cos, 0.0)
    p, q = _softmax(teacher / s.tau), _softmax(student / s.tau)
    n_queries = len(query)
    log_ratio = np.log(p + L.LOG_GUARD) - np.log(q + L.LOG_GUARD)
    total = float((p * log_ratio).sum(axis=1).mean())
    grad = (q - p) / (s.tau * n_queries)

    positive = teacher > L.POSITIVE_THRESHOLD
    n_pos, n_neg = positive.sum(axis=1), (~positive).sum(axis=1)
    pos_mean = (student * positive).sum(axis=1) / np.maximum(n_pos, 1)
    neg_mean = (student * ~positive).sum(axis=1) / np.maximum(n_neg, 1)

    both = (n_pos > 0) & (n_neg > 0)
    if both.any():
        short = np.maximum(s.target_margin - (pos_mean - neg_mean), 0.0) * both
        total += s.w_margin * float(short.sum() / both.sum())
        pull = s.w_margin / both.sum() * (short > 0)
        grad -= positive * (pull / np.maximum(n_pos, 1))[:, None]
        grad += ~positive * (pull / np.maximum(n_neg, 1))[:, None]
    if n_neg.any():
        has_neg = n_neg > 0
        batch_mean = float((student * ~positive).sum() / n_neg.sum())
        over = np.maximum(neg_mean - s.target_negative, 0.0) * has_neg
        total += s.w_penalty * (
            max(batch_mean - s.target_negative, 0.0)
            + L.PER_QUERY_SHARE * float(over.sum() / has_neg.sum())
        )
        if batch_mean > s.target_negative:
            grad += ~positive * (s.w_penalty / n_neg.sum())
        push = s.w_penalty * L.PER_QUERY_SHARE / has_neg.sum() * (over > 0)
        grad += ~positive * (push / np.maximum(n_neg, 1))[:, None]

    by_cos = grad / 2.0 if s.normalize else grad * (cos > 0)
    by_query = np.einsum("bk,bkh->bh", by_cos, v) - (by_cos * cos).sum(axis=1)[:, None] * u
    by_passage = by_cos[..., None] * (u[:, None, :] - cos[..., None] * v)
    gradient = (by_query * u_inv).T @ query
    gradient += np.einsum("bkg,bkh->gh", by_passage * v_inv, passages)
    return total, gradient


def pack_batches(df: DataFrame, steps_per_epoch: int) -> DataFrame:
    """One row per batch from the long table (batch_id, qid, slot, teacher, query_vec, passage_vec).

    A row holds batch size x K vectors, so its size is fixed by the settings. It carries the
    step that uses it. One range shuffle by step and batch serves both groupings, and a task
    then writes to few step folders.
    """
    require_columns(df, ["batch_id", "qid", "slot", "teacher", "query_vec", "passage_vec"])
    step = F.pmod("batch_id", F.lit(steps_per_epoch)).cast("int")
    lists = (
        df.withColumn("step", step)
        .repartitionByRange("step", "batch_id")
        .groupBy("step", "batch_id", "qid")
        .agg(
            F.first("query_vec").alias("query_vec"),
            F.sort_array(F.collect_list(F.struct("slot", "teacher", "passage_vec"))).alias("docs"),
        )
    )
    ordered = F.sort_array(F.collect_list(F.struct("qid", "query_vec", "docs")))
    packed = lists.groupBy("step", "batch_id").agg(ordered.alias("queries"))
    return packed.select(
        "batch_id",
        "step",
        F.size("queries").alias("n_queries"),
        F.array_distinct(F.transform("queries", lambda x: F.size(x["docs"]))).alias("k"),
        F.flatten("queries.query_vec").cast("array<double>").alias("query"),
        F.flatten(F.flatten(F.transform("queries", lambda x: x["docs"]["passage_vec"])))
        .cast("array<double>")
        .alias("passages"),
        F.flatten(F.transform("queries", lambda x: x["docs"]["teacher"])).alias("teacher"),
    )


def _arrays(row, dim_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Query, passages and teacher of a packed batch; None if its lists differ in size or a
    vector or score is missing or of another size."""
    if row.query is None or row.passages is None or row.teacher is None or len(row.k) != 1:
        return None
    n, k = row.n_queries, int(row.k[0])
    query, passages, teacher = (np.asarray(x, dtype=np.float64) for x in (row.query, row.passages, row.teacher))
    sizes = query.size == n * dim_in and passages.size == n * k * dim_in and teacher.size == n * k
    if not sizes or not all(np.isfinite(x).all() for x in (query, passages, teacher)):
        return None
    return query.reshape(n, dim_in), passages.reshape(n, k, dim_in), teacher.reshape(n, k)


BatchLoss = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, StudentSettings], tuple[float, np.ndarray]]
"""Loss and gradient of one batch: (weights, query, passages, teacher, settings)."""

# Places behind the gradient in a packed sum.
_LOSS, _BATCHES, _SKIPPED = -3, -2, -1


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(s, dtype="<f8") for s in frame["sums"])
    return pd.DataFrame({"part": [0], "sums": [total.tobytes()]})


def step_sums(
    packed: DataFrame, weights: np.ndarray, settings: StudentSettings, fan: int = 32, batch_loss: BatchLoss | None = None,
) -> np.ndarray:
    """The gradient entries of `packed`, then its loss and numbers of batches and skipped ones.

    Each task adds up its own batches into one array, and the arrays are added in two
    rounds, so one array of the model's size reaches the driver. A batch that exhausts memory
    or is not whole is counted as skipped and the rest goes on. `batch_loss` takes the place
    of `batch_loss_gradient`.
    """
    batch_loss = batch_loss or batch_loss_gradient

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(weights.size + 3)
        for frame in frames:
            for row in frame.itertuples(index=False):
                arrays = _arrays(row, weights.shape[1])
                try:
                    if arrays is None:
                        total[_SKIPPED] += 1
                        continue
                    loss, gradient = batch_loss(weights, *arrays, settings)
                except MemoryError:
                    total[_SKIPPED] += 1
                    continue
                total[: weights.size] += gradient.ravel()
                total[_LOSS] += loss
                total[_BATCHES] += 1
        part = TaskContext.get().partitionId() % fan
        yield pd.DataFrame({"part": [part], "sums": [total.tobytes()]})

    schema = "part int, sums binary"
    rows = (
        packed.select("n_queries", "k", "query", "passages", "teacher")
        .mapInPandas(sums, schema)
        .groupBy("part").applyInPandas(_added, schema)
        .withColumn("part", F.lit(0)).groupBy("part").applyInPandas(_added, schema)
        .collect()
    )
    return np.frombuffer(rows[0]["sums"], dtype="<f8") if rows else np.zeros(weights.size + 3)


@dataclass
class _AdamW:
    settings: StudentSettings
    step: int = 0
    mean: np.ndarray | None = None
    square: np.ndarray | None = None

    def update(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        s = self.settings
        norm = float(np.linalg.norm(gradient))
        gradient = gradient * min(1.0, s.clip / (norm + 1e-6))
        if self.mean is None:
            self.mean, self.square = np.zeros_like(weights), np.zeros_like(weights)
        self.step += 1
        self.mean = s.beta1 * self.mean + (1 - s.beta1) * gradient
        self.square = s.beta2 * self.square + (1 - s.beta2) * gradient**2
        mean = self.mean / (1 - s.beta1**self.step)
        square = self.square / (1 - s.beta2**self.step)
        weights = weights * (1 - s.lr * s.weight_decay)
        return weights - s.lr * mean / (np.sqrt(square) + s.epsilon)


@dataclass
class FittedStudent:
    weights: np.ndarray
    metrics: DataFrame
    """(run_id, phase, epoch, batch_id, loss, status) with one row per step"""

    history: list[tuple] = field(default_factory=list)


_STEP_SCHEMA = "run_id string, phase string, epoch long, batch_id long, loss double, status string"
_STUDENT_SCHEMA = (
    "run_id string, epoch long, weights array<double>, step long, mean array<double>, square array<double>, "
    "history array<struct<run_id: string, phase: string, epoch: long, batch_id: long, loss: double, status: string>>"
)


def initial_weights(dim_in: int, dim_out: int | None = None, seed: int = 42) -> np.ndarray:
    """The identity, or seeded orthonormal rows for a smaller output."""
    if dim_out is None or dim_out == dim_in:
        return np.eye(dim_in)
    square = np.random.default_rng(seed).standard_normal((dim_in, dim_in))
    return np.linalg.qr(square)[0][:dim_out]


def fit_student(
    lists: DataFrame, dim_in: int, dim_out: int | None = None, steps_per_epoch: int = 8,
    settings: StudentSettings | None = None, seed: int = 42, run_id: str = "student",
    batch_size: int | None = None, checkpoint: str | None = None,
    batch_loss: BatchLoss | None = None, max_quarantined: int = 16,
) -> FittedStudent:
    """Minimise the distillation loss of a linear projection with AdamW and clipping.

    A step uses the mean gradient of all batches with the same `batch_id mod
    steps_per_epoch`; with as many steps as batches every batch is its own step. With
    `batch_size` the queries are dealt to new batches every epoch, otherwise `lists` has
    them. Packed batches are written once (per epoch, if dealt anew), partitioned by step,
    and each step reads only its partition. The metrics have a row per step that had a whole
    batch and a `skipped` row per batch that could not be used.

    With `checkpoint`, a folder of this fit, weights, moments and metrics are written after
    every epoch, and a fit that was stopped goes on after the last written epoch with the same
    result. Only the newest state is read back.

    A batch that ends its worker or raises is found after the step's job has failed, and left out of
    that step and all later ones with a `skipped` row each, as if `lists` did not have it
    (`quarantine`); if more than `max_quarantined` do, the failure is raised. With `checkpoint` they are
    written, once found, to the folder beside it that `quarantine_path` names, and a fit that goes on
    does not meet them again. Batches dealt anew are left out for their epoch only.
    """
    settings = settings or StudentSettings()

    def batches(epoch: int) -> DataFrame:
        frame = lists
        if batch_size is not None:
            dealt = assign_batches(lists.select("qid").distinct(), batch_size, "qid", seed, epoch)
            frame = lists.drop("batch_id").join(dealt.select("qid", "batch_id"), "qid")
        packed = pack_batches(frame, steps_per_epoch)
        return materialise(packed, "student-batches", partition_by=["step"])

    def summed(rows: DataFrame) -> np.ndarray:
        if batch_loss is None:
            return step_sums(rows, weights, settings)
        return step_sums(rows, weights, settings, batch_loss=batch_loss)

    quarantine = Quarantine("batch_id", max_quarantined)
    if checkpoint:
        quarantine.found = _read_quarantine(lists.sparkSession, checkpoint, run_id)
    weights, optimizer, rows = initial_weights(dim_in, dim_out, seed), _AdamW(settings), []
    packed, spark = None, lists.sparkSession
    written = _written_epochs(spark, checkpoint, run_id, _STUDENT_SCHEMA) if checkpoint else None
    if written is not None:
        done = written.where(F.col("epoch") <= settings.epochs)
        for row in done.select("epoch", "history").orderBy("epoch").collect():
            rows += [tuple(step) for step in row["history"]]
        last = done.orderBy(F.col("epoch").desc()).first()
        if last:
            shape = weights.shape
            weights = np.array(last["weights"]).reshape(shape)
            if last["step"]:
                moments = (np.array(last[name]).reshape(shape) for name in ("mean", "square"))
                optimizer = _AdamW(settings, last["step"], *moments)
    begun = last["epoch"] if written is not None and last else 0
    for epoch in range(begun + 1, settings.epochs + 1):
        before = len(rows)
        if packed is None or batch_size is not None:
            packed = batches(epoch)
        for step in range(steps_per_epoch):
            scope, left_out = epoch if batch_size is not None else 0, quarantine.size()
            sums = quarantine.run(packed.where(F.col("step") == step), summed, scope)
            if checkpoint and quarantine.size() > left_out:
                _write_quarantine(spark, checkpoint, run_id, quarantine)
            ended = sum(key % steps_per_epoch == step for key in quarantine.keys(scope))
            skipped, found = int(sums[_SKIPPED]) + ended, sums[_BATCHES]
            rows += [(run_id, "train", epoch, step, None, "skipped")] * skipped
            if found:
                gradient = sums[: weights.size].reshape(weights.shape)
                weights = optimizer.update(weights, gradient / found)
                rows.append((run_id, "train", epoch, step, float(sums[_LOSS] / found), "ok"))
        if checkpoint:
            moments = [m.ravel().tolist() if m is not None else None for m in (optimizer.mean, optimizer.square)]
            state = (run_id, epoch, weights.ravel().tolist(), optimizer.step, *moments, rows[before:])
            spark.createDataFrame([state], _STUDENT_SCHEMA).coalesce(1).write.mode("append").parquet(checkpoint)
    metrics = spark.createDataFrame(rows, _STEP_SCHEMA)
    return FittedStudent(weights, metrics, rows)


_QUARANTINE_SCHEMA = "run_id string, scope long, batch_id long, error string"


def quarantine_path(checkpoint: str) -> str:
    """Where a fit with this checkpoint writes the batches it leaves out."""
    return f"{checkpoint.rstrip('/')}-quarantine"


def _write_quarantine(spark: SparkSession, checkpoint: str, run_id: str, quarantine: Quarantine) -> None:
    rows = [(run_id, scope, key, error) for scope, keys in quarantine.found.items() for key, error in keys]
    spark.createDataFrame(rows, _QUARANTINE_SCHEMA).coalesce(1).write.mode("append").parquet(quarantine_path(checkpoint))


def _read_quarantine(spark: SparkSession, checkpoint: str, run_id: str) -> dict[int, list[tuple[int, str]]]:
    """What was left out by scope: at most `limit` batches, once for every time one was added."""
    path = quarantine_path(checkpoint)
    if not _exists(spark, path):
        return {}
    found: dict[int, list[tuple[int, str]]] = {}
    rows = spark.read.schema(_QUARANTINE_SCHEMA).parquet(path).where(F.col("run_id") == run_id)
    for row in rows.dropDuplicates(["scope", "batch_id"]).orderBy("scope", "batch_id").collect():
        found.setdefault(row["scope"], []).append((row["batch_id"], row["error"]))
    return found


def project(vector: Column | str, weights: np.ndarray) -> Column:
    """Student vector of a base vector, one matrix product per Arrow batch."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.stack(batch.to_list()) @ weights.T) if len(batch) else [])

    return run.asNondeterministic()(F.col(vector) if isinstance(vector, str) else vector)


def student_triplet_scores(vectors: DataFrame, weights: np.ndarray) -> DataFrame:
    """Triplet scores of the student for `anchor_vec`, `positive_vec`, `negative_vec`."""
    names = ("anchor_vec", "positive_vec", "negative_vec")
    return vector_triplet_scores(
        vectors.withColumns({name: project(name, weights) for name in names})
    )


def save_student(spark: SparkSession, weights: np.ndarray, path: str) -> None:
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(weights)]
    spark.createDataFrame(rows, "row int, weights array<double>").coalesce(1).write.mode(
        "overwrite"
    ).parquet(path)


def load_student(spark: SparkSession, path: str) -> np.ndarray:
    rows: Sequence = spark.read.parquet(path).orderBy("row").collect()
    return np.array([row["weights"] for row in rows])
