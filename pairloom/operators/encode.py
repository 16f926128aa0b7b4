"""Text to vector. Any encoder can be plugged in; the built-in one hashes tokens. A missing
text is an empty one for all encoders."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import WHITESPACE

DEFAULT_DIM = 64
KNOWN_TOKENS = 1 << 18
"""Lanes a task remembers before it starts anew."""
RUN_CHARS = 1 << 20
"""Text that an encoder gets at once, about: an Arrow batch may hold much more."""
_BREAK = re.compile(WHITESPACE)


Encoder = Callable[[Iterator[list[str]]], Iterator[np.ndarray]]
"""User encoder: batches of texts in, matrices with one row per text out. It runs once per
task, so a model loaded before its loop is loaded once per worker."""


def hashed_encoder(dim: int = DEFAULT_DIM) -> Encoder:
    """The built-in encoder: unit vectors of signed counts of hashed tokens of whole texts.

    The first 60 bits of a token's md5 choose one of 2 * dim lanes; the lower half counts
    up, the upper half down. A task hashes each distinct token once.
    """

    def lane(token: str) -> int:
        return int(hashlib.md5(token.encode("utf-8", "replace")).hexdigest()[:15], 16) % (2 * dim)

    def run(batches: Iterator[list[str]]) -> Iterator[np.ndarray]:
        known: dict[str, int] = {}
        for texts in batches:
            if len(known) > KNOWN_TOKENS:
                known.clear()
            lanes: list[int] = []
            sizes = np.zeros(len(texts), dtype=np.int64)
            for row, text in enumerate(texts):
                before = len(lanes)
                for token in _BREAK.split(text.lower()):
                    if token:
                        found = known.get(token)
                        if found is None:
                            found = known[token] = lane(token)
                        lanes.append(found)
                sizes[row] = len(lanes) - before
            yield _fold(np.array(lanes, dtype=np.int64), sizes, dim)

    return run


def projected_encoder(encoder: Encoder, weights: np.ndarray) -> Encoder:
    """An encoder followed by a projection, such as the weights of a fitted student."""

    def run(batches: Iterator[list[str]]) -> Iterator[np.ndarray]:
        for matrix in encoder(batches):
            yield np.asarray(matrix, dtype=np.float64) @ weights.T

    return run


def _fold(lanes: np.ndarray, sizes: np.ndarray, dim: int) -> np.ndarray:
    """Signed lane counts per row, scaled to unit length; an empty text is a zero vector."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(rows * (2 * dim) + lanes, minlength=len(sizes) * 2 * dim)
    counts = counts.reshape(len(sizes), 2 * dim)
    out = (counts[:, :dim] - counts[:, dim:]).astype(np.float64)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def _once(udf):
    """Keep the optimizer from repeating a costly function, as it may when it moves filters."""
    return udf.asNondeterministic()


def _runs(texts: Sequence[str]) -> list[list[str]]:
    """The texts in runs of about `RUN_CHARS` characters; one empty run if there are none."""
    runs, size = [[]], 0
    for text in texts:
        if size >= RUN_CHARS:
            runs.append([])
            size = 0
        runs[-1].append(text)
        size += len(text)
    return runs


def _encode_batches(
    batches: Iterator[tuple[pd.Series, ...]], encoder: Encoder
) -> Iterator[list[np.ndarray]]:
    """One matrix per text column and batch; equal texts of a batch are encoded once. What the
    encoder holds for its texts is bounded by a run of them, not by the batch."""
    pending: list[tuple[list[np.ndarray], int]] = []

    def distinct_texts() -> Iterator[list[str]]:
        for columns in batches:
            codes, uniques = pd.factorize(pd.concat(columns, ignore_index=True).fillna(""))
            runs = _runs(uniques)
            pending.append((np.split(codes, len(columns)), len(runs)))
            yield from runs

    found: list[np.ndarray] = []
    for part in encoder(distinct_texts()):
        found.append(np.asarray(part, dtype=np.float64))
        columns, n_runs = pending[0]
        if len(found) == n_runs:
            matrix = np.concatenate(found)
            found.clear()
            pending.pop(0)
            yield [matrix[codes] for codes in columns]


def encoded(text: Column | str, encoder: Encoder | None = None, dim: int = DEFAULT_DIM) -> Column:
    """Vector column for a text column; `encoder=None` uses the built-in one.

    This needs no shuffle, and a text repeated over a large share of the table still costs
    one call per Arrow batch.
    """
    encoder = encoder or hashed_encoder(dim)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for (matrix,) in _encode_batches(((texts,) for texts in batches), encoder):
            yield pd.Series(list(matrix))

    return _once(run)(F.col(text) if isinstance(text, str) else text)


def _row_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    dots = np.einsum("ij,ij->i", a, b)
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def text_cosines(
    query: Column, passages: list[Column], encoder: Encoder | None = None, dim: int = DEFAULT_DIM,
) -> Column:
    """ARRAY<DOUBLE>: cosine of the query text with each passage text of the row."""
    encoder = encoder or hashed_encoder(dim)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for first, *others in _encode_batches(batches, encoder):
            yield pd.Series(list(np.column_stack([_row_cosines(first, m) for m in others])))

    return _once(run)(query, *passages)


def encode(
    df: DataFrame, text_col: str, out: str = "vector", encoder: Encoder | None = None,
    dim: int = DEFAULT_DIM,
) -> DataFrame:
    """Add a vector for every row of `df`."""
    return df.withColumn(out, encoded(text_col, encoder, dim))

