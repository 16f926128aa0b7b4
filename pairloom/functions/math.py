"""Similarity and loss arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(
        _column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_of(ab: Column | str, aa: Column | str, bb: Column | str) -> Column:
    """Cosine from the three dot products; 0 when either vector is zero."""
    ab, aa, bb = _column(ab), _column(aa), _column(bb)
    return F.when((aa > 0) & (bb > 0), ab / (F.sqrt(aa) * F.sqrt(bb))).otherwise(F.lit(0.0))


def normalize_cosine(value: Column | str) -> Column:
    """[-1, 1] to [0, 1]."""
    return (_column(value) + 1.0) / 2.0


def relu(value: Column | str) -> Column:
    return F.greatest(_column(value), F.lit(0.0))


def sigmoid(value: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_column(value)))


def bce_with_logits(logit: Column | str, label: Column | str) -> Column:
    """Binary cross-entropy of one row in the form that cannot overflow."""
    logit, label = _column(logit), _column(label)
    return relu(logit) - logit * label + F.log1p(F.exp(-F.abs(logit)))
