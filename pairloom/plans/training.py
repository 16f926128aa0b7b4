"""Registered queries of whole trainings, which SQL cannot state: tests hold them against
sequential numpy training."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairloom.operators import evaluate, fit
from pairloom.plans import views
from pairloom.plans.catalog import Query, _rounded_report, _triplet_vectors, rounded
from pairloom.session import shared_path

QUERIES: dict[str, Query] = {}
SETTINGS = fit.StudentSettings(epochs=2, lr=0.01)
STEPS = 4


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _trained(spark, sf_dir) -> fit.FittedStudent:
    return fit.fit_student(
        views.batched_lists(spark, sf_dir), dim_in=64, steps_per_epoch=STEPS, settings=SETTINGS
    )


@query
def trained_student(spark, sf_dir) -> DataFrame:
    """Loss per step of a student trained on the vector lists."""
    return rounded(_trained(spark, sf_dir).metrics, "loss")


@query
def trained_student_report(spark, sf_dir) -> DataFrame:
    """Train a student, save it, load it and report its triplet scores."""
    path = shared_path(spark, "student")
    fit.save_student(spark, _trained(spark, sf_dir).weights, path)
    weights = fit.load_student(spark, path)
    return _rounded_report(
        evaluate.eval_report(fit.student_triplet_scores(_triplet_vectors(spark, sf_dir), weights))
    )
