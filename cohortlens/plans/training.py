"""Training and batch scoring of the stacked classifier."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from cohortlens.operators.features import training_frame
from cohortlens.operators.filters import require_domain
from cohortlens.operators.models import (
    StackedModel,
    fit_stack,
    kfold_stack,
    mean_and_spread,
    score_students,
)
from cohortlens.runtime import scratch
from cohortlens.schema import LABEL_CUTS
from cohortlens.sources.tables import log_metrics, write_spread


def train(
    facts: DataFrame,
    cohorts: Sequence[int],
    model_path: str,
    metrics_path: str,
    cuts: tuple[float, float] = LABEL_CUTS,
    folds: int = 5,
    max_iter: int = 60,
    hidden: Sequence[int] = (32,),
) -> DataFrame:
    """Evaluate the stack by folds, log the means, fit on everything and save; returns the fold scores.

    The intermediate tables are removed when the model is saved.
    """
    spark = facts.sparkSession
    with scratch(spark):
        frame = write_spread(training_frame(facts, cohorts, cuts), "training")
        folded = kfold_stack(frame, "student_id", folds, max_iter, hidden)
        scores = spark.createDataFrame(folded.collect(), folded.schema)  # one row per fold
        log_metrics(spark, metrics_path, uuid.uuid4().hex, mean_and_spread(scores).first().asDict())
        fit_stack(frame, "student_id", folds, max_iter, hidden).save(model_path)
    return scores


def predict(sheet: DataFrame, model_path: str) -> DataFrame:
    """Confidences and verdicts for a sheet of students; a wrong band stops the run."""
    return score_students(StackedModel.load(model_path), require_domain(sheet, "CFIT"))
