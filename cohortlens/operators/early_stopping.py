"""Networks trained in rounds until the loss on held-out rows stops falling."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cohortlens.operators.balance import oversample
from cohortlens.operators.features import bucket_of
from cohortlens.operators.models import class_probabilities, classifier_metrics, held_out_scores
from cohortlens.operators.networks import loss_and_accuracy, mean_loss, minimise, network_model, packed, start_weights
from cohortlens.runtime import move_whole, new_path, path_exists
from cohortlens.schema import FEATURES
from cohortlens.sources.tables import write_once

CURVE = (
    "round int, iterations int, train_loss double, train_accuracy double, "
    "validation_loss double, validation_accuracy double"
)


def mark_held_out(rows: DataFrame, row_id: str, buckets: int = 5) -> DataFrame:
    """``is_held_out`` for one bucket of the ids, independent of the folds of ``assign_folds``."""
    salted = F.concat(F.lit("held-out-"), F.col(row_id).cast("string"))
    return rows.withColumn("is_held_out", F.coalesce(bucket_of(salted, buckets) == 0, F.lit(False)))


def best_round(curve: Sequence[Row]) -> int:
    """The round of the lowest loss on held-out rows, the first of equal ones."""
    return min(curve, key=lambda r: (r.validation_loss, r["round"]))["round"]


def is_flat(curve: Sequence[Row], patience: int) -> bool:
    """Whether the last ``patience`` rounds all failed to go below the best one before them."""
    return bool(curve) and curve[-1]["round"] - best_round(curve) >= patience


def _in_store(spark, path: str, write) -> None:
    """What ``write`` saves below a folder, moved to its name when it is whole."""
    fresh = f"{path}-new-{uuid.uuid4().hex}"
    write(fresh)
    move_whole(spark, fresh, path)


def fit_until_flat(
    frame: DataFrame,
    row_id: str,
    features: Sequence[str] = FEATURES,
    label: str = "label",
    classes: int = 3,
    hidden: Sequence[int] = (32,),
    step: int = 5,
    rounds: int = 20,
    patience: int = 2,
    buckets: int = 5,
    balanced: bool = False,
    seed: int = 42,
    store: str | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """The network of the best round and the curve of all rounds.

    A round goes on from the weights of the one before for ``step`` iterations and is then
    measured on the rows it learns from and on one of ``buckets`` parts of the ids, which it
    never learns from. Training ends after ``patience`` rounds without a lower loss there, or
    after ``rounds``. Rows without a label do not count; those without an id are learned from.
    With ``balanced`` the rows to learn from are oversampled, the held-out ones are not.

    A round is saved below ``store`` when it is whole. A rerun with the same folder goes on
    after the last one, so the folder belongs to one training table and one setting. The curve
    is ``round, iterations``, loss and accuracy of both parts, and ``is_best``; a network
    without held-out rows cannot tell when to stop, which is a ValueError.
    """
    spark = frame.sparkSession
    store = store or new_path(spark, "rounds")
    marked = mark_held_out(frame.filter(F.col(label).isNotNull()), row_id, buckets)
    marked = write_once(marked.select(*features, label, "is_held_out"), "marked")
    if not marked.filter("is_held_out").take(1):
        raise ValueError("no held-out rows to validate on")
    learned = marked.filter("NOT is_held_out")
    if balanced:
        learned = oversample(learned.drop("is_held_out"), label, features).select(*features, label)
        learned = learned.withColumn("is_held_out", F.lit(False))
    assembler = VectorAssembler(inputCols=list(features), outputCol="raw")
    rows = assembler.transform(learned.unionByName(marked.filter("is_held_out")))
    rows = write_once(rows.select("raw", label, "is_held_out"), "raw")

    if not path_exists(spark, f"{store}/scale"):
        scaling = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
        scaled = scaling.fit(rows.filter("NOT is_held_out"))
        _in_store(spark, f"{store}/scale", scaled.save)
    scale = StandardScalerModel.load(f"{store}/scale")
    rows = write_once(scale.transform(rows).select("features", label, "is_held_out"), "scaled")
    layers = [len(features), *hidden, classes]
    learned = packed(rows.filter("NOT is_held_out"), label, classes, "float64")
    held = packed(rows.filter("is_held_out"), label, classes, "float64")
    loss = mean_loss(learned, layers)

    def measured(number: int, weights: np.ndarray, done: int) -> DataFrame:
        sides = [loss_and_accuracy(side, layers, weights) for side in (learned, held)]
        return spark.createDataFrame([(number, done, *sides[0], *sides[1])], CURVE).coalesce(1)

    def save_round(number: int, weights: np.ndarray) -> None:
        weights, done = minimise(loss, weights, step)
        fitted = network_model(spark, weights, layers, label)

        def write(path: str) -> None:
            fitted.save(f"{path}/net")
            measured(number, weights, done).write.parquet(f"{path}/curve")

        _in_store(spark, f"{store}/round-{number}", write)

    curve: list[Row] = []
    weights = start_weights(layers, seed)
    try:
        while len(curve) < rounds and not is_flat(curve, patience):
            path = f"{store}/round-{len(curve)}"
            if not path_exists(spark, path):
                save_round(len(curve), weights)
            weights = MultilayerPerceptronClassificationModel.load(f"{path}/net").weights.toArray()
            curve.append(spark.read.schema(CURVE).parquet(f"{path}/curve").first())
    finally:
        learned.unpersist()
        held.unpersist()

    best = best_round(curve)
    net = MultilayerPerceptronClassificationModel.load(f"{store}/round-{best}/net")
    told = spark.createDataFrame(curve, CURVE).withColumn("is_best", F.col("round") == best)
    return PipelineModel(stages=[assembler, scale, net]), told


def kfold_until_flat(
    frame: DataFrame,
    row_id: str,
    features: Sequence[str] = FEATURES,
    label: str = "label",
    folds: int = 5,
    **settings,
) -> DataFrame:
    """``fold, accuracy, loss`` of networks that stop by themselves.

    The rows that tell a network when to stop are taken from its training folds, so the fold it
    is measured on has no part in it.
    """
    rows = frame.filter(F.col(label).isNotNull())

    def fit(part: DataFrame) -> PipelineModel:
        return fit_until_flat(part, row_id, features, label, **settings)[0]

    scored = held_out_scores(rows, row_id, folds, fit)
    return classifier_metrics(class_probabilities(scored), label, ["fold"])
