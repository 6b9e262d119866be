"""Classifiers and regressors on Spark ML, their evaluation and the stacked classifier."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.scores import verdict
from cohortlens.functions.text import percent_text
from cohortlens.operators.balance import balanced_vectors
from cohortlens.operators.features import assign_folds, binary_targets, log_target, one_hot, split_by_hash
from cohortlens.operators.forests import StoredForest, bin_cuts, fit_boosted, grown_trees, growth_of, packed
from cohortlens.operators.networks import NetworkClassifier
from cohortlens.runtime import move_whole, new_path, path_exists
from cohortlens.schema import BANDS, BASE_SCORES, COURSES, FEATURES, GRADE_MAX, STACK_FEATURES
from cohortlens.sources.tables import write_once

Fit = Callable[[DataFrame], Model]
# Statistics that the tasks of one pass over the rows may hold for the nodes of a forest.
FOREST_MEMORY_MB = 512
# Rows times trees up to which a forest is Spark's own, whose trees are all held by the driver.
FOREST_CELLS = 2_000_000


def assemble(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Feature vector in the shared order."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def network(
    features: Sequence[str],
    classes: int,
    hidden: Sequence[int] = (32,),
    max_iter: int = 60,
    label: str = "label",
    seed: int = 42,
) -> Pipeline:
    """Feed-forward network on standardised features with class probabilities."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True),
            NetworkClassifier([len(features), *hidden, classes], label, max_iter, seed),
        ]
    )


def class_probabilities(scored: DataFrame, name: str = "p") -> DataFrame:
    """Probabilities as an array and the class of the largest (``predicted``); the other columns
    of the model are dropped."""
    return scored.withColumns(
        {name: vector_to_array("probability"), "predicted": F.col("prediction").cast("int")}
    ).drop("raw", "features", "rawPrediction", "probability", "prediction")


def likeliest_class(p: Column) -> Column:
    """The class of the largest probability, the first of equal ones."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def classifier_metrics(
    scored: DataFrame, label: str = "label", by: Sequence[str] = (), probabilities: str = "p"
) -> DataFrame:
    """Accuracy and log loss of rows with class probabilities, in one pass."""
    p = F.col(probabilities)
    best = likeliest_class(p)
    own = F.greatest(F.get(p, F.col(label).cast("int")), F.lit(1e-15))
    return scored.groupBy(*by).agg(
        F.avg((best == F.col(label)).cast("double")).alias("accuracy"),
        F.avg(-F.ln(own)).alias("loss"),
    )


def mean_and_spread(folds: DataFrame, columns: Sequence[str] = ("accuracy", "loss")) -> DataFrame:
    """Mean and population standard deviation over the folds."""
    return folds.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    )


def fit_balanced(estimator: Pipeline, label: str, features: Sequence[str]) -> Fit:
    """Fit a network of ``network`` on oversampled rows, which are packed as they are made."""
    assembler, _, classifier = estimator.getStages()

    def fit(rows: DataFrame) -> Model:
        return PipelineModel([assembler, *classifier.fit_scaled(balanced_vectors(rows, label, features))])

    return fit


def fit_all(jobs: Sequence[Callable[[], Model]], at_once: int = 5) -> list[Model]:
    """Run independent fits side by side, so that the cluster is not idle between small jobs."""
    with ThreadPool(min(at_once, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(lambda job: job()), jobs)


def held_out_scores(frame: DataFrame, row_id: str, folds: int, fit: Fit) -> DataFrame:
    """Every row scored by a model that was fitted without its fold."""
    marked = assign_folds(frame, row_id, folds)
    fitted = fit_all([partial(fit, marked.filter(F.col("fold") != fold)) for fold in range(folds)])
    parts = [m.transform(marked.filter(F.col("fold") == fold)) for fold, m in enumerate(fitted)]
    return reduce(DataFrame.unionByName, parts)


def scored_by_every_fold(frame: DataFrame, row_id: str, folds: int, fit: Fit) -> DataFrame:
    """Every row scored by the models of all folds.

    ``fold`` is that of the model, ``held_out`` tells whether it was fitted without the row.
    """
    marked = assign_folds(frame, row_id, folds)
    return _scored_by_all(marked, fit_all([partial(fit, marked.filter(F.col("fold") != fold)) for fold in range(folds)]))


def _scored_by_all(marked: DataFrame, fitted: Sequence[Model]) -> DataFrame:
    own = marked.withColumnRenamed("fold", "own_fold")
    parts = [
        model.transform(own).withColumns({"fold": F.lit(fold), "held_out": F.col("own_fold") == fold})
        for fold, model in enumerate(fitted)
    ]
    return reduce(DataFrame.unionByName, parts).drop("own_fold")


def train_validation_gap(scored: DataFrame, measure: Column, by: Sequence[str] = ("fold",)) -> DataFrame:
    """``train, validation, gap`` of each fold: the mean of ``measure`` over the rows its model
    was fitted on and over those held out, and the first less the second, in one pass.

    Rows whose measure is NULL do not count; a side without rows is NULL, and so is its gap.
    """
    held_out = F.col("held_out")
    means = scored.groupBy(*by).agg(
        F.avg(F.when(~held_out, measure)).alias("train"), F.avg(F.when(held_out, measure)).alias("validation")
    )
    return means.withColumn("gap", F.col("train") - F.col("validation"))


def kfold_classifier(
    frame: DataFrame,
    row_id: str,
    features: Sequence[str] = FEATURES,
    label: str = "label",
    folds: int = 5,
    max_iter: int = 60,
    hidden: Sequence[int] = (32,),
    balanced: bool = True,
) -> DataFrame:
    """``fold, accuracy, loss``; oversampling sees the training folds only."""
    frame = frame.filter(F.col(label).isNotNull())
    estimator = network(features, 3, hidden, max_iter, label)
    fit = fit_balanced(estimator, label, features) if balanced else estimator.fit
    scored = held_out_scores(frame, row_id, folds, fit)
    return classifier_metrics(class_probabilities(scored), label, ["fold"])


@dataclass
class StackedModel:
    """Three binary models whose scores join the features of a three-class model."""

    base: dict[str, PipelineModel]
    top: PipelineModel

    def base_scores(self, df: DataFrame) -> DataFrame:
        for name in BASE_SCORES:
            scored = class_probabilities(self.base[name].transform(df), "_p")
            df = scored.withColumn(name, F.col("_p")[1]).drop("_p", "predicted")
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the base scores, the probabilities ``p`` of fail, pass, excel and the class ``predicted``."""
        return class_probabilities(self.top.transform(self.base_scores(df)))

    def save(self, path: str) -> None:
        for name, model in {**self.base, "top": self.top}.items():
            model.write().overwrite().save(f"{path}/{name}")

    @staticmethod
    def load(path: str) -> StackedModel:
        base = {name: PipelineModel.load(f"{path}/{name}") for name in BASE_SCORES}
        return StackedModel(base, PipelineModel.load(f"{path}/top"))


def _base_fits(marked: DataFrame, max_iter: int, hidden: Sequence[int]) -> list[Callable[[], Model]]:
    jobs = []
    for name in BASE_SCORES:
        target = f"target_{name}"
        fit = fit_balanced(network(FEATURES, 2, hidden, max_iter, target), target, FEATURES)
        jobs.append(partial(fit, marked))
    return jobs


def _score_held_out(marked: DataFrame, folds: int, fitted: list[Model]) -> DataFrame:
    """Base scores of every fold from the models fitted without it."""
    parts = []
    for fold in range(folds):
        base = dict(zip(BASE_SCORES, fitted[fold * len(BASE_SCORES):]))
        parts.append(StackedModel(base, None).base_scores(marked.filter(F.col("fold") == fold)))
    scored = reduce(DataFrame.unionByName, parts)
    return write_once(scored.drop("fold", *[f"target_{n}" for n in BASE_SCORES]), "stacked")


def _held_out_fits(marked: DataFrame, folds: int, max_iter: int, hidden: Sequence[int]):
    return [
        job
        for fold in range(folds)
        for job in _base_fits(marked.filter(F.col("fold") != fold), max_iter, hidden)
    ]


def _mark(frame: DataFrame, row_id: str, folds: int, salt: str = "") -> DataFrame:
    return assign_folds(binary_targets(frame.filter(F.col("label").isNotNull())), row_id, folds, salt)


def stacked_features(
    frame: DataFrame, row_id: str, folds: int = 5, max_iter: int = 60, hidden: Sequence[int] = (32,)
) -> DataFrame:
    """Training rows with base scores from models that did not see them."""
    marked = _mark(frame, row_id, folds)
    return _score_held_out(marked, folds, fit_all(_held_out_fits(marked, folds, max_iter, hidden)))


def fit_stack(
    frame: DataFrame,
    row_id: str,
    folds: int = 5,
    max_iter: int = 60,
    hidden: Sequence[int] = (32,),
    salt: str = "",
) -> StackedModel:
    """Base models on all rows; the top model on out-of-fold base scores.

    The pass model is fitted on the pass target.
    """
    marked = _mark(frame, row_id, folds, salt)
    jobs = _base_fits(marked, max_iter, hidden) + _held_out_fits(marked, folds, max_iter, hidden)
    fitted = fit_all(jobs)
    base = dict(zip(BASE_SCORES, fitted))
    stacked = _score_held_out(marked, folds, fitted[len(base):])
    top = fit_balanced(network(STACK_FEATURES, 3, hidden, max_iter), "label", STACK_FEATURES)(stacked)
    return StackedModel(base, top)


def base_metrics(scored: DataFrame, label: str = "label") -> DataFrame:
    """``model, accuracy, loss`` of every base score against its own target, in one pass.

    A score of one half or more says yes.
    """
    entries = []
    for k, name in enumerate(BASE_SCORES):
        yes = F.col(label) == k
        own = F.greatest(F.when(yes, F.col(name)).otherwise(1 - F.col(name)), F.lit(1e-15))
        right = ((F.col(name) >= 0.5) == yes).cast("double")
        entries.append(F.struct(F.lit(name).alias("model"), right.alias("right"), (-F.ln(own)).alias("loss")))
    rows = scored.filter(F.col(label).isNotNull()).select(F.inline(F.array(*entries)))
    return rows.groupBy("model").agg(F.avg("right").alias("accuracy"), F.avg("loss").alias("loss"))


def kfold_stack(
    frame: DataFrame, row_id: str, folds: int = 5, max_iter: int = 60, hidden: Sequence[int] = (32,)
) -> DataFrame:
    """``fold, accuracy, loss`` of the whole stacked model.

    No label of a fold reaches a model that scores it: its base models and its top model are
    fitted on the other folds alone. The base scores that the top model of fold i learns from
    are, for the rows of another fold j, those of base models without i and j. So the inner
    folds are the other outer ones, and the models without i and j serve both: 45 base fits
    for five folds. Of two folds each is halved, for there is no other one to leave out.
    """
    pieces = folds if folds > 2 else 2 * folds
    marked = write_once(_mark(frame, row_id, pieces), "marked")
    outer = [frozenset(range(fold, pieces, folds)) for fold in range(folds)]
    inner = {fold: [p for p in range(pieces) if p not in outer[fold]] for fold in range(folds)}
    left_out = list(dict.fromkeys([*outer, *(outer[fold] | {p} for fold in inner for p in inner[fold])]))
    jobs = [job for out in left_out for job in _base_fits(_without(marked, out), max_iter, hidden)]
    fitted = iter(fit_all(jobs))
    base = {out: StackedModel({name: next(fitted) for name in BASE_SCORES}, None) for out in left_out}
    top = fit_balanced(network(STACK_FEATURES, 3, hidden, max_iter), "label", STACK_FEATURES)

    def fit_top(fold: int) -> Model:
        parts = [base[outer[fold] | {p}].base_scores(marked.filter(F.col("fold") == p)) for p in inner[fold]]
        return top(write_once(reduce(DataFrame.unionByName, parts), "stacked"))

    tops = fit_all([partial(fit_top, fold) for fold in range(folds)])
    scored = [
        StackedModel(base[outer[fold]].base, tops[fold])
        .transform(marked.filter(F.col("fold").isin(*outer[fold])))
        .withColumn("fold", F.lit(fold))
        for fold in range(folds)
    ]
    return classifier_metrics(reduce(DataFrame.unionByName, scored), "label", ["fold"])


def _without(marked: DataFrame, out: Iterable[int]) -> DataFrame:
    return marked.filter(~F.col("fold").isin(*out))


def score_students(model: StackedModel, students: DataFrame, row_id: str = "IDNumber") -> DataFrame:
    """Confidences and verdict of every student for each course, one row per student.

    Incomplete rows drop out. Both courses are scored side by side, so no row moves.
    """
    numbers = [c for c in FEATURES if c.startswith("attr_")]
    rows = one_hot(students, "CFIT", BANDS, prefix="cfit").select(
        row_id, *[F.col(c).cast("double").alias(c) for c in numbers], *[f"cfit_{band}" for band in BANDS]
    )
    rows = rows.dropna("any")
    out = [F.col(row_id)]
    for course in COURSES:
        flags = {f"course_{c.lower()}": F.lit(1.0 if c == course else 0.0) for c in COURSES}
        scored = model.transform(rows.withColumns(flags)).withColumnRenamed("p", f"p_{course}")
        rows = scored.drop(*flags, *BASE_SCORES, "predicted")
        p = F.col(f"p_{course}")
        out += [
            percent_text(p[1] + p[2]).alias(f"{course}-Pass Confidence"),
            percent_text(p[0]).alias(f"{course}-Failure Confidence"),
            percent_text(p[2]).alias(f"{course}-Excellence Confidence"),
            verdict(p).alias(f"{course}-Verdict"),
        ]
    return rows.select(*out)


@dataclass
class Forest:
    """A forest held as parts, each a forest of some of its trees on the column ``features``.

    Its predictions are the means over the parts by their numbers of trees, which are those of
    one forest of all the trees.
    """

    parts: list[Model]

    @property
    def trees(self) -> int:
        return sum(part.getNumTrees for part in self.parts)

    def _mean(self, df: DataFrame, column: str, read: Callable[[Column], Column]) -> tuple[DataFrame, Column]:
        """The frame with a column of each part, and the mean of what is read from them, as an array."""
        own = []
        for number, part in enumerate(self.parts):
            part, name = part.copy(), f"_part_{number}"
            for output in ("predictionCol", "rawPredictionCol", "probabilityCol"):
                if part.hasParam(output):
                    part.set(part.getParam(output), name if output == column else "")
            df = part.transform(df).withColumn(name, read(F.col(name)))
            own.append(F.struct(F.lit(part.getNumTrees / self.trees).alias("w"), F.col(name).alias("x")))
        zeros = F.transform(own[0]["x"], lambda x: F.lit(0.0))
        mean = F.aggregate(F.array(*own), zeros, lambda m, o: F.zip_with(m, o["x"], lambda a, x: a + o["w"] * x))
        return df, mean

    def regress(self, df: DataFrame) -> DataFrame:
        """Adds the number ``prediction``."""
        scored, mean = self._mean(df, "predictionCol", F.array)
        return scored.select(*df.columns, mean[0].alias("prediction"))

    def classify(self, df: DataFrame) -> DataFrame:
        """Adds the class probabilities ``p`` and the class ``predicted``, the first of equally likely ones."""
        scored, mean = self._mean(df, "probabilityCol", vector_to_array)
        return scored.select(*df.columns, mean.alias("p")).withColumn("predicted", likeliest_class(F.col("p")))


def fit_forest(
    estimator: Estimator, rows: DataFrame, trees: int, store: str | None = None, part_trees: int = 100, at_once: int = 4
) -> Forest | StoredForest:
    """The forest of ``estimator`` with so many trees, fitted in parts side by side.

    A part is saved below ``store`` when it is ready, and a rerun with the same folder takes it
    from there; it is moved to its name when it is whole, so a lost driver leaves no half of one.
    The folder belongs to one training table and one setting of the estimator. Part k has the
    seed of the estimator plus k; a forest of one part is Spark's own.

    Of more than ``FOREST_CELLS`` rows times trees, the trees are grown and kept by the tasks.
    """
    spark = rows.sparkSession
    store = store or new_path(spark, "forest")
    rows = write_once(rows.select("features", estimator.getLabelCol()), "forest-rows")
    if rows.count() * trees > FOREST_CELLS:
        return _grow_forest(estimator, rows, trees, store, part_trees, at_once)
    saved = {RandomForestClassifier: RandomForestClassificationModel, RandomForestRegressor: RandomForestRegressionModel}

    def fit(number: int, size: int) -> Model:
        path = f"{store}/part-{number}-of-{size}-trees"
        if path_exists(spark, path):
            return saved[type(estimator)].load(path)
        settings = {estimator.numTrees: size, estimator.seed: estimator.getSeed() + number}
        model = estimator.fit(rows, settings)
        fresh = f"{store}/new-{uuid.uuid4().hex}"
        model.save(fresh)
        move_whole(spark, fresh, path)
        return model

    sizes = [min(part_trees, trees - start) for start in range(0, trees, part_trees)]
    return Forest(fit_all([partial(fit, number, size) for number, size in enumerate(sizes)], at_once))


def _grow_forest(
    estimator: Estimator, rows: DataFrame, trees: int, store: str, part_trees: int, at_once: int
) -> StoredForest:
    """The parts of ``fit_forest`` as tables of trees: same bins, samples, choices of features and depth."""
    spark, label = rows.sparkSession, estimator.getLabelCol()

    def settle(name: str, make: Callable[[], DataFrame]) -> str:
        path = f"{store}/{name}"
        if not path_exists(spark, path):
            fresh = f"{store}/new-{uuid.uuid4().hex}"
            make().write.parquet(fresh)
            move_whole(spark, fresh, path)
        return path

    def limits() -> DataFrame:
        cells = [(k, [float(v) for v in own]) for k, own in enumerate(bin_cuts(rows))]
        return spark.createDataFrame(cells, "feature int, cuts array<double>")

    stored = spark.read.parquet(settle("cuts", limits)).orderBy("feature").collect()
    cuts = [np.array(r.cuts) for r in stored]
    classes = 0
    if isinstance(estimator, RandomForestClassifier):
        classes = int(rows.agg(F.max(label)).first()[0]) + 1
    strategy = estimator.getFeatureSubsetStrategy()
    subset = math.ceil(math.sqrt(len(cuts))) if strategy == "sqrt" else min(int(strategy), len(cuts))
    growth = growth_of(cuts, classes, subset, estimator.getMaxDepth(), estimator.getSeed())
    blocks = packed(rows, cuts, F.col(label))

    def part(start: int, size: int) -> str:
        name = f"grown-{start}-of-{size}-trees"
        return settle(name, lambda: grown_trees(blocks, growth, start, size))

    sizes = [(start, min(part_trees, trees - start)) for start in range(0, trees, part_trees)]
    paths = fit_all([partial(part, *size) for size in sizes], at_once)
    return StoredForest(spark, paths, cuts, classes, trees)


def forest_regression(
    frame: DataFrame,
    row_id: str,
    features: Sequence[str] = FEATURES,
    trees: int = 1000,
    depth: int = 30,
    seed: int = 42,
    store: str | None = None,
    part_trees: int = 100,
) -> tuple[Forest | StoredForest, DataFrame]:
    """Forest on the logarithm of the weight, and the residuals of the test rows.

    Residuals are on the original scale. Spark limits the depth of a tree to 30. See
    ``fit_forest`` for ``store`` and ``part_trees``.
    """
    marked = assemble(split_by_hash(log_target(frame.filter(F.col("weighted") > 0)), row_id), features)
    estimator = RandomForestRegressor(
        labelCol="log_target",
        maxDepth=depth,
        featureSubsetStrategy="sqrt",
        cacheNodeIds=True,
        maxMemoryInMB=FOREST_MEMORY_MB,
        seed=seed,
    )
    model = fit_forest(estimator, marked.filter(~F.col("is_test")), trees, store, part_trees)
    scored = model.regress(marked.filter("is_test"))
    actual, predicted = F.exp("log_target"), F.exp("prediction")
    residuals = scored.select(
        row_id,
        actual.alias("actual"),
        predicted.alias("predicted"),
        F.abs(actual - predicted).alias("difference"),
    )
    return model, residuals


def mean_absolute_error(residuals: DataFrame) -> DataFrame:
    return residuals.agg(F.avg("difference").alias("mae"))


def forest_classification(
    frame: DataFrame,
    row_id: str,
    features: Sequence[str] = FEATURES,
    trees: int = 5000,
    per_split: int = 10,
    depth: int = 30,
    seed: int = 42,
    store: str | None = None,
    part_trees: int = 100,
) -> tuple[Forest | StoredForest, DataFrame]:
    """Forest on the label, and the test rows with their class probabilities.

    Spark limits the depth of a tree to 30. See ``fit_forest`` for ``store`` and ``part_trees``.
    """
    text = frame.filter(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("string"))
    marked = assemble(split_by_hash(text, row_id), features)
    train = marked.filter(~F.col("is_test"))
    index = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc").fit(train)
    estimator = RandomForestClassifier(
        labelCol="label_index",
        maxDepth=depth,
        featureSubsetStrategy=str(per_split),
        cacheNodeIds=True,
        maxMemoryInMB=FOREST_MEMORY_MB,
        seed=seed,
    )
    model = fit_forest(estimator, index.transform(train), trees, store, part_trees)
    return model, model.classify(index.transform(marked.filter("is_test"))).drop("features")


def kfold_regression(
    frame: DataFrame,
    row_id: str,
    features: Sequence[str] = FEATURES,
    folds: int = 5,
    max_iter: int = 20,
    seed: int = 42,
) -> DataFrame:
    """``fold, loss, mae`` of boosted trees on the weight; the loss is the squared error."""
    scored = boosted_by_every_fold(frame, row_id, features, folds, max_iter, seed).filter("held_out")
    return regression_metrics(scored, by=["fold"])


def boosted_by_every_fold(
    frame: DataFrame,
    row_id: str,
    features: Sequence[str] = FEATURES,
    folds: int = 5,
    max_iter: int = 20,
    seed: int = 42,
    target: str = "weighted",
) -> DataFrame:
    """As ``scored_by_every_fold``, of boosted trees that are fitted side by side."""
    marked = assign_folds(frame, row_id, folds)
    return _scored_by_all(marked, fit_boosted(marked, features, target, range(folds), max_iter, seed))


def regression_metrics(scored: DataFrame, weight: str = "weighted", by: Sequence[str] = ()) -> DataFrame:
    """Mean squared and mean absolute error of predicted weights, in one pass."""
    error = F.col(weight) - F.col("prediction")
    return scored.groupBy(*by).agg(F.avg(error * error).alias("loss"), F.avg(F.abs(error)).alias("mae"))


def regression_audit(scored: DataFrame, row_id: str, weight: str = "weighted") -> DataFrame:
    """The predicted weight beside the original one."""
    return scored.select(row_id, F.col("prediction").alias("predicted"), F.col(weight).alias("original"))


def boosted(
    features: Sequence[str], target: str = "weighted", max_iter: int = 20, seed: int = 42
) -> Pipeline:
    """Boosted trees on a number."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="features"),
            GBTRegressor(labelCol=target, maxIter=max_iter, seed=seed),
        ]
    )


def score_audit(scored: DataFrame, row_id: str, weight: str = "weighted") -> DataFrame:
    """Class confidences beside the grade the weight came from."""
    names = ["confidence_to_fail", "confidence_to_pass", "confidence_to_excel"]
    return scored.select(
        row_id,
        *[F.col("p")[i].alias(n) for i, n in enumerate(names)],
        (F.col(weight) / 100 * GRADE_MAX).alias("original"),
    )

