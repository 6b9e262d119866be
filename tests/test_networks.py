import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens import catalog
from cohortlens.operators import balance, models, networks

LAYERS = [3, 5, 4, 3]


@pytest.fixture(scope="module")
def rows(spark):
    cells = F.array(*[F.randn(seed) for seed in (1, 2, 3)])
    frame = spark.range(0, 3000, 1, 4).select("id", cells.alias("cells"))
    rule = F.when(F.col("cells")[0] > 0.3, 2).when(F.col("cells")[1] > 0, 1).otherwise(0)
    return frame.select(array_to_vector("cells").alias("features"), rule.alias("label"))


def test_loss_and_gradient(rows):
    blocks = networks.packed(rows, "label", 3, "float64")
    at, weights = networks.mean_loss(blocks, LAYERS), networks.start_weights(LAYERS, 1)
    _, gradient = at(weights)
    for place in (0, 16, 20, 40, len(weights) - 1):
        step = np.zeros(len(weights))
        step[place] = 1e-4
        sides = [networks.loss_and_accuracy(blocks, LAYERS, weights + s)[0] for s in (step, -step)]
        assert gradient[place] == pytest.approx((sides[0] - sides[1]) / 2e-4, abs=1e-5)


def test_figures_are_those_of_the_model(spark, rows):
    weights = 3 * networks.start_weights(LAYERS, 2)
    model = networks.network_model(spark, weights, LAYERS, "label")
    assert list(model.weights) == list(weights)
    want = models.classifier_metrics(models.class_probabilities(model.transform(rows))).first()
    got = networks.loss_and_accuracy(networks.packed(rows, "label", 3, "float64"), LAYERS, weights)
    assert got == pytest.approx((want.loss, want.accuracy), abs=1e-12)


def test_learns_the_rule_and_refuses_other_classes(rows):
    model = networks.NetworkClassifier(LAYERS, "label", 80, 42).fit(rows)
    assert models.classifier_metrics(models.class_probabilities(model.transform(rows))).first().accuracy > 0.95
    with pytest.raises(Exception, match="not one of the classes"):
        networks.NetworkClassifier(LAYERS, "label", 2, 42).fit(rows.withColumn("label", F.lit(3)))


def test_training_rows_keep_all_cores_busy(spark, sf_dir):
    """They come from one small file, which every pass of a fit would read in one task."""
    parts = catalog._ordinal_rows(spark, sf_dir).rdd.getNumPartitions()
    assert parts >= spark.sparkContext.defaultParallelism


def test_scores_before_and_after_saving_stand_in_one_row(spark, sf_dir):
    """A join of the two would send the scores of all rows through the driver."""
    compared = catalog.model_store(spark, sf_dir)
    plan = compared._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Join" not in plan and "Broadcast" not in plan
    assert compared.filter("is_same").count() == compared.count() > 0


def test_balanced_rows_are_packed_as_they_are_made(spark, monkeypatch):
    """No table of them is written, and the fit is that of the scaler and the network over such a table."""
    kinds = (F.col("id") % 7 == 0).cast("int")
    frame = spark.range(0, 1500, 1, 4).select(
        (1e4 + F.randn(1) + 2 * kinds).alias("a"), F.randn(2).alias("b"), F.lit(3.0).alias("c"), kinds.alias("label")
    )
    names = ["a", "b", "c"]
    estimator = models.network(names, 2, (4,), 15)
    table = balance.oversample(frame, "label", names).persist()
    want = estimator.fit(table)

    def no_table(*_):
        raise AssertionError("the balanced rows were written")

    monkeypatch.setattr(models, "write_once", no_table)
    got = models.fit_balanced(estimator, "label", names)(frame)
    assert got.stages[1].mean.toArray() == pytest.approx(want.stages[1].mean.toArray(), rel=1e-9)
    assert got.stages[1].std.toArray() == pytest.approx(want.stages[1].std.toArray(), rel=1e-9)
    figures = [models.classifier_metrics(models.class_probabilities(m.transform(table))).first() for m in (got, want)]
    assert figures[0] == pytest.approx(figures[1], abs=0.01) and figures[0].accuracy > 0.8
    with pytest.raises(Exception, match="not a number"):
        networks.NetworkClassifier([1, 2], "label", 2, 42).fit_scaled(
            spark.range(4).select(F.array(F.lit(float("nan"))).alias("vec"), F.lit(0).alias("label"))
        )
