import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import Row
from pyspark.sql import functions as F

from cohortlens.operators import early_stopping as es
from cohortlens.operators import features, models
from cohortlens.runtime import new_path

COLUMNS = ["x", "y"]


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes by a rule, a tenth of the labels wrong."""
    x, y = F.rand(1), F.rand(2)
    frame = spark.range(1200).select("id", x.alias("x"), y.alias("y"))
    clean = F.when(F.col("x") + F.col("y") > 1.2, 2).when(F.col("x") > F.col("y"), 1).otherwise(0)
    label = F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(clean)
    return frame.withColumn("label", label.cast("int"))


@pytest.fixture
def rounds_fitted(monkeypatch):
    done = []
    fit = MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", lambda self, *a: done.append(1) or fit(self, *a))
    return done


def curve_of(*losses):
    return [Row(round=k, validation_loss=loss) for k, loss in enumerate(losses)]


def test_flat_is_counted_from_the_best_round():
    assert not es.is_flat([], 1)
    assert not es.is_flat(curve_of(3.0, 2.0, 2.5), 2)
    assert es.is_flat(curve_of(3.0, 2.0, 2.5, 2.0), 2)
    assert es.best_round(curve_of(3.0, 2.0, 2.5, 2.0)) == 1


def test_stops_and_keeps_the_best_round(rows, rounds_fitted):
    model, curve = es.fit_until_flat(rows, "id", COLUMNS, step=10, rounds=30, patience=2, hidden=(12,))
    told = sorted(curve.collect(), key=lambda r: r["round"])
    assert len(told) == len(rounds_fitted) < 30
    best = min(told, key=lambda r: r.validation_loss)
    assert [r["round"] for r in told if r.is_best] == [best["round"]] == [told[-1]["round"] - 2]
    assert told[best["round"]].train_loss < told[0].train_loss
    held = es.mark_held_out(rows, "id").filter("is_held_out")
    again = models.classifier_metrics(models.class_probabilities(model.transform(held))).first()
    assert again.loss == pytest.approx(best.validation_loss, abs=1e-9)
    assert again.accuracy > 0.8


def test_rerun_goes_on_after_the_last_whole_round(spark, rows, rounds_fitted):
    store = new_path(spark, "rounds")
    settings = dict(features=COLUMNS, step=3, patience=50, hidden=(6,))
    es.fit_until_flat(rows, "id", rounds=2, store=store, **settings)
    assert len(rounds_fitted) == 2
    _, curve = es.fit_until_flat(rows, "id", rounds=4, store=store, **settings)
    assert len(rounds_fitted) == 4
    _, whole = es.fit_until_flat(rows, "id", rounds=4, **settings)
    for a, b in zip(curve.orderBy("round").collect(), whole.orderBy("round").collect()):
        assert a.validation_loss == pytest.approx(b.validation_loss, rel=1e-6)


def test_rounds_go_on_from_the_weights_before(rows):
    _, curve = es.fit_until_flat(rows, "id", COLUMNS, step=5, rounds=4, patience=50, hidden=(8,))
    losses = [r.train_loss for r in curve.orderBy("round").collect()]
    assert all(later <= earlier + 1e-9 for earlier, later in zip(losses, losses[1:]))


def test_held_out_rows_do_not_depend_on_the_folds(rows):
    marked = features.assign_folds(es.mark_held_out(rows, "id"), "id")
    parts = {(r.fold, r.is_held_out): r["count"] for r in marked.groupBy("fold", "is_held_out").count().collect()}
    assert len(parts) == 10


def test_balanced_rows_and_odd_ones(spark, rows):
    more = [(None, 0.5, 0.5, 1), (7, 0.1, 0.2, None)]
    odd = rows.unionByName(spark.createDataFrame(more, "id long, x double, y double, label int"))
    _, curve = es.fit_until_flat(odd, "id", COLUMNS, step=3, rounds=2, hidden=(4,), balanced=True)
    assert curve.count() == 2
    with pytest.raises(ValueError):
        es.fit_until_flat(rows.limit(0), "id", COLUMNS)


def test_folds(rows):
    folds = es.kfold_until_flat(rows, "id", COLUMNS, folds=3, step=10, rounds=3, hidden=(8,)).collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2]
    assert all(r.accuracy > 0.7 for r in folds)
