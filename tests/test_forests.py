"""Trees grown by tasks against Spark's own, and the two ways of growing them against each other."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from cohortlens.operators import features, forests, models
from cohortlens.runtime import new_path
from cohortlens.sources.tables import write_once

NAMES = ["x", "y", "z"]


@pytest.fixture(scope="module")
def frame(spark):
    def mark(k, n):
        return (F.abs(F.xxhash64("id", F.lit(k))) % n).cast("double")

    rows = spark.range(3000).select("id", mark(1, 20).alias("x"), mark(2, 7).alias("y"), (mark(3, 1000) / 7).alias("z"))
    weight = 10 + F.col("x") * 3 + F.when(F.col("y") > 3, F.col("z") / 10).otherwise(0.0) + mark(4, 100) / 50
    label = F.when(F.col("x") > 14, 2).when(F.col("y") > 2, 1).otherwise(0)
    return write_once(rows.withColumn("weighted", weight).withColumn("label", label).repartition(4), "forest-frame")


def test_grown_tree_is_that_of_spark(spark, frame):
    """One tree on all rows and all features, on few values each."""
    names = ["x", "y"]
    vectors = write_once(models.assemble(frame, names).select("id", "features", "weighted"), "vectors")
    spark_tree = DecisionTreeRegressor(labelCol="weighted", maxDepth=30).fit(vectors)
    cuts = forests.bin_cuts(vectors)
    block = [forests.Block.of(r) for r in forests.packed(vectors, cuts, F.col("weighted"), F.col("id")).collect()]
    growth = forests.growth_of(cuts, 0, 2, 30, 1)
    x, y = np.concatenate([b.x for b in block]), np.concatenate([b.y for b in block])
    tree = forests.grow(growth, x, np.ones(len(x)), y, 30, 0)
    own = dict(zip(np.concatenate([b.row for b in block]).tolist(), tree.value[tree.leaves(x), 0].tolist()))
    want = {r.id: r.prediction for r in spark_tree.transform(vectors).collect()}
    assert own == pytest.approx(want, rel=1e-6)
    assert abs(len(tree.left) - spark_tree.numNodes) <= 2


@pytest.mark.parametrize("classes", [0, 3])
def test_large_nodes_by_passes_give_the_same_trees(frame, classes):
    """All features weighed at every node: nothing but the samples is drawn, and these are the same both ways."""
    wrong = F.abs(F.xxhash64("id", F.lit(5))) % 12
    rows = models.assemble(frame, NAMES).withColumn("label", F.when(wrong < 3, wrong).otherwise(F.col("label")).cast("double"))
    cuts = forests.bin_cuts(rows)
    assert [len(c) for c in cuts] == [19, 6, 31]
    growth = forests.growth_of(cuts, classes, 3, 6, 5)
    blocks = forests.packed(rows, cuts, F.col("label" if classes else "weighted"), F.col("id"))
    said = []
    for name, grown in {
        "whole": forests.grown_trees(blocks, growth, 0, 3),
        "by-nodes": forests.grown_trees(blocks, growth, 0, 3, node_rows=400, shared_bytes=0),
    }.items():
        path = new_path(frame.sparkSession, name)
        grown.write.parquet(path)
        nodes = [r.node for r in frame.sparkSession.read.parquet(path).collect()]
        assert sorted(nodes) == [0, 0, 0] if name == "whole" else nodes.count(-1) == 3 and len(nodes) > 6
        forest = forests.StoredForest(frame.sparkSession, [path], cuts, classes, 3)
        scored = forest.classify(rows) if classes else forest.regress(rows)
        said.append({r.id: r.p if classes else [r.prediction] for r in scored.collect()})
    assert len(said[0]) == 3000 and said[0].keys() == said[1].keys()
    assert all(said[1][k] == pytest.approx(v, rel=1e-5) for k, v in said[0].items())


def test_large_forest_is_not_held_by_the_driver(spark, frame, monkeypatch):
    """Above the limit no part is Spark's own; parts are taken again, rows are scored in several rounds."""
    monkeypatch.setattr(models, "FOREST_CELLS", 0)
    monkeypatch.setattr(forests, "SHARED_BYTES", 500)
    store = new_path(spark, "forest")
    forest, first = models.forest_regression(frame, "id", NAMES, trees=12, store=store, part_trees=5)
    assert isinstance(forest, forests.StoredForest) and forest.trees == 12 and len(forest.paths) == 3
    test_rows = features.split_by_hash(frame, "id").filter("is_test").count()
    rows = first.collect()
    assert len(rows) == test_rows and models.mean_absolute_error(first).first().mae < 4
    monkeypatch.setattr(models, "grown_trees", None)
    _, again = models.forest_regression(frame, "id", NAMES, trees=12, store=store, part_trees=5)
    assert {r.id: r.predicted for r in again.collect()} == pytest.approx({r.id: r.predicted for r in rows})


def test_large_forest_of_classes(frame, monkeypatch):
    monkeypatch.setattr(models, "FOREST_CELLS", 0)
    forest, scored = models.forest_classification(frame, "id", NAMES, trees=10, per_split=2)
    rows = scored.collect()
    assert isinstance(forest, forests.StoredForest) and len(rows) > 500
    assert all(sum(r.p) == pytest.approx(1, abs=1e-5) and len(r.p) == 3 for r in rows)
    assert sum(str(r.predicted) == r.label for r in rows) > 0.98 * len(rows)


def test_no_rows_to_score(frame, monkeypatch):
    monkeypatch.setattr(models, "FOREST_CELLS", 0)
    forest, _ = models.forest_regression(frame, "id", NAMES, trees=2)
    assert forest.regress(models.assemble(frame.filter("id < 0"), NAMES)).collect() == []


def test_deep_trees_are_grown_whole():
    """The parity of twelve marks needs every level; no gain shows before the last one but by chance."""
    x = (np.arange(1 << 12)[:, None] >> np.arange(12) & 1).astype(np.uint8)
    y = x.sum(1, dtype=np.int64) % 2
    tree = forests.grow(forests.Growth(2, 2, 12, 12, 30, 3), x, np.random.default_rng(0).random(len(x)) + 0.5, y, 30, 0)
    assert (tree.value[tree.leaves(x)].argmax(1) == y).all()


def test_boosted_trees_of_all_folds_are_those_of_spark(frame, monkeypatch):
    """Fitted side by side, each model says what Spark's boosted trees on the same rows say."""
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda *_: pytest.fail("a fit of its own for a fold"))
    own = models.boosted_by_every_fold(frame, "id", ["x", "y"], folds=3, max_iter=4)
    rows = own.select("id", "fold", "held_out", "prediction").collect()
    summary = models.kfold_regression(frame, "id", ["x", "y"], folds=3, max_iter=4).collect()
    monkeypatch.undo()
    want = models.scored_by_every_fold(frame, "id", 3, models.boosted(["x", "y"], max_iter=4).fit)
    theirs = {(r.id, r.fold): (r.held_out, r.prediction) for r in want.collect()}
    assert len(rows) == len(theirs) == 9000
    assert {(r.id, r.fold): r.held_out for r in rows} == {k: held for k, (held, _) in theirs.items()}
    off = [abs(r.prediction - theirs[r.id, r.fold][1]) for r in rows]
    assert np.mean(np.array(off) < 1e-6) > 0.99
    errors = {r.fold: r.mae for r in models.regression_metrics(want.filter("held_out"), by=["fold"]).collect()}
    assert {r.fold: r.mae for r in summary} == pytest.approx(errors, rel=1e-3)


def test_missing_numbers_are_refused(spark):
    cells = spark.createDataFrame([([1.0, 2.0],), ([float("nan"), 1.0],)], "x array<double>")
    rows = cells.select(array_to_vector("x").alias("features"))
    with pytest.raises(Exception, match="not a number"):
        forests.bin_cuts(rows)
