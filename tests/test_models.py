import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortlens import binding
from cohortlens.operators import features, models
from cohortlens.plans import training
from cohortlens.runtime import new_path
from cohortlens.schema import ATTR_COLS, BASE_SCORES, FEATURES, STACK_FEATURES
from cohortlens.sources import tables


def test_feature_order():
    assert FEATURES[:4] == ["attr_A", "attr_AX", "attr_B", "attr_C"]
    assert FEATURES[21:] == ["cfit_A", "cfit_AA", "cfit_BA", "cfit_H", "cfit_L", "cfit_M", "course_bscs", "course_bsit"]
    assert len(FEATURES) == 29
    assert STACK_FEATURES[29:] == ["fail", "pass", "success"]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    frame = features.training_frame(binding.facts(spark, sf_dir, certs=False), [1997, 1998])
    # The scores carry no signal in the test data; make one that a model can find.
    signal = F.when(F.col("attr_C") >= 7, 2).when(F.col("attr_C") <= 4, 0).otherwise(1)
    return tables.write_once(frame.withColumn("label", signal), "rows")


@pytest.fixture(scope="module")
def stack(rows):
    return models.fit_stack(rows, "student_id", folds=2, max_iter=20, hidden=(6,))


def accuracy(scored):
    return models.classifier_metrics(scored).first().accuracy


def test_stack_learns_and_scores_everyone(rows, stack):
    scored = stack.transform(rows)
    most = rows.groupBy("label").count().agg(F.max("count")).first()[0] / rows.count()
    assert accuracy(scored) > max(most + 0.15, 0.8)
    assert scored.count() == rows.count()
    one = scored.first()
    assert sum(one.p) == pytest.approx(1) and all(0 <= one[s] <= 1 for s in BASE_SCORES)


def test_saved_model_scores_the_same(spark, rows, stack):
    path = new_path(spark, "model")
    stack.save(path)
    loaded = models.StackedModel.load(path)
    old = {r.student_id: r.p for r in stack.transform(rows).collect()}
    for r in loaded.transform(rows).collect():
        assert r.p == pytest.approx(old[r.student_id])


def test_scores_for_both_courses_without_a_shuffle(spark, sf_dir, stack):
    sheet = binding.profile_sheet(spark, sf_dir)
    scored = models.score_students(stack, sheet)
    assert scored.columns == ["IDNumber"] + [
        f"{c}-{x}" for c in ("BSCS", "BSIT")
        for x in ("Pass Confidence", "Failure Confidence", "Excellence Confidence", "Verdict")
    ]
    complete = sheet.dropna("any", subset=ATTR_COLS).count()
    assert scored.count() == complete
    assert scored.filter(F.col("BSCS-Verdict").isNull() | F.col("BSIT-Verdict").isNull()).count() == 0
    plan = models.score_students(stack, tables.write_once(sheet, "sheet"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_held_out_scores_cover_every_row_once(rows):
    stacked = models.stacked_features(rows, "student_id", folds=2, max_iter=5, hidden=(4,))
    assert stacked.count() == rows.count() == stacked.select("student_id").distinct().count()
    assert set(BASE_SCORES) <= set(stacked.columns)


def test_folds(spark, rows):
    folds = models.kfold_classifier(rows, "student_id", folds=3, max_iter=10, hidden=(4,))
    assert sorted(r.fold for r in folds.collect()) == [0, 1, 2]
    spread = models.mean_and_spread(folds).first()
    values = [r.accuracy for r in folds.collect()]
    assert spread.mean_accuracy == pytest.approx(sum(values) / 3)
    marked = features.assign_folds(rows, "student_id", 3)
    assert marked.groupBy("fold").count().count() == 3


def test_folds_of_the_stack_and_base_metrics(rows):
    folds = models.kfold_stack(rows, "student_id", folds=2, max_iter=10, hidden=(4,)).collect()
    assert sorted(r.fold for r in folds) == [0, 1] and all(r.accuracy > 0.5 for r in folds)
    stacked = models.stacked_features(rows, "student_id", folds=2, max_iter=10, hidden=(4,))
    base = {r.model: r for r in models.base_metrics(stacked).collect()}
    assert set(base) == set(BASE_SCORES) and all(r.accuracy > 0.5 for r in base.values())


def test_predicted_class_is_the_largest(stack, rows):
    p = F.col("p")
    wrong = stack.transform(rows).filter(F.array_position(p, F.array_max(p)) - 1 != F.col("predicted"))
    assert wrong.count() == 0


def test_metrics(spark):
    scored = spark.createDataFrame(
        [(0, [0.7, 0.2, 0.1]), (2, [0.5, 0.25, 0.25])], "label int, p array<double>"
    )
    got = models.classifier_metrics(scored).first()
    assert got.accuracy == 0.5
    assert got.loss == pytest.approx((0.35667494 + 1.38629436) / 2)


def test_network_beats_the_majority(spark, sf_dir):
    """The labels of the table are independent of its vectors, so a rule over them is learnt."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = [f"e{k}" for k in range(16)]
    wide = df.select("vec_id", *[F.col("embedding")[k].alias(n) for k, n in enumerate(names)])
    rule = F.when(F.col("e0") > 0, 1).otherwise(0) + F.when(F.col("e1") > 0, 2).otherwise(0)
    marked = features.split_by_hash(wide.withColumn("label", rule), "vec_id")
    model = models.network(names, 4, (8,), 40).fit(marked.filter("NOT is_test"))
    scored = models.class_probabilities(model.transform(marked.filter("is_test")))
    most = marked.filter("is_test").groupBy("label").count().agg(F.max("count")).first()[0]
    assert accuracy(scored) > most / scored.count() + 0.2


def test_forests_and_boosting(spark, sf_dir):
    frame = tables.write_once(
        features.ordinal_training_frame(binding.facts(spark, sf_dir, certs=False), [1998]), "ordinal"
    )
    names = features.ORDINAL_FEATURES
    _, residuals = models.forest_regression(frame, "student_id", names, trees=5, depth=4)
    assert models.mean_absolute_error(residuals).first().mae > 0
    one = residuals.first()
    assert one.difference == pytest.approx(abs(one.actual - one.predicted))
    _, scored = models.forest_classification(frame, "student_id", names, trees=5, depth=4)
    assert {r.label for r in scored.select("label").distinct().collect()} <= {"0", "1", "2"}
    folds = models.kfold_regression(frame, "student_id", names, folds=2, max_iter=2)
    assert folds.count() == 2


def test_forest_classification_grows_deep_trees(spark):
    """The parity of twelve marks needs trees of more than ten levels."""
    names = [f"b{k}" for k in range(12)]
    bits = [F.shiftright("id", k).bitwiseAND(1) for k in range(12)]
    marks = spark.range(1 << 12).select(
        "id", *[b.alias(n) for b, n in zip(bits, names)], (F.bit_count("id") % 2).alias("label")
    )
    model, _ = models.forest_classification(marks, "id", names, trees=2)
    assert max(tree.depth for tree in model.parts[0].trees) > 10


def test_audit_restores_the_grade(spark):
    scored = spark.createDataFrame([(1, 60.0, [0.1, 0.2, 0.7])], "id int, weighted double, p array<double>")
    row = models.score_audit(scored, "id").first()
    assert row.original == pytest.approx(3.0) and row.confidence_to_excel == 0.7


def test_train_and_predict(spark, sf_dir):
    facts = binding.facts(spark, sf_dir, certs=False)
    model, metrics = new_path(spark, "model"), new_path(spark, "metrics")
    scores = training.train(facts, [1998], model, metrics, folds=2, max_iter=5, hidden=(4,))
    assert scores.count() == 2
    logged = {r.metric for r in tables.latest_metrics(spark, metrics).collect()}
    assert {"mean_accuracy", "std_accuracy", "mean_loss"} <= logged
    sheet = binding.profile_sheet(spark, sf_dir)
    assert training.predict(sheet, model).count() > 0
    with pytest.raises(Exception, match="CFIT holds Z"):
        training.predict(sheet.withColumn("CFIT", F.lit("Z")), model).collect()


def test_assemble_order(spark, rows):
    row = models.assemble(rows).first()
    assert list(row.features) == [row[f] for f in FEATURES]
    again = rows.select(array_to_vector(F.array(*FEATURES)).alias("v")).first()
    assert len(again.v) == 29


def marks_frame(spark, size=400):
    mark = (F.xxhash64("id") % 7).cast("double")
    return spark.range(size).select(
        F.col("id"), (F.col("id") % 20).cast("double").alias("x"), mark.alias("y"),
        F.when(mark > 0, "b").otherwise("a").alias("label"), (F.col("id") % 20 + 1).cast("double").alias("weighted"),
    )


def test_forest_in_parts_is_the_mean_of_its_trees(spark):
    frame = marks_frame(spark)
    whole, one = models.forest_regression(frame, "id", ["x", "y"], trees=5, depth=4)
    parts, several = models.forest_regression(frame, "id", ["x", "y"], trees=5, depth=4, part_trees=2)
    assert [p.getNumTrees for p in parts.parts] == [2, 2, 1] and parts.trees == whole.trees == 5
    assert len(whole.parts) == 1
    rows = models.assemble(frame, ["x", "y"])
    want = {r.id: r.prediction for r in whole.parts[0].transform(rows).collect()}
    assert {r.id: r.prediction for r in whole.regress(rows).collect()} == pytest.approx(want)
    trees = [t for p in parts.parts for t in p.trees]
    for row in parts.regress(rows).limit(40).collect():
        assert row.prediction == pytest.approx(sum(t.predict(row.features) for t in trees) / 5)
    assert one.count() == several.count() > 0
    # The weight is a function of x, so a forest that works is near it.
    assert models.mean_absolute_error(several).first().mae < 4


def test_forest_classes_in_parts(spark):
    frame = marks_frame(spark).withColumn("label", F.when(F.col("x") > 9, "b").otherwise("a"))
    parts, scored = models.forest_classification(frame, "id", ["x", "y"], trees=5, depth=3, per_split=2, part_trees=2)
    rows = scored.collect()
    assert len(rows) > 40 and parts.trees == 5
    assert all(sum(r.p) == pytest.approx(1) and r.predicted == (r.label == "b") for r in rows)
    votes = [t for p in parts.parts for t in p.trees]
    by_id = {r.id: r.features for r in models.assemble(frame, ["x", "y"]).collect()}
    for r in rows[:20]:
        raw = [t.predictProbability(by_id[r.id]) for t in votes]
        assert list(r.p) == pytest.approx([sum(v[c] for v in raw) / 5 for c in (0, 1)])


def test_forest_takes_saved_parts_again(spark, monkeypatch):
    """A run that was lost after some parts goes on with the others and gives the same forest."""
    frame, store = marks_frame(spark), new_path(spark, "forest")
    _, first = models.forest_regression(frame, "id", ["x", "y"], trees=4, depth=3, store=store, part_trees=2)
    fitted = []
    fit = models.RandomForestRegressor.fit
    monkeypatch.setattr(models.RandomForestRegressor, "fit", lambda self, *a: fitted.append(1) or fit(self, *a))
    _, again = models.forest_regression(frame, "id", ["x", "y"], trees=6, depth=3, store=store, part_trees=2)
    assert len(fitted) == 1 and again.count() == first.count()
    _, same = models.forest_regression(frame, "id", ["x", "y"], trees=4, depth=3, store=store, part_trees=2)
    assert len(fitted) == 1
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, first.collect()))


def test_no_label_of_a_fold_reaches_a_model_that_scores_it(spark, rows, monkeypatch):
    """Every fit of a k-fold run is noted with the ids it has seen."""
    seen = []

    def balanced(estimator, label, features):
        def fit(frame):
            ids = {r.student_id for r in frame.select("student_id").collect()}
            model = estimator.fit(frame)
            seen.append((label, ids))
            return model
        return fit

    monkeypatch.setattr(models, "fit_balanced", balanced)
    folds = models.kfold_stack(rows, "student_id", folds=3, max_iter=3, hidden=(3,)).collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2]
    marked = {r.student_id: r.fold for r in features.assign_folds(rows, "student_id", 3).collect()}
    tops = [{marked[i] for i in ids} for label, ids in seen if label == "label"]
    bases = [{marked[i] for i in ids} for label, ids in seen if label != "label"]
    assert sorted(map(sorted, tops)) == [[0, 1], [0, 2], [1, 2]]
    # Two folds are seen by the models that score the third, one by those the top models learn from.
    assert sorted(map(sorted, bases)) == sorted([[0]] * 3 + [[1]] * 3 + [[2]] * 3 + [[0, 1]] * 3 + [[0, 2]] * 3 + [[1, 2]] * 3)
