"""The classifier: held-out accuracy, calibration, what it must not look at."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import quality
from cohortlens.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    rows = QUERIES["op1_quality"](spark, FOLDER)
    labels = table(spark, FOLDER, "labels").select("doc_id", "quality")
    return rows.join(labels, "doc_id", "left").collect()


def test_held_out_accuracy(scored):
    held = [r for r in scored if r.held_out and r.quality is not None]
    good, poor = ([r for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([r.predicted for r in good]) >= 0.97
    assert np.mean([1 - r.predicted for r in poor]) >= 0.75
    order = sorted(held, key=lambda r: r.score)
    ranks = [k for k, r in enumerate(order) if r.quality == 1]
    area = (sum(ranks) - len(good) * (len(good) - 1) / 2) / (len(good) * len(poor))
    assert area >= 0.95


def test_scores_are_calibrated(scored):
    held = [r for r in scored if r.held_out and r.quality is not None]
    assert np.mean([r.score for r in held]) == pytest.approx(np.mean([r.quality for r in held]), abs=0.05)


def test_shape(scored):
    assert len(scored) == 10_000
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)


def test_labels_of_the_held_out_fifth_are_not_read(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} other {k}", "x") for k in range(300)], "doc_id long, text string, score string")
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    changed = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    first, second = (quality.score(docs, quality.train(docs, x)) for x in (labels, changed))
    assert first.columns == ["doc_id", "text", "score", "predicted"]
    assert first.select("doc_id", "score").collect() == second.select("doc_id", "score").collect()


def test_sample_is_bounded_and_fixed(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "'t' AS text")
    labels = spark.range(500).selectExpr("id AS doc_id", "1 AS quality")
    first = quality.labelled_sample(docs, labels, 50).collect()
    assert len(first) == 50
    assert sorted(first) == sorted(quality.labelled_sample(docs, labels.repartition(5), 50).collect())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x y"), (4, "long " * 60_000), (5, "### ###")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 1), (4, 0), (5, None), (None, 1)]):
        frame = spark.createDataFrame(labels, "doc_id long, quality int")
        got = quality.score(docs, quality.train(docs, frame)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if not r.text}) == 1
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, frame)).collect() == []


def test_words_do_not_depend_on_partitions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text")
    one, many = quality.learn_words(docs.coalesce(1)), quality.learn_words(docs.repartition(5))
    assert np.array_equal(one.vectors, many.vectors) and np.array_equal(one.weights, many.weights)
