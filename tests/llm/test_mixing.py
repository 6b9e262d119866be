"""Poisson replication: rates, determinism, odd rows."""

import math
from collections import Counter

import pytest

from cohortlens.llm import mixing

DOC = "doc_id long, text string, source string"


def test_steps_are_the_poisson_distribution():
    for rate in (0.1, 1.0, 7.5, 900.0):
        steps = mixing.poisson_steps(rate)
        assert steps == sorted(steps) and steps[-1] == pytest.approx(1, abs=1e-12)
        mean = sum(1 - s for s in steps)
        assert mean == pytest.approx(rate, rel=1e-6)
    assert mixing.poisson_steps(0.0) == []


def test_sources_get_their_weights(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 4 = 0 THEN 'a' ELSE 'b' END AS source")
    mixed = mixing.mix(docs, {"a": 3, "b": 1}).groupBy("source").count().collect()
    counts = {r.source: r["count"] for r in mixed}
    assert counts["a"] == pytest.approx(30_000, abs=5 * math.sqrt(30_000))
    assert counts["b"] == pytest.approx(10_000, abs=5 * math.sqrt(10_000))


def test_copies_are_numbered_and_repeatable(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "'t' AS text", "'a' AS source")
    first = sorted(mixing.mix(docs, {"a": 1}, size=1500).collect())
    again = sorted(mixing.mix(docs.repartition(7), {"a": 1}, size=1500).collect())
    assert first == again
    per_doc = Counter(r.doc_id for r in first)
    assert {(r.doc_id, r.copy) for r in first} == {(d, k) for d, n in per_doc.items() for k in range(1, n + 1)}
    assert len({r.mix_key for r in first}) == len(first)
    other = mixing.mix(docs, {"a": 1}, size=1500, seed=18).collect()
    assert Counter(r.doc_id for r in other) != per_doc


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (2, "", None), (None, "x", "b"), (3, "y" * 100_000, "c")]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], DOC + ", copy string")
    mixed = mixing.mix(docs, {"a": 1.0, "absent": 1.0}, other_rate=4.0)
    assert mixed.columns == ["doc_id", "text", "source", "copy", "mix_key"]
    seen = Counter(r.doc_id for r in mixed.collect())
    assert seen[2] % 2 == 0
    assert mixing.mix(spark.createDataFrame([], DOC), {"a": 1.0}).collect() == []
    assert mixing.repetition_rates(docs, {"a": 1.0, "absent": 1.0}) == {"a": 0.5}
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0.0})
    none = mixing.mix(docs, {"a": 0.0, "c": 1.0}, other_rate=0.0).collect()
    assert {r.source for r in none} <= {"c"}


def test_rows_are_shuffled(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'t' AS text", "'a' AS source")
    order = [r.doc_id for r in mixing.mix(docs, {"a": 1}).collect()]
    rising = sum(a < b for a, b in zip(order, order[1:])) / len(order)
    assert 0.4 < rising < 0.6
