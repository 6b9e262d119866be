"""Positions, ranks, medians and correlations against plain computations."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators.correlate import correlation_matrix, pair_correlations, target_correlations
from cohortlens.operators.numbering import assign_ids, dense_rank_of_values, running_start
from cohortlens.operators.quantile import exact_median

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def test_running_start_is_the_sum_before_in_digest_order(spark):
    rows = [(f"k{i}", i % 7, "ab"[i % 2]) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, w int, class string").repartition(7)
    got = {r.key: r.start for r in running_start(df, "key", F.col("w"), ["class"]).collect()}
    for cls in "ab":
        total = 0
        own = [r for r in rows if r[2] == cls]
        for key, w, _ in sorted(own, key=lambda r: hashlib.md5(r[0].encode()).hexdigest()):
            assert got[key] == total
            total += w


def test_ids_are_dense_unique_and_stable(spark):
    new = spark.createDataFrame([(f"n{i}",) for i in range(300)], "name string")
    old = spark.createDataFrame([(41,), (7,)], "id long")
    first = {r.name: r.id for r in assign_ids(new, "name", old).collect()}
    again = {r.name: r.id for r in assign_ids(new.repartition(9), "name", old).collect()}
    assert first == again
    assert sorted(first.values()) == list(range(42, 342))
    empty = old.filter("id < 0")
    assert min(r.id for r in assign_ids(new, "name", empty).collect()) == 1


@few
@given(st.lists(st.one_of(st.none(), st.integers(-500, 12000).map(lambda x: x / 100)), min_size=1, max_size=60))
def test_dense_rank(spark, scores):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double")
    distinct = sorted({s for s in scores if s is not None}, reverse=True)
    for row in dense_rank_of_values(df, "s").collect():
        assert row["rank"] == (None if row.s is None else distinct.index(row.s) + 1)


@few
@given(st.lists(st.one_of(st.none(), st.sampled_from([1.0, 2.0, 2.5]), st.floats(-1e6, 1e6)), min_size=1, max_size=80))
def test_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    kept = [v for v in values if v is not None]
    got = exact_median(df, "v").first()
    expected = float(np.median(kept)) if kept else None
    assert (got.median if got else None) == (None if expected is None else pytest.approx(expected))


@pytest.mark.parametrize("n", [20001, 30000])
def test_median_of_many_with_a_coarse_bracket(spark, n):
    df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(100003)).cast("double").alias("v"))
    data = df.toPandas()["v"]
    assert exact_median(df, "v", accuracy=50).first().median == data.median()
    hot = df.select(F.when(F.col("v") % 3 == 0, 7.0).otherwise(F.col("v")).alias("v"))
    assert exact_median(hot, "v", accuracy=50).first().median == hot.toPandas()["v"].median()


def frame(n=400, seed=0):
    rng = np.random.default_rng(seed)
    data = pd.DataFrame(rng.normal(size=(n, 4)), columns=list("abcd"))
    data["b"] += data["a"]
    data["c"] = data["c"] * 1e-3 + 1e6
    data.loc[rng.random(n) < 0.2, "a"] = np.nan
    data.loc[rng.random(n) < 0.2, "d"] = np.nan
    data["flat"] = 3.7
    return data


def check(spark, data, partitions):
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None).values.tolist(),
                               ", ".join(f"{c} double" for c in data.columns)).repartition(partitions)
    want = data.corr()
    for row in correlation_matrix(df, list(data.columns)).collect():
        expected = want.loc[row.x, row.y]
        if math.isnan(expected):
            assert row.r is None
        else:
            assert row.r == pytest.approx(expected, abs=1e-7)


@pytest.mark.parametrize("partitions", [1, 5])
def test_correlation_like_in_memory(spark, partitions):
    check(spark, frame(), partitions)


def test_correlation_matrix_properties(spark):
    data = frame(60, 3)[list("abcd")]
    df = spark.createDataFrame(data)
    cells = {(r.x, r.y): r.r for r in correlation_matrix(df, list("abcd")).collect()}
    assert len(cells) == 16
    for (x, y), r in cells.items():
        assert cells[(y, x)] == r and -1 <= r <= 1
        if x == y:
            assert r == pytest.approx(1)


def test_single_row_and_constant_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert [r.r for r in pair_correlations(df, ["a", "b"]).collect()] == [None] * 3
    # constant only where the other is there
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 4.0), (5.0, None)], "a double, b double")
    got = {(r.x, r.y): r.r for r in pair_correlations(df.repartition(3), ["a", "b"]).collect()}
    assert got[("a", "b")] is None


def test_targets_are_sorted_by_strength(spark):
    df = spark.createDataFrame(frame(300, 5))
    rows = target_correlations(df, ["a", "b", "d"], ["c"]).collect()
    strength = [abs(r.r) for r in rows]
    assert strength == sorted(strength, reverse=True)
    assert {r.attribute for r in rows} == {"a", "b", "d"}


def test_pairs_without_common_rows_are_listed(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (2.0, None, 3.0), (3.0, None, 4.0)], "a double, b double, c double")
    for frame in (df, df.filter("a < 0")):
        cells = {(r.x, r.y): r.r for r in correlation_matrix(frame, ["a", "b", "c"]).collect()}
        assert len(cells) == 9
        assert cells[("a", "b")] is None and cells[("b", "b")] is None
    assert {(r.x, r.y): r.r for r in pair_correlations(df.repartition(3), ["a", "c"]).collect()}[("a", "c")] > 0.9
