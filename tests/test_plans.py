"""The shape of the physical plans."""

import re

import pytest

import __spark_entry__ as contract

LAZY = [
    "top10_groups", "group_scorecard", "group_profile", "group_vs_overall", "corr_matrix", "grade_summary",
    "join_star4", "top10_students", "extremes_union", "merge_results", "training_features", "expand_courses",
]


def plan_of(spark, sf_dir, name):
    text = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    return text.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_row_udf(spark, sf_dir, name):
    plan = plan_of(spark, sf_dir, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_with_large_tables(spark, sf_dir, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(spark, sf_dir, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "top10_groups")
    read = re.findall(r"ReadSchema: struct<([^>]*)", plan)
    assert any("l_quantity" in r for r in read)
    assert not any("l_extendedprice" in r or "o_orderstatus" in r or "embedding" in r for r in read)


def test_scorecard_aggregates_before_the_group_join(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "group_scorecard")
    join = plan.index("Join [group_id")
    assert plan.index("partial_count", join) > join
    assert plan.count("partial_count") == 1


@pytest.mark.parametrize("name, scans", [("join_star3", 4), ("join_star4", 4), ("merge_results", 6), ("top10_students", 4)])
def test_each_table_is_scanned_once(spark, sf_dir, name, scans):
    """Without broadcasting too: no join evaluates its input more than once."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(spark, sf_dir, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("FileScan") <= scans


def test_both_ends_come_from_one_scan(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "extremes_cohort")
    # Every task keeps its own k of each side before rows are moved.
    limit = plan.index("WindowGroupLimit", plan.index("WindowGroupLimit") + 1)
    assert plan.index("Final") < plan.index("Exchange hashpartitioning(side") < limit
    assert "explode" in plan[limit:]
    # One scan for the facts; orders, line items.
    assert plan.count("FileScan parquet") <= 3


def test_top_k_does_not_sort_everything(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_of(spark, sf_dir, "top10_groups")
