"""Group scorecards, ranks, best and worst groups, pass statistics, best students."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scores import composite_score, round_binary
from cohortlens.operators.joins import with_group_name
from cohortlens.operators.numbering import dense_rank_of_values
from cohortlens.schema import (
    CERT_MAX,
    COURSES,
    GRADE_MAX,
    MIN_GROUP_SIZE,
    PASS_MARK,
    SCORE_WEIGHTS,
    TOP_GROUPS,
    TOP_STUDENTS,
)
from cohortlens.sources.tables import write_once


def _passed(pass_mark: float) -> Column:
    return F.col("grade") >= pass_mark


def _of_cohort(facts: DataFrame, cohort: int | None) -> DataFrame:
    return facts if cohort is None else facts.filter(F.col("cohort_id") == cohort)


def conditional_stats(
    facts: DataFrame, by: Sequence[str] = ("group_id",), pass_mark: float = PASS_MARK
) -> DataFrame:
    """Row count, passers, mean passing grade, passing rate and mean certification."""
    passed = _passed(pass_mark)
    n_passed = F.sum(F.when(passed, 1).otherwise(0))
    return facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("student_count"),
        n_passed.alias("pass_count"),
        F.avg(F.when(passed, F.col("grade"))).alias("mean_passing_grade"),
        (n_passed / F.count(F.lit(1)) * 100).alias("passing_rate"),
        F.avg("c_cert").alias("mean_cert"),
    )


def group_scorecard(
    facts: DataFrame,
    groups: DataFrame,
    cohort: int | None = None,
    pass_mark: float = PASS_MARK,
    min_size: int = MIN_GROUP_SIZE,
    weights: tuple[float, float, float] = SCORE_WEIGHTS,
) -> DataFrame:
    """One row per group of more than ``min_size`` students.

    The facts are aggregated before the groups are joined, so the join sees one row per
    group and a large group costs no more than a small one. A group without a passer has
    a NULL score. Scores are rounded last.
    """
    rows = _of_cohort(facts, cohort).filter(F.col("group_id").isNotNull())
    passing = F.col("mean_passing_grade") / GRADE_MAX
    cert = F.col("mean_cert") / CERT_MAX
    rate = F.col("passing_rate")
    w_grade, w_rate, w_cert = weights
    score = (w_grade * passing + w_rate * rate / 100 + w_cert * cert) * 100
    return (
        conditional_stats(rows, ["group_id"], pass_mark)
        .filter(F.col("student_count") > min_size)
        .join(groups.withColumnRenamed("id", "group_id"), "group_id")
        .select(
            "group_id",
            "name",
            "student_count",
            F.round(passing * 100, 2).alias("avg_passing_grade"),
            F.round(rate, 2).alias("passing_rate"),
            F.round(cert * 100, 2).alias("avg_cert_grade"),
            F.round(score, 2).alias("weighted_score"),
        )
    )


def _grade_from_percent(digits: int | None = None) -> Column:
    grade = F.col("avg_passing_grade") * GRADE_MAX / 100
    return grade if digits is None else round_binary(grade, digits)


def best_group(scorecard: DataFrame) -> DataFrame:
    return (
        scorecard.orderBy(F.col("weighted_score").desc_nulls_last(), "group_id")
        .limit(1)
        .withColumn("performance", F.lit("Best"))
        .withColumn("avg_passing_grade", _grade_from_percent())
    )


def worst_group(scorecard: DataFrame, exclude_null: bool = False) -> DataFrame:
    """Lowest score; a group without a passer has none and comes first unless excluded."""
    if exclude_null:
        scorecard = scorecard.filter(F.col("weighted_score").isNotNull())
    return (
        scorecard.orderBy(F.col("weighted_score").asc_nulls_first(), "group_id")
        .limit(1)
        .withColumn("performance", F.lit("Worst"))
        .withColumn("avg_passing_grade", _grade_from_percent())
    )


def top_groups(scorecard: DataFrame, k: int = TOP_GROUPS) -> DataFrame:
    return (
        scorecard.orderBy(F.col("weighted_score").desc_nulls_last(), "group_id")
        .limit(k)
        .withColumn("avg_passing_grade", _grade_from_percent(2))
    )


def group_rank(scorecard: DataFrame) -> DataFrame:
    """Dense rank on the rounded score; NULL score, NULL rank.

    The scorecard, one row per group, is written first: ranks are matched by score, so every
    use must see the very same numbers, and sums of doubles can differ between two runs.
    """
    return dense_rank_of_values(write_once(scorecard, "scorecard"), "weighted_score", "rank")


def rank_of_group(scorecard: DataFrame, group_id: int) -> DataFrame:
    """Rank of one group; no row when it is too small to be ranked."""
    return group_rank(scorecard).filter(F.col("group_id") == group_id).select("group_id", "rank")


def pass_counts(
    facts: DataFrame, cohort: int, courses: Sequence[str] = COURSES, pass_mark: float = PASS_MARK
) -> DataFrame:
    """One row: passers and their mean grade, then per course total, means and passers.

    A course without students gives 0 and NULLs.
    """
    passed = _passed(pass_mark)
    columns = [
        F.count(F.when(passed, 1)).alias("pass_count"),
        F.avg(F.when(passed, F.col("grade"))).alias("avg_pass_grade"),
    ]
    for course in courses:
        here = F.col("course") == course
        name = course.lower()
        columns += [
            F.count(F.when(here, 1)).alias(f"total_{name}"),
            F.avg(F.when(here & passed, F.col("c_cert"))).alias(f"avg_cert_{name}"),
            F.avg(F.when(here & passed, F.col("grade"))).alias(f"avg_grade_{name}"),
            F.count(F.when(here & passed, 1)).alias(f"pass_count_{name}"),
        ]
    return _of_cohort(facts, cohort).agg(*columns)


def pass_counts_complete(
    facts: DataFrame, cohort: int, courses: Sequence[str] = COURSES, pass_mark: float = PASS_MARK
) -> DataFrame:
    """As ``pass_counts``, but no row at all when one of the courses has no students."""
    row = pass_counts(facts, cohort, courses, pass_mark)
    for course in courses:
        row = row.filter(F.col(f"total_{course.lower()}") > 0)
    return row


def cohort_stats(
    facts: DataFrame, cohort: int, courses: Sequence[str] = COURSES, pass_mark: float = PASS_MARK
) -> DataFrame:
    """Six figures per course as (course, metric, value).

    The mean passing grade is over all courses, the other figures are the course's own.
    """
    entries = []
    for course in courses:
        name = course.lower()
        total, n_passed = F.col(f"total_{name}"), F.col(f"pass_count_{name}")
        rate = F.try_divide(n_passed, total) * 100
        figures = [
            ("Total Students", total),
            ("Average CCert", F.col(f"avg_cert_{name}")),
            ("Pass Rate (%)", rate),
            ("Average Passing Grade", F.col("avg_pass_grade")),
            (f"Average Passing Grade ({course})", F.col(f"avg_grade_{name}")),
            (f"Pass Rate ({course}) (%)", rate),
        ]
        entries += [
            F.struct(F.lit(course).alias("course"), F.lit(m).alias("metric"), v.cast("double").alias("value"))
            for m, v in figures
        ]
    return pass_counts(facts, cohort, courses, pass_mark).select(F.inline(F.array(*entries)))


def top_students(facts: DataFrame, groups: DataFrame, k: int = TOP_STUDENTS) -> DataFrame:
    """Best composite scores over all cohorts, students of a known group only.

    Students of unknown groups drop out before the cut; the names are joined to the k rows left.
    """
    columns = ["student_key", "course", "group_id", "c_cert", "grade"]
    order = [F.col("weighted_score").desc_nulls_last(), F.col("student_key")]
    known = facts.select(*columns).join(groups.select(F.col("id").alias("group_id")), "group_id", "left_semi")
    best = (
        known.withColumn("weighted_score", composite_score(F.col("grade"), F.col("c_cert"))).orderBy(*order).limit(k)
    )
    named = ["student_key", "course", "group_name", "c_cert", "grade", "weighted_score"]
    return with_group_name(best, groups).select(*named).orderBy(*order)
