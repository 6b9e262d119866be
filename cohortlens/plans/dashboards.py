"""The frames behind each dashboard page; nothing is computed until they are used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import correlate, extremes, features, filters, profile, scorecard
from cohortlens.schema import ATTR_COLS, COURSES

TARGETS = ["c_cert", "grade"]


def cohort_dashboard(facts: DataFrame, groups: DataFrame, cohort: int) -> dict[str, DataFrame]:
    """Pass statistics, group scorecards, correlations and contrasts of one cohort.

    Best students and the contrast are over all cohorts.
    """
    cards = scorecard.group_scorecard(facts, groups, cohort)
    of_cohort = facts.filter(F.col("cohort_id") == cohort)
    sides = extremes.extremes_with_rank(facts)
    return {
        "statistics": scorecard.cohort_stats(facts, cohort),
        "best_group": profile.transpose_metrics(scorecard.best_group(cards)),
        "worst_group": profile.transpose_metrics(scorecard.worst_group(cards)),
        "top_groups": scorecard.top_groups(cards),
        "top_students": scorecard.top_students(facts, groups),
        "correlations": correlate.correlation_matrix(of_cohort, ATTR_COLS + TARGETS),
        "target_correlations": correlate.target_correlations(of_cohort, ATTR_COLS, TARGETS),
        "extreme_correlations": extremes.extreme_correlations(extremes.extremes(facts, cohort)),
        "top_means": extremes.factor_means(sides.filter(F.col("side") == "top")),
        "bottom_means": extremes.factor_means(sides.filter(F.col("side") == "bottom")),
        "contrast": extremes.factor_contrast(sides),
    }


def group_dashboard(
    facts: DataFrame, groups: DataFrame, cohorts: DataFrame, group_id: int
) -> dict[str, DataFrame]:
    """One group against the overall averages, and its rank."""
    own = profile.group_profile(facts, groups, cohorts, group_id)
    overall = profile.overall_profile(facts, groups, cohorts)
    return {
        "profile": own,
        "overall": overall,
        "kpis": profile.kpi_comparison(own, overall),
        "attributes": profile.compare_attributes(own, overall),
        "rank": scorecard.rank_of_group(scorecard.group_scorecard(facts, groups), group_id),
    }


def exploration(
    facts: DataFrame, attributes: Sequence[str], courses: Sequence[str] = COURSES
) -> dict[str, DataFrame]:
    """Grade against chosen attributes, their correlations and the grade summary."""
    rows = filters.in_courses(
        features.exploration_frame(facts), courses, ["weighted", *attributes, "course"]
    )
    return {
        "rows": rows,
        "correlations": correlate.target_correlations(rows, attributes, ["weighted"]),
        "summary": profile.summary(rows, "weighted"),
    }
