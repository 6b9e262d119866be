"""Group profiles against the overall averages, long forms and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scores import ordinal_band, percent_difference
from cohortlens.operators.filters import among
from cohortlens.operators.joins import join_long
from cohortlens.operators.quantile import exact_median
from cohortlens.schema import ATTRIBUTES, BAND_SCALE, COURSES, PASS_MARK
from cohortlens.sources.tables import write_once

# The measures of a profile, as named on the dashboard.
COUNT_MEASURES = ["Total Count"] + [f"{c} Count" for c in COURSES]
KPI_MEASURES = ["C Cert", "Average Passing Grade", "Passing Rate"]
SCORE_MEASURES = ["CFIT"] + ATTRIBUTES
MEASURES = ["Total Count"] + SCORE_MEASURES + KPI_MEASURES + [f"{c} Count" for c in COURSES]


def column_name(measure: str) -> str:
    """Measure name as a column name: ``C Cert`` -> ``c_cert``."""
    return measure.lower().replace(" ", "_")


def _averaged(pass_mark: float) -> dict[str, Column]:
    passed = F.col("grade") >= pass_mark
    values = {"CFIT": ordinal_band(F.col("cfit"))}
    values |= {a: F.col(f"attr_{a}") for a in ATTRIBUTES}
    values["C Cert"] = F.col("c_cert")
    values["Average Passing Grade"] = F.when(passed, F.col("grade"))
    values["Passing Rate"] = F.when(passed, 100).otherwise(0)
    return values


def _partial_sums(pass_mark: float) -> list[Column]:
    """Sum and count behind every measure, so that they can be added up further."""
    out = [F.count(F.lit(1)).alias("n:Total Count")]
    for course in COURSES:
        out.append(F.count(F.when(F.col("course") == course, 1)).alias(f"n:{course} Count"))
    for name, value in _averaged(pass_mark).items():
        out.append(F.sum(value.cast("double")).alias(f"s:{name}"))
        out.append(F.count(value).alias(f"c:{name}"))
    return out


def _add_up(sums: DataFrame) -> list[Column]:
    return [F.sum(f"`{c}`").alias(c) for c in sums.columns if c[:2] in ("n:", "s:", "c:")]


def _measures() -> list[Column]:
    out = []
    for name in MEASURES:
        if name in COUNT_MEASURES:
            value = F.coalesce(F.col(f"`n:{name}`"), F.lit(0)).cast("double")
        else:
            value = F.try_divide(F.col(f"`s:{name}`"), F.col(f"`c:{name}`"))
        out.append(value.alias(column_name(name)))
    return out


def _sums_by_group(
    facts: DataFrame, groups: DataFrame, cohorts: DataFrame, pass_mark: float
) -> DataFrame:
    """Sums per known group over students with a band on the scale and a registered cohort.

    Groups are matched after the aggregation, so that join sees one row per group instead of one
    per student.
    """
    registered = cohorts.select(F.col("id").alias("cohort_id"))
    rows = (
        among(facts, "cfit", list(BAND_SCALE))
        .filter(F.col("group_id").isNotNull())
        .join(registered, "cohort_id", "left_semi")
    )
    known = groups.select(F.col("id").alias("group_id"), "name")
    return rows.groupBy("group_id").agg(*_partial_sums(pass_mark)).join(known, "group_id")


def group_profiles(
    facts: DataFrame, groups: DataFrame, cohorts: DataFrame, pass_mark: float = PASS_MARK
) -> DataFrame:
    """All 28 measures of every group that has students."""
    sums = _sums_by_group(facts, groups, cohorts, pass_mark)
    return sums.select("group_id", "name", *_measures())


def group_profile(
    facts: DataFrame,
    groups: DataFrame,
    cohorts: DataFrame,
    group_id: int,
    pass_mark: float = PASS_MARK,
) -> DataFrame:
    """The measures of one group; always one row, NULLs when it has no students."""
    one = facts.filter(F.col("group_id") == group_id)
    sums = _sums_by_group(one, groups.filter(F.col("id") == group_id), cohorts, pass_mark)
    return sums.agg(*_add_up(sums)).select(*_measures())


def overall_profile(
    facts: DataFrame, groups: DataFrame, cohorts: DataFrame, pass_mark: float = PASS_MARK
) -> DataFrame:
    """The measures over all students together: not a mean of group means."""
    sums = _sums_by_group(facts, groups, cohorts, pass_mark)
    return sums.agg(*_add_up(sums)).select(*_measures())


def group_vs_overall(
    facts: DataFrame, groups: DataFrame, cohorts: DataFrame, pass_mark: float = PASS_MARK
) -> DataFrame:
    """Per group every measure, its overall value and the difference in percent.

    The sums per group are written once; the overall row is added up from them and enters as a
    scalar subquery.
    """
    sums = write_once(_sums_by_group(facts, groups, cohorts, pass_mark), "sums")
    names = [column_name(m) for m in MEASURES]
    overall = sums.agg(*_add_up(sums)).select(F.struct(*_measures()).alias("overall"))
    rows = sums.select("group_id", "name", *_measures()).withColumn("_overall", overall.scalar())
    out = ["group_id", "name"]
    for m in names:
        out += [
            F.col(m),
            F.col(f"_overall.{m}").alias(f"{m}_average"),
            percent_difference(F.col(m), F.col(f"_overall.{m}")).alias(f"{m}_difference"),
        ]
    return rows.select(*out)


def unpivot_attributes(wide: DataFrame, ids: Sequence[str] = ("group_id",)) -> DataFrame:
    """Score measures in long form: no counts, KPIs, averages or differences, no NULLs."""
    kept = [column_name(m) for m in SCORE_MEASURES]
    return wide.unpivot(list(ids), kept, "attribute", "value").filter(F.col("value").isNotNull())


def names_without(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose name does not contain the pattern."""
    return df.filter(~F.col(column).rlike(pattern))


def transpose_metrics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Wide row(s) as (metric, value) with all values as text."""
    columns = list(columns or df.columns)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot([], columns, "metric", "value")


def compare_attributes(group_row: DataFrame, overall_row: DataFrame) -> DataFrame:
    """Scores of one group beside the overall values; scores it does not have are left out."""
    return join_long(unpivot_attributes(group_row, ()), unpivot_attributes(overall_row, ()))


def kpi_comparison(group_row: DataFrame, overall_row: DataFrame) -> DataFrame:
    """KPIs of one group beside the overall values, in long form."""
    names = [column_name(m) for m in KPI_MEASURES]
    group = group_row.unpivot([], names, "attribute", "group_value")
    overall = overall_row.unpivot([], names, "attribute", "overall_value")
    return group.join(overall, "attribute").withColumn(
        "difference", percent_difference(F.col("group_value"), F.col("overall_value"))
    )


def summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, exact median, minimum and maximum of a column."""
    return exact_median(df, column, also=["mean", "min", "max"]).select(
        "mean", "median", F.col("min").alias("minimum"), F.col("max").alias("maximum")
    )
