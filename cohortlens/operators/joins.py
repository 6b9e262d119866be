"""Joins of the star tables and of staged sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.schema import COURSES


def left_join_known(left: DataFrame, right: DataFrame, key: str, row_id: str) -> DataFrame:
    """Left join on one key; rows whose key is NULL match nothing and are dealt out evenly.

    A NULL key would bring all its rows to one task. They get a key of their own instead that
    no right row has: a negative number, or a text that begins with a NUL character. Keys are
    surrogate ids or names, which have neither. Other frequent keys are left to Spark, which
    splits a skewed partition of either join at run time.
    """
    if isinstance(right.schema[key].dataType, T.StringType):
        apart = F.concat(F.lit("\0"), F.col(row_id).cast("string"))
    else:
        apart = -1 - F.pmod(F.xxhash64(row_id), F.lit(2**31 - 2)).cast("long")
    keyed = left.withColumn("_key", F.coalesce(F.col(key), apart))
    return keyed.join(right.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def join_facts(students: DataFrame, assessments: DataFrame) -> DataFrame:
    """Students with their assessments, on the surrogate id."""
    return students.withColumnRenamed("id", "student_id").join(
        assessments.withColumnRenamed("id", "assessment_id"), "student_id"
    )


def with_group_name(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Inner join with the groups; students without a known group drop out."""
    named = groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    return facts.join(named, "group_id")


def with_cohort_name(facts: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Inner join with the registered cohorts; other students drop out."""
    named = cohorts.select(F.col("id").alias("cohort_id"), F.col("name").alias("cohort_name"))
    return facts.join(named, "cohort_id")


def scores_of_cohort(assessments: DataFrame, students: DataFrame, cohort: int) -> DataFrame:
    """Assessments left-joined to students, then filtered on the student's cohort.

    The filter drops the unmatched rows, so the optimizer plans an inner join.
    """
    return (
        assessments.withColumnRenamed("id", "assessment_id")
        .join(students.withColumnRenamed("id", "student_id"), "student_id", "left")
        .filter(F.col("cohort_id") == cohort)
    )


def merge_on_id(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two sheets; repeated ids multiply, columns in both get _x and _y."""
    clash = [c for c in left.columns if c in right.columns and c != key]
    left = left.withColumnsRenamed({c: f"{c}_x" for c in clash})
    right = right.withColumnsRenamed({c: f"{c}_y" for c in clash})
    return left.join(right, key)


def lookup_group_id(
    df: DataFrame, groups: DataFrame, name_column: str, row_id: str, out: str = "group_id"
) -> DataFrame:
    """Left join on the exact group name; NULL when there is no such group."""
    dim = groups.select(F.col("name").alias(name_column), F.col("id").alias(out))
    return left_join_known(df, dim, name_column, row_id)


def absent_from(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the existing ones."""
    return df.join(existing.select(key), key, "left_anti")


def resolve_students(
    df: DataFrame, students: DataFrame, key: str, row_id: str
) -> tuple[DataFrame, DataFrame]:
    """Rows of known students with their surrogate id, and the rows of unknown ones."""
    known = students.select(F.col("student_key").alias(key), F.col("id").alias("student_id"))
    resolved = left_join_known(df, known, key, row_id)
    return (
        resolved.filter(F.col("student_id").isNotNull()),
        resolved.filter(F.col("student_id").isNull()).drop("student_id"),
    )


def expand_courses(df: DataFrame, courses: Sequence[str] = COURSES) -> DataFrame:
    """One row per input row and course."""
    return df.withColumn("course", F.explode(F.array(*[F.lit(c) for c in courses])))


def same_row(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both frames side by side, matched on the row key."""
    return left.join(right, key)


def join_long(left: DataFrame, right: DataFrame, on: str = "attribute") -> DataFrame:
    """Two long frames aligned by measure name."""
    return left.withColumnRenamed("value", "group_value").join(
        right.withColumnRenamed("value", "overall_value"), on
    )

