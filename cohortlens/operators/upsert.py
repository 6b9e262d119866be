"""Set-based appends that can be repeated without making duplicates.

Every function returns the rows to add; writing them is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators.joins import absent_from, lookup_group_id, resolve_students
from cohortlens.operators.numbering import assign_ids, running_start
from cohortlens.schema import ASSESSMENTS, COHORT_TAG_RANGE, GROUPS, STUDENTS
from cohortlens.sources.tables import write_once


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-NULL values of a column."""
    return df.select(column).dropna().distinct()


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a schema; a column the frame lacks is NULL.

    Text for a whole number may have decimals (``45.0``) and is rounded, as a database does.
    """

    def column(field: T.StructField):
        if field.name not in df.columns:
            return F.lit(None).cast(field.dataType)
        value = F.col(field.name)
        if df.schema[field.name].dataType == T.StringType() and field.dataType == T.IntegerType():
            value = F.round(value.cast("double"))
        return value.cast(field.dataType)

    return df.select(*[column(f).alias(f.name) for f in schema.fields])


def check_tag(tag: int | str) -> int:
    """Cohort tag as a number; ValueError unless it is a whole number in the allowed range."""
    low, high = COHORT_TAG_RANGE
    value = int(tag)
    if not low <= value <= high:
        raise ValueError(f"cohort tag {value} is not in {low}..{high}")
    return value


def new_groups(batch: DataFrame, groups: DataFrame, name_column: str = "Previous School") -> DataFrame:
    """Group names of the batch that are not stored yet, with ids."""
    names = distinct_values(batch, name_column).withColumnRenamed(name_column, "name")
    return conform(assign_ids(absent_from(names, groups, "name"), "name", groups), GROUPS)


def first_of_each(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key in the given order, reduced on the map side."""
    row = F.struct(*batch.columns)
    firsts = batch.groupBy(F.col(key).alias("_of")).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return firsts.select("_row.*")


def new_students(
    batch: DataFrame,
    students: DataFrame,
    groups: DataFrame,
    cohort_id: int,
    row_id: str = "row_no",
    order: tuple[str, ...] = ("row_no",),
) -> DataFrame:
    """Students of the batch that are not stored yet, with ids and group ids.

    Within the batch the first row of an id wins. A stored student keeps the old cohort.
    Ids are compared as text. Rows without an id name no student and are left out.
    """
    columns = ["IDNumber", "Previous School", "Course"]
    rows = (
        batch.select(*dict.fromkeys([*columns, *order, row_id]))
        .filter(F.col("IDNumber").isNotNull())
        .withColumn("student_key", F.col("IDNumber").cast("string"))
    )
    fresh = absent_from(first_of_each(rows, "student_key", list(order)), students, "student_key")
    placed = lookup_group_id(fresh, groups, "Previous School", "student_key")
    numbered = assign_ids(
        placed.select("student_key", "group_id", F.col("Course").alias("course")), "student_key", students
    )
    return conform(
        numbered.withColumns({"cohort_id": F.lit(cohort_id), "training": F.lit(0)}), STUDENTS
    )


def assessed_keys(students: DataFrame, assessments: DataFrame) -> DataFrame:
    """Business keys of the students that have an assessment."""
    return students.join(
        assessments.select(F.col("student_id").alias("id")), "id", "left_semi"
    ).select("student_key")


def _assessment_rows(batch: DataFrame) -> DataFrame:
    keyed = batch.withColumn("student_key", F.col("IDNumber").cast("string"))
    names = {"CFIT": "cfit", "C Certification": "c_cert", "Final Grades": "grade"}
    return keyed.withColumnsRenamed({k: v for k, v in names.items() if k in batch.columns})


def new_assessments(
    batch: DataFrame,
    students: DataFrame,
    assessments: DataFrame,
    row_id: str = "row_no",
    dedupe: bool = False,
) -> DataFrame:
    """Assessments of known students that have none stored yet.

    Repeated ids inside the batch are all kept unless ``dedupe``. A student is assessed
    once: a later batch adds nothing for a stored one. Columns missing from the batch are
    NULL.
    """
    rows = _assessment_rows(batch)
    if dedupe:
        rows = first_of_each(rows, "student_key", [row_id])
    keys = students.select("student_key", F.col("id").alias("student_id"))
    open_keys = absent_from(keys, assessed_keys(students, assessments), "student_key")
    return conform(_numbered(rows.drop("student_id", "id"), open_keys, row_id, assessments), ASSESSMENTS)


def _numbered(rows: DataFrame, open_keys: DataFrame, row_id: str, existing: DataFrame) -> DataFrame:
    """The rows of the open students with ``student_id`` and the next free ids, in the order of ``md5(row_id)``.

    Who is known, what is stored and the ids are settled on the keys alone, with the number of rows
    of each; the wide rows move once, to meet them. Rows of one key are ordered by all their columns.
    """
    keys = ["student_key", row_id]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    known = write_once(counts.join(open_keys, "student_key"), "new-keys")
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("m"))
    started = running_start(known, row_id, F.col("_rows"), name="_start").drop("_rows")
    inside = Window.partitionBy(*keys, "student_id").orderBy(F.xxhash64(*rows.columns))
    numbered = rows.join(started, keys).withColumn("_place", F.row_number().over(inside))
    return numbered.withColumn("id", highest.scalar() + F.col("_start") + F.col("_place")).drop("_start", "_place")


def rejected_assessments(batch: DataFrame, students: DataFrame, row_id: str = "row_no") -> DataFrame:
    """Rows of the batch whose student is not stored."""
    _, unknown = resolve_students(_assessment_rows(batch), students, "student_key", row_id)
    return unknown
