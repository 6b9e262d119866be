"""Sheets exported as CSV: profiles, results, certifications and rows to score.

Spark ships no reader for spreadsheet files, so each sheet is a folder of CSV files with
the sheet's own heading row in every file.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.text import canonical_name, strip
from cohortlens.operators.filters import not_equal_or_null, not_null, rename_by_position, strict_number
from cohortlens.schema import (
    ATTR_COLS,
    ATTRIBUTES,
    CERT_HEADING,
    CERT_ID_HEADING,
    GRADE_HEADING,
    GROUP_HEADING,
    ID_HEADING,
    NO_GRADE,
    PROFILE_SCORE_POSITION,
    SCORING_SCORE_POSITION,
)
from cohortlens.sources.tables import CSV_TEXT


# What the reader gives for an empty quoted cell, as it takes the empty text itself for NULL.
_EMPTY = "\0"


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV with headings, every cell as text and as it was written.

    A cell may hold line breaks unless ``multi_line`` is off, which lets Spark split large
    files. Cells are matched by position, so every file must have the headings in the same
    order: one that differs fails the query. Sheets with headings left blank cannot be checked.
    """
    options = {**CSV_TEXT, "multiLine": multi_line, "emptyValue": _EMPTY}
    schema = spark.read.options(**options).csv(path).schema
    blank = any(re.fullmatch(r"_c\d+", name) for name in schema.names)
    cells = spark.read.options(**options, enforceSchema=blank).schema(schema).csv(path)
    kept = [F.col(f"`{c}`") for c in cells.columns]
    return cells.select(*[F.when(c == _EMPTY, "").otherwise(c).alias(n) for c, n in zip(kept, cells.columns)])


def add_row_no(df: DataFrame) -> DataFrame:
    """Position of each row: file, place in the file, row in that place.

    Must be taken from a frame that comes straight from the files.
    """
    place = F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.withColumn("row_no", place)


def _scored_sheet(spark: SparkSession, path: str, score_position: int) -> DataFrame:
    """Sheet with two heading rows: the second, holding the score codes, is dropped."""
    cells = add_row_no(read_csv(spark, path))
    named = rename_by_position(cells, ATTR_COLS, score_position)
    # No score is a letter, so two of the 21 cells tell the heading row. Testing all of them would
    # cost the optimizer a constraint for every combination of the old and new column names.
    codes = F.trim(ATTR_COLS[0]).eqNullSafe(F.lit(ATTRIBUTES[0])) & F.trim(ATTR_COLS[-1]).eqNullSafe(
        F.lit(ATTRIBUTES[-1])
    )
    return named.withColumnRenamed(ID_HEADING, "IDNumber").filter(~codes)


def read_profile(spark: SparkSession, path: str, score_position: int = PROFILE_SCORE_POSITION) -> DataFrame:
    """Profile sheet of one course; the 21 scores are found by position, the rest by heading.

    Rows without a previous group are kept.
    """
    return _scored_sheet(spark, path, score_position).withColumn(GROUP_HEADING, strip(F.col(GROUP_HEADING)))


def read_score_input(
    spark: SparkSession, path: str, score_position: int = SCORING_SCORE_POSITION
) -> DataFrame:
    """Sheet of students to score; its scores start one column earlier."""
    return _scored_sheet(spark, path, score_position)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results sheet: id, certification and final grade, all text."""
    return read_csv(spark, path).select("IDNumber", CERT_HEADING, GRADE_HEADING)


def read_certifications(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path).withColumnRenamed(CERT_ID_HEADING, "IDNumber")


def clean_results(df: DataFrame) -> DataFrame:
    """Rows with a certification and no open grade; the grade as a number.

    A missing grade is kept. Text that is no number fails the query.
    """
    graded = not_equal_or_null(not_null(df, CERT_HEADING), GRADE_HEADING, NO_GRADE)
    return graded.withColumn(GRADE_HEADING, strict_number(F.col(GRADE_HEADING)))


def clean_profile(df: DataFrame) -> DataFrame:
    """Known spellings of the group names replaced."""
    return df.withColumn(GROUP_HEADING, canonical_name(F.col(GROUP_HEADING)))
