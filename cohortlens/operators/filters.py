"""Row filters and projections with the NULL rules of the data model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.schema import BANDS


def rename_by_position(df: DataFrame, names: Sequence[str], start: int) -> DataFrame:
    """Rename the columns from position ``start`` on; the others keep their names."""
    if start + len(names) > len(df.columns):
        raise ValueError(f"{len(df.columns)} columns, cannot name {len(names)} from {start}")
    head, tail = df.columns[:start], df.columns[start + len(names):]
    return df.toDF(*head, *names, *tail)


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def not_equal_or_null(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows that differ from ``value``; a NULL differs from it and stays."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Project, then drop every row with a NULL in any projected column."""
    return (df.select(*columns) if columns else df).dropna("any")


def equal_to(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def among(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is in the list; an empty list is an error."""
    if not values:
        raise ValueError(f"no values given for {column}")
    return df.filter(F.col(column).isin(list(values)))


def in_courses(df: DataFrame, courses: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return among(df, "course", courses).select(*columns)


def strict_number(col: Column) -> Column:
    """Text to double; text that is no number fails the query (ANSI mode)."""
    return col.cast("double")


def lenient_number(col: Column) -> Column:
    """Text to double; text that is no number becomes NULL."""
    return col.try_cast("double")


def domain_violations(df: DataFrame, column: str = "cfit", allowed: Sequence[str] = BANDS) -> DataFrame:
    """Values outside the domain (NULL is outside) with the number of their rows."""
    value = F.col(column)
    return (
        df.filter(value.isNull() | ~value.isin(list(allowed)))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def require_domain(df: DataFrame, column: str = "cfit", allowed: Sequence[str] = BANDS) -> DataFrame:
    """The frame with a check in its plan: a value outside the domain (NULL too) fails the query."""
    value = F.col(column)
    told = F.concat(
        F.lit(f"{column} holds "), F.coalesce(value, F.lit("NULL")), F.lit(f", known values are {', '.join(allowed)}")
    )
    return df.withColumn(column, F.when(value.isin(list(allowed)), value).otherwise(F.raise_error(told)))
