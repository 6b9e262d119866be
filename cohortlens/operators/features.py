"""Feature columns and label columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.scores import discretize, grade_share, grade_span, indicator, ordinal_band
from cohortlens.operators.filters import among
from cohortlens.schema import ATTR_COLS, BAND_SCALE, BANDS, BASE_SCORES, COURSES, FEATURES, LABEL_CUTS, LABEL_CUTS_OLD

ORDINAL_FEATURES = [*ATTR_COLS, "cfit", "course"]


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    """One 0/1 column per listed value, all of them always there; other values give zeros."""
    prefix = column if prefix is None else prefix
    return df.withColumns({f"{prefix}_{v}": indicator(F.col(column), v) for v in values})


def one_hot_label(df: DataFrame, label: str = "label", classes: int = 3) -> DataFrame:
    return df.withColumns(
        {f"{label}_{k}": F.when(F.col(label) == k, 1).otherwise(0) for k in range(classes)}
    )


def binary_targets(df: DataFrame, label: str = "label") -> DataFrame:
    """Targets of the three base models: ``target_fail``, ``target_pass``, ``target_success``."""
    return df.withColumns(
        {f"target_{name}": (F.col(label) == k).cast("double") for k, name in enumerate(BASE_SCORES)}
    )


def course_indicators(df: DataFrame) -> DataFrame:
    return df.withColumns({f"course_{c.lower()}": indicator(F.col("course"), c) for c in COURSES})


def training_frame(
    facts: DataFrame,
    cohorts: Sequence[int],
    cuts: tuple[float, float] = LABEL_CUTS,
    row_id: str = "student_id",
) -> DataFrame:
    """Row id, weight, label and the feature columns of complete rows of the given cohorts."""
    rows = among(facts, "cohort_id", cohorts)
    raw = rows.select(row_id, grade_span(F.col("grade")).alias("weighted"), *ATTR_COLS, "cfit", "course")
    encoded = course_indicators(one_hot(raw.dropna("any"), "cfit", BANDS))
    return encoded.withColumn("label", discretize(F.col("weighted"), cuts)).select(
        row_id, "weighted", "label", *[F.col(c).cast("double").alias(c) for c in FEATURES]
    )


def ordinal_training_frame(
    facts: DataFrame,
    cohorts: Sequence[int],
    cuts: tuple[float, float] = LABEL_CUTS_OLD,
    row_id: str = "student_id",
) -> DataFrame:
    """Older form of the training rows: the share of the best grade as weight, the band as a
    number and one course indicator."""
    raw = among(facts, "cohort_id", cohorts).select(
        row_id,
        grade_share(F.col("grade")).alias("weighted"),
        *ATTR_COLS,
        ordinal_band(F.col("cfit")).alias("cfit"),
        indicator(F.col("course"), COURSES[0]).alias("course"),
    )
    complete = raw.dropna("any").withColumn("label", discretize(F.col("weighted"), cuts))
    return complete.select(
        row_id, "weighted", "label", *[F.col(c).cast("double").alias(c) for c in ORDINAL_FEATURES]
    )


def exploration_frame(facts: DataFrame) -> DataFrame:
    """Weight, scores, ordinal band and course indicators of complete rows with a band on the scale."""
    rows = among(facts, "cfit", list(BAND_SCALE))
    return course_indicators(
        rows.select(
            grade_span(F.col("grade")).alias("weighted"),
            *ATTR_COLS,
            ordinal_band(F.col("cfit")).alias("cfit"),
            "course",
        ).dropna("any")
    )


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket 0..buckets-1 from the digest of a key: stable, and even for unique keys."""
    digest = F.md5(key.cast("string").cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def split_by_hash(df: DataFrame, key: str, buckets: int = 5) -> DataFrame:
    """Mark one bucket of ``buckets`` as test rows."""
    return df.withColumn("is_test", bucket_of(F.col(key), buckets) == 0)


def assign_folds(df: DataFrame, key: str, folds: int = 5, salt: str = "") -> DataFrame:
    """Folds by the digest of the key; another ``salt`` gives folds that know nothing of the first."""
    own = F.concat(F.lit(salt), F.col(key).cast("string")) if salt else F.col(key)
    return df.withColumn("fold", bucket_of(own, folds))


def log_target(df: DataFrame, target: str = "weighted") -> DataFrame:
    """Natural logarithm of a positive target, and its inverse as a check column."""
    return df.withColumn("log_target", F.ln(target)).withColumn("restored", F.exp("log_target"))
