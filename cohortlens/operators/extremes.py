"""Best and worst students and how their scores differ."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.scores import composite_score, ordinal_band, padded_square
from cohortlens.operators.correlate import target_correlations
from cohortlens.schema import ATTR_COLS, CONTRAST_PADDING, EXTREME_STUDENTS

FACTORS = ["cfit_rank"] + ATTR_COLS
SIDES = ["top", "bottom"]


def with_composite(facts: DataFrame) -> DataFrame:
    return facts.withColumn("weighted_score", composite_score(F.col("grade"), F.col("c_cert")))


def extremes(
    facts: DataFrame,
    cohort: int | None = None,
    k: int = EXTREME_STUDENTS,
    tie: str = "student_id",
) -> DataFrame:
    """The k best and the k worst composite scores, marked by ``side``.

    NULL scores are the lowest. With fewer than 2k students a student is on both sides. The
    students are read and scored once: each stands for both sides, every task keeps its own k
    of each side, and only those are moved and ranked.
    """
    rows = with_composite(facts if cohort is None else facts.filter(F.col("cohort_id") == cohort))
    both = rows.withColumn("side", F.explode(F.array(*map(F.lit, SIDES))))
    score = F.col("weighted_score")
    # Of the two orders, the one of the other side sees equal values only.
    orders = [
        F.when(F.col("side") == "top", score).desc_nulls_last(),
        F.when(F.col("side") == "bottom", score).asc_nulls_first(),
    ]
    place = F.row_number().over(Window.partitionBy("side").orderBy(*orders, tie))
    return both.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def extremes_with_rank(facts: DataFrame, k: int = EXTREME_STUDENTS) -> DataFrame:
    """Extremes over all cohorts with the band as a number, 0 where it has none."""
    ranked = facts.withColumn("cfit_rank", ordinal_band(F.col("cfit"), default=0))
    keep = ["student_key", "weighted_score", "cfit_rank", *ATTR_COLS, "side"]
    return extremes(ranked, None, k).select(*keep)


def extreme_correlations(
    sides: DataFrame, columns: Sequence[str] = ATTR_COLS, targets: Sequence[str] = ("c_cert", "grade")
) -> DataFrame:
    """Correlations with the targets inside each side."""
    parts = [
        target_correlations(sides.filter(F.col("side") == side), columns, targets).withColumn(
            "side", F.lit(side)
        )
        for side in SIDES
    ]
    both = reduce(DataFrame.unionByName, parts)
    return both.orderBy(F.col("side").desc(), F.abs("r").desc_nulls_last(), "target", "attribute")


def factor_means(df: DataFrame, factors: Sequence[str] = FACTORS) -> DataFrame:
    """``factor, mean`` over the non-NULL values, largest first."""
    means = df.agg(*[F.avg(f).alias(f) for f in factors])
    return means.unpivot([], list(factors), "factor", "mean").orderBy(
        F.col("mean").desc_nulls_last(), "factor"
    )


def factor_contrast(
    sides: DataFrame, factors: Sequence[str] = FACTORS, padding: float = CONTRAST_PADDING
) -> DataFrame:
    """Signed square of the padded difference of the side means, largest first."""
    def mean(side: str, factor: str):
        return F.avg(F.when(F.col("side") == side, F.col(factor)))

    diffs = sides.agg(*[(mean("top", f) - mean("bottom", f)).alias(f) for f in factors])
    return (
        diffs.unpivot([], list(factors), "factor", "difference")
        .select("factor", padded_square(F.col("difference"), padding).alias("contrast"))
        .orderBy(F.col("contrast").desc_nulls_last(), "factor")
    )
