"""Exact median of a column too large to sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.sources.tables import write_once

_BINS = 4096


def exact_median(
    df: DataFrame, column: str, accuracy: int = 10_000, also: Sequence[str] = ()
) -> DataFrame:
    """One row ``median``: the middle value, or the mean of the two middle values.

    ``also`` names other aggregates (``mean``, ``min``, ``max``) to return beside it; they
    cost no further pass.

    The column is written once, so that the input is not run again for every pass.

    A mergeable sketch brackets the middle to within a few parts in ``accuracy``. Rows below
    the bracket are only counted, equal values collapse to a count, and the bracket is cut
    into bins, so just the one or two bins around the middle are put in order.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    values = write_once(values, "values")
    margin = 2.0 / accuracy
    bracket = values.agg(
        F.percentile_approx("v", [0.5 - margin, 0.5 + margin], accuracy).alias("b"),
        F.count(F.lit(1)).alias("n"),
        *[getattr(F, a)("v").alias(a) for a in also],
    ).select(F.struct(F.col("b")[0].alias("low"), F.col("b")[1].alias("high"), "n", *also).alias("s"))
    s = bracket.scalar()

    entries = (
        values.select("v", s.alias("s"))
        .filter(F.col("v") <= F.col("s.high"))
        .select(
            F.when(F.col("v") >= F.col("s.low"), F.col("v")).alias("v"),
            F.when(
                F.col("v") >= F.col("s.low"),
                F.coalesce(
                    F.floor(
                        F.try_divide(F.col("v") - F.col("s.low"), F.col("s.high") - F.col("s.low")) * _BINS
                    ),
                    F.lit(0),
                ),
            )
            .otherwise(-1)
            .alias("bin"),
            F.col("s.n").alias("n"),
        )
        .groupBy("bin", "v", "n")
        .agg(F.count(F.lit(1)).alias("c"))
    )

    def holds(rank: Column) -> Column:
        return (F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)

    low_rank, high_rank = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    bins = (
        entries.groupBy("bin", "n")
        .agg(F.sum("c").alias("c"))
        .withColumn("upto", F.sum("c").over(Window.orderBy("bin")))
        .filter(holds(low_rank) | holds(high_rank))
        .select("bin", (F.col("upto") - F.col("c")).alias("before"))
    )
    inside = Window.partitionBy("bin").orderBy("v")
    return (
        entries.join(F.broadcast(bins), "bin")  # one or two rows
        .withColumn("upto", F.col("before") + F.sum("c").over(inside))
        .agg(
            F.max(F.when(holds(low_rank), F.col("v"))).alias("a"),
            F.max(F.when(holds(high_rank), F.col("v"))).alias("b"),
        )
        .select(((F.col("a") + F.col("b")) / 2).alias("median"), s.alias("s"))
        .select("median", *[f"s.{a}" for a in also])
    )
