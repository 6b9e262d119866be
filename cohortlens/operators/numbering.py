"""Positions and ranks over whole tables without sorting them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.sources.tables import write_once


def _bucket_digits(df: DataFrame) -> int:
    """Hex digits of the buckets: four buckets per shuffle partition at least, 4096 or more."""
    wanted = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = 3
    while 16**digits < wanted:
        digits += 1
    return digits


def running_start(
    df: DataFrame, key: str, weight: Column | None = None, within: Sequence[str] = (), name: str = "start"
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows, in the order of ``md5(key)``.

    Buckets by the leading digits of a digest are even. Sums run inside the buckets in
    parallel; only one total per bucket is summed in a single window. The number of buckets
    changes which task does what, not the sums. Rows that repeat a key are ordered by all their
    columns.
    """
    weight = F.lit(1) if weight is None else weight
    within = list(within)
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    rows = df.withColumns({"_digest": digest, "_weight": weight.cast("long")}).withColumn(
        "_bucket", F.substring("_digest", 1, _bucket_digits(df))
    )
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(*within, "_bucket")
        .agg(F.sum("_weight").alias("_total"))
        .select(*within, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    inside = (
        Window.partitionBy(*within, "_bucket")
        .orderBy("_digest", F.xxhash64(*df.columns))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .join(totals, [*within, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_digest", "_weight", "_bucket", "_inside", "_offset")
    )


def assign_ids(new_rows: DataFrame, key: str, existing: DataFrame, name: str = "id") -> DataFrame:
    """Give each new row the next free id, in the order of ``md5(key)``.

    The same rows get the same ids on every run, whatever their partitioning. The rows are
    written first, because numbering reads them twice and what found them may be costly.
    """
    new_rows = write_once(new_rows, "new-rows")
    highest = existing.agg(F.coalesce(F.max(name), F.lit(0)).cast("long").alias("m"))
    return running_start(new_rows, key, name="_start").withColumn(
        name, highest.scalar() + 1 + F.col("_start")
    ).drop("_start")


def dense_rank_of_values(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Dense rank by descending ``value``; equal values share a rank, NULL has none.

    Ranks are taken over the distinct values only. They are bucketed by their whole part, so
    a sort never sees more than one unit of the value range.
    """
    bucket = F.floor(F.col(value)).alias("_bucket")
    distinct = df.filter(F.col(value).isNotNull()).select(F.col(value), bucket).distinct()
    above = Window.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        distinct.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_total"))
        .select("_bucket", F.coalesce(F.sum("_total").over(above), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_bucket").orderBy(F.col(value).desc())
    ranks = (
        distinct.withColumn("_inside", F.row_number().over(inside))
        .join(totals, "_bucket")
        .select(value, (F.col("_offset") + F.col("_inside")).cast("int").alias(name))
    )
    return df.join(ranks, value, "left")
