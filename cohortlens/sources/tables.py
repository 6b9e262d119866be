"""Stored tables: files or a database, append sinks, metric log, reference dimensions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.runtime import new_path, note_written
from cohortlens.schema import (
    ASSESSMENTS,
    BAND_SCALE,
    COHORTS,
    GLOBAL,
    GROUPS,
    PRIMARY,
    STUDENTS,
)

TABLES = {"groups": GROUPS, "cohorts": COHORTS, "students": STUDENTS, "assessments": ASSESSMENTS}
# Students of one cohort are read without touching the files of the others.
PARTITIONED_BY = {"students": ["cohort_id"]}
METRICS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("run_at", T.TimestampType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


class TableStore:
    """The star tables as parquet folders below one root.

    A table that was never written reads as empty.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], TABLES[name])
        stored = self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")
        return stored.select(*TABLES[name].fieldNames())

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.partitionBy(*PARTITIONED_BY.get(name, [])).mode("append").parquet(f"{self.root}/{name}")


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str],
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
) -> DataFrame:
    """Table of a database; with a partition column it is read in parallel ranges.

    Address and login come from the caller.
    """
    options = {"url": url, "dbtable": table, **properties}
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs bounds")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**options).load()


def append_to_database(df: DataFrame, url: str, table: str, properties: Mapping[str, str]) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **properties).mode("append").save()


# Cells are written and read as they are: blanks at the ends stay, quotes are doubled, an empty
# text is quoted and so differs from NULL, which is an empty cell.
CSV_TEXT = {
    "header": True,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": '""',
}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with headings, no row numbers."""
    df.write.options(**CSV_TEXT).csv(path)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back, for use in several places."""
    spark = df.sparkSession
    path = new_path(spark, name)
    note_written(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_spread(df: DataFrame, name: str) -> DataFrame:
    """As ``write_once``, the rows dealt out evenly to twice as many files as the cluster has cores.

    A table that is read in few parts keeps few cores busy in every later pass, whatever they do.
    """
    return write_once(df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism), name)


def log_metrics(spark: SparkSession, path: str, run_id: str, metrics: Mapping[str, float]) -> None:
    """Append the figures of one run."""
    rows = [(run_id, m, float(v)) for m, v in metrics.items()]
    frame = spark.createDataFrame(rows, "run_id string, metric string, value double")
    frame.select("run_id", F.current_timestamp().alias("run_at"), "metric", "value").write.mode(
        "append"
    ).parquet(path)


def latest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The newest value of every metric."""
    return (
        spark.read.schema(METRICS)
        .parquet(path)
        .groupBy("metric")
        .agg(F.max_by(F.struct("run_id", "value"), "run_at").alias("last"))
        .select("metric", "last.run_id", "last.value")
    )


def factor_dim(spark: SparkSession) -> DataFrame:
    """The 21 scores and whether each is a primary or a global factor."""
    rows = [(a, f"attr_{a}", "primary") for a in PRIMARY] + [(a, f"attr_{a}", "global") for a in GLOBAL]
    return spark.createDataFrame(rows, "code string, attribute string, factor_group string")


def band_dim(spark: SparkSession) -> DataFrame:
    """The ability bands with their place on the 1..10 scale."""
    return spark.createDataFrame(list(BAND_SCALE.items()), "code string, scale int")


def long_attributes(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Scores in long form with their factor group."""
    columns = [f"attr_{a}" for a in PRIMARY + GLOBAL]
    long = facts.unpivot(["student_id"], columns, "attribute", "value")
    return long.join(dim, "attribute")
