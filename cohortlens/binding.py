"""The driver's test tables seen as students, assessments, groups and cohorts.

One order plays a student together with the assessment. Only the parts a query asks for
are read: the certification needs lineitem, the scores need embeddings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.joins import left_join_known
from cohortlens.schema import ATTR_COLS, ATTRIBUTES

LAST_REGISTERED = 2000


# Given with every read, so that no job is spent on finding the columns.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_quantity double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str, certs: bool = True, scores: bool = True) -> DataFrame:
    """Students joined with their assessments."""
    key = F.col("o_orderkey")
    band = F.substring("o_orderpriority", 1, 1)
    base = table(spark, sf_dir, "orders").select(
        key.alias("student_id"),
        key.cast("string").alias("student_key"),
        F.when(key % 20 != 0, F.col("o_custkey")).alias("group_id"),
        F.year("o_orderdate").alias("cohort_id"),
        F.when(key % 2 == 0, "BSCS").otherwise("BSIT").alias("course"),
        F.when(key % 50 == 0, "M")
        .when(band == "1", "H")
        .when(band == "2", "AA")
        .when(band == "3", "A")
        .when(band == "4", "BA")
        .otherwise("L")
        .alias("cfit"),
        (1 + F.col("o_totalprice") / 125000).alias("grade"),
    )
    if certs:
        cert = (
            table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_orderkey").alias("student_id"))
            .agg(F.floor(F.avg("l_quantity") * 1.6).cast("int").alias("c_cert"))
        )
        base = base.join(cert, "student_id", "left")
    if scores:
        # Students take the vectors in turn; their ids count from 0.
        stored = table(spark, sf_dir, "embeddings")
        count = max(stored.count(), 1)
        score = F.transform(
            F.slice("embedding", 1, len(ATTR_COLS)),
            lambda x: F.greatest(
                F.lit(1.0), F.least(F.lit(10.0), F.floor(5.5 + 16.0 * x).cast("double"))
            ).cast("int"),
        )
        vectors = stored.select(F.col("vec_id").alias("vec"), score.alias("scores")).select(
            "vec", *[F.col("scores")[k].alias(name) for k, name in enumerate(ATTR_COLS)]
        )
        missing = {"attr_A": 0, "attr_B": 1}
        base = (
            base.withColumn("vec", F.col("student_id") % count)
            .join(vectors, "vec")
            .drop("vec")
        )
        base = base.withColumns({
            name: F.when(F.col("student_id") % 33 != rest, F.col(name)) for name, rest in missing.items()
        })
    return base


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered cohorts; the last year of the orders is left unregistered."""
    year = F.year("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .select(year.alias("id"))
        .distinct()
        .filter(F.col("id") <= LAST_REGISTERED)
        .withColumn("name", F.col("id").cast("string"))
    )


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, certs=False, scores=False).select(
        F.col("student_id").alias("id"), "student_key", "group_id", "cohort_id", "course"
    )


def assessments(spark: SparkSession, sf_dir: str, certs: bool = True, scores: bool = True) -> DataFrame:
    frame = facts(spark, sf_dir, certs, scores)
    dropped = ["student_key", "group_id", "cohort_id", "course"]
    return frame.drop(*dropped).withColumn("id", F.col("student_id"))


def spelled_name() -> Column:
    """Group names as a sheet might spell them, by nation of the customer."""
    name, nation = F.col("c_name"), F.col("c_nationkey")
    return (
        F.when(nation == 0, F.concat(F.lit("University of Cebu - "), name))
        .when(nation == 1, F.concat(F.lit("univ-ty of san carlos "), name))
        .when(nation == 2, F.concat(F.lit("Unity of San Jose "), name))
        .when(nation == 3, F.concat(F.lit("The University of Cebu "), name))
        .otherwise(name)
    )


def profile_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All students as profile rows with padded, freely spelled group names."""
    names = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("group_id"),
        F.concat(F.lit("  "), spelled_name(), F.lit("\t ")).alias("Previous School"),
    )
    rows = facts(spark, sf_dir, certs=False).drop("grade")
    return left_join_known(rows, names, "group_id", "student_id").select(
        F.col("student_id").alias("row_no"),
        F.col("student_key").alias("IDNumber"),
        "Previous School",
        F.col("course").alias("Course"),
        F.col("cfit").alias("CFIT"),
        "cohort_id",
        *ATTR_COLS,
    )


def results_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certification and final grade as text, with open (INC) and missing grades."""
    status = (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("student_id"), "o_orderstatus")
    )
    key = F.col("student_id")
    return (
        facts(spark, sf_dir, scores=False)
        .join(status, "student_id")
        .select(
            F.col("student_key").alias("IDNumber"),
            F.col("c_cert").cast("string").alias("C Certification"),
            F.when(F.col("o_orderstatus") == "P", "INC")
            .when(key % 40 != 7, F.col("grade").cast("string"))
            .alias("Final Grades"),
        )
    )


def exported_sheet(rows: DataFrame, leading: dict[str, Column]) -> DataFrame:
    """Sheet cells as text: leading columns, then the scores under one heading, with the
    second heading row as a row of its own."""
    names = [*leading, "16PF", *[f"Unnamed: {len(leading) + k}" for k in range(1, len(ATTR_COLS))]]
    cells = rows.select(
        *[v.cast("string") for v in leading.values()], *[F.col(c).cast("string") for c in ATTR_COLS]
    ).toDF(*names)
    heading = [None] * len(leading) + ATTRIBUTES
    schema = ", ".join(f"`{n}` string" for n in names)
    return cells.unionAll(rows.sparkSession.createDataFrame([tuple(heading)], schema))


def profile_export(rows: DataFrame) -> DataFrame:
    blank = F.lit(None).cast("string")
    return exported_sheet(
        rows,
        {
            "No": F.col("row_no"),
            "ID Number": F.col("IDNumber"),
            "Name": blank,
            "Previous School": F.col("Previous School"),
            "Course": F.col("Course"),
            "Year": F.col("cohort_id"),
            "CFIT": F.col("CFIT"),
        },
    )


def score_export(rows: DataFrame) -> DataFrame:
    blank = F.lit(None).cast("string")
    return exported_sheet(
        rows,
        {
            "No": F.col("row_no"),
            "ID Number": F.col("IDNumber"),
            "Name": blank,
            "Previous School": F.col("Previous School"),
            "Year": F.col("cohort_id"),
            "CFIT": F.col("CFIT"),
        },
    )
