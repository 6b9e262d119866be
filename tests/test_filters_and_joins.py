import pytest
from pyspark.sql import functions as F

from cohortlens.operators import filters, joins


def as_rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_not_equal_keeps_null(spark):
    df = spark.createDataFrame([("INC",), ("2.0",), (None,)], "g string")
    assert as_rows(filters.not_equal_or_null(df, "g", "INC")) == [("2.0",), (None,)]


def test_empty_list_is_an_error(spark):
    with pytest.raises(ValueError):
        filters.among(spark.range(1), "id", [])


def test_complete_rows_looks_at_projected_columns_only(spark):
    df = spark.createDataFrame([(1, None, 1), (2, 2, None)], "a int, b int, c int")
    assert as_rows(filters.complete_rows(df, ["a", "b"])) == [(2, 2)]
    assert as_rows(filters.complete_rows(df)) == []


def test_casts(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "t string")
    assert as_rows(df.select(filters.lenient_number(F.col("t")))) == [(1.5,), (None,), (None,)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(filters.strict_number(F.col("t"))).collect()


def test_domain(spark):
    df = spark.createDataFrame([("A",), ("Z",), (None,), ("Z",)], "cfit string")
    assert as_rows(filters.domain_violations(df)) == [("Z", 2), (None, 1)]
    with pytest.raises(Exception, match="cfit holds Z, known values are A, AA"):
        filters.require_domain(df.filter("cfit = 'Z'")).collect()
    with pytest.raises(Exception, match="cfit holds NULL"):
        filters.require_domain(df.filter("cfit IS NULL")).collect()
    good = df.filter("cfit = 'A'")
    assert as_rows(filters.require_domain(good)) == as_rows(good)


def test_rename_by_position(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id int, `16PF` int, `Unnamed: 8` int")
    assert filters.rename_by_position(df, ["x", "y"], 1).columns == ["id", "x", "y"]
    with pytest.raises(ValueError):
        filters.rename_by_position(df, ["x", "y"], 2)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, a third NULL, the rest spread; both sides repeat keys."""
    keys = [1] * 200 + [None] * 200 + list(range(2, 202))
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "row long, k long")
    right = spark.createDataFrame([(k, f"v{k}-{j}") for k in range(0, 150) for j in range(2)], "k long, v string")
    return left, right


@pytest.mark.parametrize("kind", ["long", "string"])
def test_left_join_known_equals_plain_join(skewed, kind):
    left, right = (df.withColumn("k", F.col("k").cast(kind)) for df in skewed)
    joined = joins.left_join_known(left, right, "k", "row").select("k", "row", "v")
    assert as_rows(joined) == as_rows(left.join(right, ["k"], "left").select("k", "row", "v"))


def test_left_join_known_deals_out_nulls(skewed):
    left, right = skewed
    joined = joins.left_join_known(left, right, "k", "row")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(k" in plan
    dealt = left.withColumn("_key", F.coalesce("k", -1 - F.pmod(F.xxhash64("row"), F.lit(2**31 - 2))))
    assert dealt.filter("k IS NULL").groupBy("_key").count().agg(F.max("count")).first()[0] <= 2


def test_hot_key_is_split_at_run_time(spark):
    """Adaptive execution splits the partition of a key with most rows, and nothing is planned twice."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        # Text that does not compress, from several tasks: a split is made at the borders of map outputs.
        facts = spark.range(0, 60_000, 1, 8).select(
            F.col("id").alias("student_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 500 + 2).otherwise(1).alias("group_id"),
            F.sha2(F.col("id").cast("string"), 256).alias("note"),
        )
        groups = spark.range(1, 600).select("id", F.col("id").cast("string").alias("name"))
        joined = joins.with_group_name(facts, groups)
        assert joined.count() == 60_000
        sizes = joined.groupBy(F.spark_partition_id()).agg(F.count("note").alias("n"), F.max("note")).collect()
        assert max(r.n for r in sizes) < 30_000
        assert joined._jdf.queryExecution().toString().count("Scan ExistingRDD") <= 2
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_merge_multiplies_and_renames(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 3, "y"), (None, 4, "z")],
                                 "id string, row_no int, Course string")
    right = spark.createDataFrame([("a", "p"), ("a", "q"), ("c", "r"), (None, "s")], "id string, Course string")
    merged = joins.merge_on_id(left, right, "id")
    assert set(merged.columns) == {"id", "row_no", "Course_x", "Course_y"}
    assert merged.count() == 4


def test_resolve_and_absent(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, row_no int")
    stored = spark.createDataFrame([("a", 7)], "student_key string, id long")
    known, unknown = joins.resolve_students(df, stored, "key", "row_no")
    assert [(r.key, r.student_id) for r in known.collect()] == [("a", 7)]
    assert [r.key for r in unknown.collect()] == ["b"]
    existing = spark.createDataFrame([("a",)], "key string")
    assert as_rows(joins.absent_from(df, existing, "key")) == [("b", 2)]


def test_expand_courses(spark):
    df = spark.createDataFrame([(1, "old")], "id int, course string")
    assert as_rows(joins.expand_courses(df)) == [(1, "BSCS"), (1, "BSIT")]
