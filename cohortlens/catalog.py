"""Every operator as a query over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import binding as b
from cohortlens.functions import scores as sc
from cohortlens.functions import text as tx
from cohortlens.operators import (
    balance,
    correlate,
    early_stopping,
    extremes,
    features,
    filters,
    joins,
    models,
    profile,
    scorecard,
    upsert,
)
from cohortlens.plans import load as load_plan
from cohortlens.runtime import new_path
from cohortlens.schema import ASSESSMENTS, ATTR_COLS, BANDS, BASE_SCORES, COURSES, FEATURES, STACK_FEATURES
from cohortlens.sources import commits, sheets, tables
from cohortlens.streaming import load as stream_load

COHORT = 1998
COHORTS = [1995, 1996, 1997, 1998, 1999, 2000]
STORED_UNTIL = 1997
TARGETS = ["c_cert", "grade"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def scorecard_of(spark: SparkSession, sf: str, cohort: int | None) -> DataFrame:
    return scorecard.group_scorecard(b.facts(spark, sf, scores=False), b.groups(spark, sf), cohort)


# Sources and sinks ----------------------------------------------------------


def _profile_columns(df: DataFrame) -> DataFrame:
    columns = {"IDNumber": "id_number", "Previous School": "previous_school", "Course": "course", "CFIT": "cfit"}
    named = df.withColumnsRenamed(columns)
    kept = [c for c in columns.values() if c in named.columns]
    return named.select(*kept, *[F.col(c).cast("int").alias(c) for c in ATTR_COLS])


@query
def scan_profile(spark, sf):
    rows = b.profile_sheet(spark, sf)
    read = []
    for course in COURSES:
        path = new_path(spark, f"profile-{course}")
        tables.write_csv(b.profile_export(rows.filter(F.col("Course") == course)), path)
        read.append(sheets.read_profile(spark, path))
    return _profile_columns(read[0].unionByName(read[1]))


@query
def scan_results(spark, sf):
    path = new_path(spark, "results")
    tables.write_csv(b.results_sheet(spark, sf), path)
    grade = F.col("Final Grades")
    return rounded(
        sheets.read_results(spark, path).select(
            F.col("IDNumber").alias("id_number"),
            F.col("C Certification").cast("int").alias("c_cert"),
            (grade == "INC").alias("is_open"),
            filters.lenient_number(grade).alias("grade"),
        ),
        "grade",
    )


@query
def scan_csv(spark, sf):
    path = new_path(spark, "certifications")
    sheet = b.results_sheet(spark, sf).select(F.col("IDNumber").alias("ID No."), "C Certification")
    tables.write_csv(sheet, path)
    return sheets.read_certifications(spark, path).select(
        F.col("IDNumber").alias("id_number"), F.col("C Certification").cast("int").alias("c_cert")
    )


@query
def scan_facts(spark, sf):
    return rounded(filters.complete_rows(b.facts(spark, sf)), "grade")


@query
def list_groups(spark, sf):
    return b.groups(spark, sf)


@query
def list_cohorts(spark, sf):
    return b.cohorts(spark, sf)


@query
def scan_score_input(spark, sf):
    path = new_path(spark, "score-input")
    tables.write_csv(b.score_export(b.profile_sheet(spark, sf)), path)
    read = sheets.read_score_input(spark, path).drop("Previous School")
    return filters.complete_rows(_profile_columns(read))


@query
def sink_csv(spark, sf):
    path = new_path(spark, "scorecard")
    tables.write_csv(scorecard_of(spark, sf, COHORT), path)
    read = sheets.read_csv(spark, path)
    types = {"group_id": "bigint", "name": "string", "student_count": "bigint"}
    return read.select(*[F.col(c).cast(types.get(c, "double")).alias(c) for c in read.columns])


@query
def metrics_log(spark, sf):
    path = new_path(spark, "metrics")
    for cohort in COHORTS:
        row = scorecard.pass_counts(b.facts(spark, sf, scores=False), cohort).first()
        tables.log_metrics(
            spark, path, f"{cohort}-{uuid.uuid4().hex}", {"passers": row.pass_count, "mean": row.avg_pass_grade}
        )
    return rounded(tables.latest_metrics(spark, path).select("metric", "value"), "value")


@query
def factor_dim_join(spark, sf):
    long = tables.long_attributes(b.facts(spark, sf, certs=False), tables.factor_dim(spark))
    means = long.groupBy("factor_group", "code").agg(
        F.count("value").alias("n_values"), F.avg("value").alias("mean_value")
    )
    return rounded(means, "mean_value")


# Projections, filters, predicates -------------------------------------------


@query
def positional_rename(spark, sf):
    rows = b.facts(spark, sf, certs=False).select("student_id", *ATTR_COLS)
    unnamed = rows.toDF("student_id", "16PF", *[f"Unnamed: {k}" for k in range(8, 28)])
    return filters.rename_by_position(unnamed, ATTR_COLS, 1)


@query
def not_null_filter(spark, sf):
    rows = filters.not_null(b.results_sheet(spark, sf), "C Certification")
    return rows.select(F.col("IDNumber").alias("id_number"), F.col("C Certification").cast("int").alias("c_cert"))


@query
def null_safe_ne(spark, sf):
    rows = filters.not_equal_or_null(b.results_sheet(spark, sf), "Final Grades", "INC")
    return rows.select(F.col("IDNumber").alias("id_number"), F.col("Final Grades").isNull().alias("is_missing"))


@query
def strict_cast(spark, sf):
    rows = sheets.clean_results(b.results_sheet(spark, sf))
    return rounded(rows.select(F.col("IDNumber").alias("id_number"), F.col("Final Grades").alias("grade")), "grade")


@query
def coerce_cast(spark, sf):
    grade = filters.lenient_number(F.col("Final Grades"))
    rows = b.results_sheet(spark, sf).select(F.col("IDNumber").alias("id_number"), grade.alias("grade"))
    return rounded(rows, "grade")


@query
def dropna_any(spark, sf):
    return filters.complete_rows(b.facts(spark, sf), ["student_id", "attr_A", "attr_B", "c_cert", "group_id"])


@query
def filter_in(spark, sf):
    rows = filters.among(b.facts(spark, sf, False, False), "cohort_id", COHORTS)
    return filters.among(rows, "cfit", ["L", "BA", "A", "AA", "H"]).select("student_id", "cohort_id", "cfit")


@query
def filter_cohort(spark, sf):
    rows = filters.equal_to(b.facts(spark, sf, False, False), "cohort_id", COHORT)
    return rounded(rows.select("student_id", "group_id", "grade"), "grade")


@query
def filter_courses(spark, sf):
    frame = features.exploration_frame(b.facts(spark, sf, certs=False))
    return rounded(filters.in_courses(frame, ["BSCS"], ["weighted", "attr_A", "attr_B", "course"]), "weighted")


@query
def ordinal_encode(spark, sf):
    band = F.col("cfit")
    return b.facts(spark, sf, False, False).select(
        "student_id",
        sc.ordinal_band(band).alias("band_or_null"),
        sc.ordinal_band(band, 0).alias("band_or_zero"),
    )


@query
def indicator_cols(spark, sf):
    rows = features.course_indicators(b.facts(spark, sf, False, False))
    return rows.select("student_id", "course_bscs", "course_bsit")


@query
def discretize(spark, sf):
    weight = sc.grade_span(F.col("grade"))
    return b.facts(spark, sf, False, False).select(
        "student_id",
        sc.discretize(weight).alias("label"),
        sc.discretize(weight, (50, 85)).alias("label_85"),
        sc.discretize(weight, (50, 95)).alias("label_95"),
        sc.discretize(sc.grade_share(F.col("grade")) * 1.1).alias("label_over"),
    )


@query
def normalize_grade(spark, sf):
    grade = F.col("grade")
    rows = b.facts(spark, sf, scores=False).select(
        "student_id",
        sc.grade_span(grade).alias("span"),
        sc.grade_share(grade).alias("share"),
        sc.grade_blend(grade, F.col("c_cert")).alias("blend"),
    )
    return rounded(rows, "span", "share", "blend")


@query
def composite_score(spark, sf):
    return b.facts(spark, sf, scores=False).select(
        "student_id", sc.composite_score(F.col("grade"), F.col("c_cert")).alias("weighted_score")
    )


@query
def percent_difference(spark, sf):
    """Passing rates against the rate of all students, and against those of the group's BSIT course.

    A group whose BSIT students all failed has a base of zero, one without such students has none.
    """
    facts = b.facts(spark, sf, scores=False).filter(F.col("group_id").isNotNull())
    overall = scorecard.conditional_stats(facts, []).select("passing_rate").scalar()
    bsit = scorecard.conditional_stats(facts.filter(F.col("course") == "BSIT"), ["group_id"])
    cards = scorecard.conditional_stats(facts, ["group_id"]).join(
        bsit.select("group_id", F.col("passing_rate").alias("bsit_rate")), "group_id", "left"
    )
    return rounded(
        cards.select(
            "group_id",
            sc.percent_difference(F.col("passing_rate"), overall).alias("from_overall"),
            sc.percent_difference(F.col("passing_rate"), F.col("bsit_rate")).alias("from_bsit"),
        ),
        "from_overall",
        "from_bsit",
    )


@query
def unpivot_attributes(spark, sf):
    wide = profile.group_vs_overall(b.facts(spark, sf), b.groups(spark, sf), b.cohorts(spark, sf))
    return rounded(profile.unpivot_attributes(wide), "value")


@query
def transpose_metrics(spark, sf):
    best = scorecard.best_group(scorecard_of(spark, sf, COHORT))
    return profile.transpose_metrics(
        best, ["performance", "name", "student_count", "avg_passing_grade", "passing_rate", "weighted_score"]
    )


@query
def domain_violations(spark, sf):
    rows = b.facts(spark, sf, False, False)
    return filters.domain_violations(rows, "cfit", [band for band in BANDS if band != "M"])


# Joins ------------------------------------------------------------------------


@query
def merge_results(spark, sf):
    profiles = sheets.clean_profile(
        b.profile_sheet(spark, sf).withColumn("Previous School", tx.strip(F.col("Previous School")))
    )
    merged = joins.merge_on_id(profiles, sheets.clean_results(b.results_sheet(spark, sf)), "IDNumber")
    return rounded(
        merged.select(
            F.col("IDNumber").alias("id_number"),
            F.col("Previous School").alias("previous_school"),
            "attr_C",
            F.col("C Certification").cast("int").alias("c_cert"),
            F.col("Final Grades").alias("grade"),
        ),
        "grade",
    )


@query
def merge_cert(spark, sf):
    certs = filters.not_null(b.results_sheet(spark, sf).drop("Final Grades"), "C Certification")
    merged = joins.merge_on_id(b.profile_sheet(spark, sf), certs, "IDNumber")
    return merged.select(
        F.col("IDNumber").alias("id_number"),
        F.col("Course").alias("course"),
        F.col("C Certification").cast("int").alias("c_cert"),
    )


def _star(spark, sf):
    return joins.join_facts(b.students(spark, sf), b.assessments(spark, sf, scores=False))


@query
def join_facts(spark, sf):
    return rounded(_star(spark, sf).select("student_id", "student_key", "cohort_id", "c_cert", "grade"), "grade")


@query
def join_star3(spark, sf):
    named = joins.with_group_name(_star(spark, sf), b.groups(spark, sf))
    return named.select("student_id", "group_id", "group_name", "cohort_id", "c_cert")


@query
def join_star4(spark, sf):
    named = joins.with_group_name(_star(spark, sf), b.groups(spark, sf))
    tagged = joins.with_cohort_name(named, b.cohorts(spark, sf))
    return tagged.select("student_id", "group_name", "cohort_name", "course")


@query
def left_join_reduced(spark, sf):
    rows = joins.scores_of_cohort(b.assessments(spark, sf, scores=False), b.students(spark, sf), COHORT)
    return rounded(rows.select("student_id", "cohort_id", "c_cert", "grade"), "grade")


@query
def stats_cross(spark, sf):
    row = scorecard.pass_counts_complete(b.facts(spark, sf, scores=False), COHORT)
    return rounded(row, "avg_pass_grade", "avg_cert_bscs", "avg_grade_bscs", "avg_cert_bsit", "avg_grade_bsit")


@query
def lookup_group_id(spark, sf):
    sheet = b.profile_sheet(spark, sf).withColumn("Previous School", tx.strip(F.col("Previous School")))
    found = joins.lookup_group_id(sheet, b.groups(spark, sf), "Previous School", "row_no")
    return found.select(F.col("IDNumber").alias("id_number"), "group_id")


def _stored_students(spark, sf):
    return b.students(spark, sf).filter(F.col("cohort_id") <= STORED_UNTIL)


def _stored_assessments(spark, sf):
    stored = b.facts(spark, sf, scores=False).filter(F.col("cohort_id") < STORED_UNTIL)
    return stored.withColumn("id", F.col("student_id"))


def _stored_groups(spark, sf):
    used = b.facts(spark, sf, False, False).filter(F.col("cohort_id") == COHORTS[0])
    return b.groups(spark, sf).join(used.select(F.col("group_id").alias("id")), "id", "left_semi")


def _batch(spark, sf):
    sheet = b.profile_sheet(spark, sf).withColumn("Previous School", tx.strip(F.col("Previous School")))
    return sheets.clean_profile(sheet)


@query
def anti_existing(spark, sf):
    keys = upsert.assessed_keys(_stored_students(spark, sf), _stored_assessments(spark, sf))
    batch = b.profile_sheet(spark, sf).withColumnRenamed("IDNumber", "student_key")
    return joins.absent_from(batch, keys, "student_key").select("student_key", "cohort_id")


@query
def resolve_students(spark, sf):
    known, unknown = joins.resolve_students(
        b.profile_sheet(spark, sf), _stored_students(spark, sf), "IDNumber", "row_no"
    )
    columns = [F.col("IDNumber").alias("id_number"), "student_id"]
    rejected = unknown.withColumn("student_id", F.lit(None).cast("bigint"))
    return known.select(*columns).unionByName(rejected.select(*columns))


@query
def concat_rows(spark, sf):
    """Features and labels side by side, matched on the row key instead of the position."""
    frame = _training(spark, sf)
    return joins.same_row(frame.select("student_id", "attr_C", "cfit_H"), frame.select("student_id", "label"), "student_id")


@query
def expand_courses(spark, sf):
    return joins.expand_courses(b.facts(spark, sf, False, False).select("student_id", "cfit"))


@query
def compare_long(spark, sf):
    args = (b.facts(spark, sf), b.groups(spark, sf), b.cohorts(spark, sf))
    group = profile.unpivot_attributes(profile.group_profiles(*args))
    overall = profile.unpivot_attributes(profile.overall_profile(*args), ids=())
    return rounded(joins.join_long(group, overall), "group_value", "overall_value")


# Aggregations -----------------------------------------------------------------


@query
def group_scorecard(spark, sf):
    return scorecard_of(spark, sf, COHORT)


@query
def group_scorecard_all(spark, sf):
    return scorecard_of(spark, sf, None)


@query
def conditional_aggs(spark, sf):
    stats = scorecard.conditional_stats(b.facts(spark, sf, scores=False), ["cohort_id", "course"])
    return rounded(stats, "mean_passing_grade", "passing_rate", "mean_cert")


@query
def cohort_stats(spark, sf):
    return rounded(scorecard.cohort_stats(b.facts(spark, sf, scores=False), COHORT), "value")


def _profile_args(spark, sf):
    return b.facts(spark, sf), b.groups(spark, sf), b.cohorts(spark, sf)


def _round_measures(df: DataFrame, digits: int = 9) -> DataFrame:
    return rounded(df, *[c for c in df.columns if c not in ("group_id", "name")], digits=digits)


@query
def group_profile(spark, sf):
    return _round_measures(profile.group_profiles(*_profile_args(spark, sf)))


@query
def group_profile_one(spark, sf):
    return _round_measures(profile.group_profile(*_profile_args(spark, sf), group_id=1))


@query
def overall_profile(spark, sf):
    return _round_measures(profile.overall_profile(*_profile_args(spark, sf)))


@query
def group_vs_overall(spark, sf):
    return _round_measures(profile.group_vs_overall(*_profile_args(spark, sf)), digits=8)


@query
def kpi_comparison(spark, sf):
    args = _profile_args(spark, sf)
    rows = profile.kpi_comparison(profile.group_profile(*args, group_id=1), profile.overall_profile(*args))
    return rounded(rows, "group_value", "overall_value", "difference")


def _cohort_scores(spark, sf):
    return b.facts(spark, sf).filter(F.col("cohort_id") == COHORT)


@query
def corr_matrix(spark, sf):
    return rounded(correlate.correlation_matrix(_cohort_scores(spark, sf), ATTR_COLS + TARGETS), "r")


@query
def corr_targets(spark, sf):
    return rounded(correlate.target_correlations(_cohort_scores(spark, sf), ATTR_COLS, TARGETS), "r")


@query
def corr_extremes(spark, sf):
    return rounded(extremes.extreme_correlations(extremes.extremes(b.facts(spark, sf), COHORT)), "r")


@query
def corr_by_attribute(spark, sf):
    frame = features.exploration_frame(b.facts(spark, sf, certs=False))
    rows = filters.among(frame, "course", COURSES)
    return rounded(correlate.target_correlations(rows, [*ATTR_COLS, "cfit"], ["weighted"]), "r")


@query
def sort_by_attribute(spark, sf):
    frame = features.exploration_frame(b.facts(spark, sf, certs=False))
    rows = filters.in_courses(frame, COURSES, ["weighted", "attr_A", "course"])
    return rounded(rows.orderBy("attr_A"), "weighted")


@query
def grade_summary(spark, sf):
    frame = features.exploration_frame(b.facts(spark, sf, certs=False))
    rows = filters.in_courses(frame, COURSES, ["weighted"])
    return rounded(profile.summary(rows, "weighted"), "mean", "median", "minimum", "maximum")


@query
def factor_means(spark, sf):
    sides = extremes.extremes_with_rank(b.facts(spark, sf))
    return rounded(extremes.factor_means(sides.filter(F.col("side") == "top")), "mean")


@query
def factor_contrast(spark, sf):
    return rounded(extremes.factor_contrast(extremes.extremes_with_rank(b.facts(spark, sf))), "contrast")


@query
def distinct_groups(spark, sf):
    return upsert.distinct_values(_batch(spark, sf), "Previous School").withColumnRenamed("Previous School", "name")


# Ranks, top-k, set operations -------------------------------------------------


@query
def group_rank(spark, sf):
    return scorecard.group_rank(scorecard_of(spark, sf, None)).select(
        "group_id", "name", "student_count", "weighted_score", "rank"
    )


@query
def best_group(spark, sf):
    return rounded(scorecard.best_group(scorecard_of(spark, sf, COHORT)), "avg_passing_grade")


@query
def worst_group(spark, sf):
    return rounded(scorecard.worst_group(scorecard_of(spark, sf, COHORT)), "avg_passing_grade")


@query
def top10_groups(spark, sf):
    return scorecard.top_groups(scorecard_of(spark, sf, COHORT))


@query
def top10_students(spark, sf):
    return rounded(scorecard.top_students(b.facts(spark, sf, scores=False), b.groups(spark, sf)), "grade")


@query
def extremes_cohort(spark, sf):
    rows = extremes.extremes(b.facts(spark, sf, scores=False), COHORT)
    return rounded(rows.select("side", "student_id", "c_cert", "grade", "weighted_score"), "grade")


@query
def extremes_union(spark, sf):
    return extremes.extremes_with_rank(b.facts(spark, sf), 30)


@query
def append_courses(spark, sf):
    rows = b.profile_sheet(spark, sf).select(F.col("IDNumber").alias("id_number"), F.col("Course").alias("course"))
    parts = [
        rows.filter(F.col("course") == c).withColumn("course_order", F.lit(k)) for k, c in enumerate(COURSES)
    ]
    return parts[0].unionByName(parts[1])


# Scalar functions ---------------------------------------------------------------


@query
def str_trim(spark, sf):
    return b.profile_sheet(spark, sf).select(
        F.col("IDNumber").alias("id_number"), tx.strip(F.col("Previous School")).alias("previous_school")
    )


@query
def canonicalize_names(spark, sf):
    return b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), tx.canonical_name(b.spelled_name()).alias("name")
    )


@query
def rounding(spark, sf):
    price = F.col("o_totalprice")
    return b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("student_id"),
        F.round(price / 7, 2).alias("half_up"),
        F.bround(price / 7, 2).alias("half_even"),
        sc.round_binary(price / 7).alias("binary"),
    )


@query
def log_target(spark, sf):
    rows = b.facts(spark, sf, False, False).select("student_id", sc.grade_share(F.col("grade")).alias("weighted"))
    return rounded(features.log_target(rows), "weighted", "log_target", "restored")


@query
def pct_format(spark, sf):
    share = F.col("o_totalprice") / 500000
    return b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("student_id"), tx.percent_text(share).alias("confidence")
    )


@query
def name_pattern(spark, sf):
    return profile.names_without(b.groups(spark, sf), "name", "0[1-4]|99")


# Repeatable load -----------------------------------------------------------------


@query
def upsert_groups(spark, sf):
    return upsert.new_groups(_batch(spark, sf), _stored_groups(spark, sf))


@query
def upsert_students(spark, sf):
    rows = upsert.new_students(
        _batch(spark, sf), _stored_students(spark, sf), b.groups(spark, sf), COHORT, "row_no"
    )
    return rows.drop("training")


@query
def append_assessments(spark, sf):
    merged = joins.merge_on_id(
        b.profile_sheet(spark, sf), sheets.clean_results(b.results_sheet(spark, sf)), "IDNumber"
    )
    rows = upsert.new_assessments(merged, _stored_students(spark, sf), _stored_assessments(spark, sf))
    return rounded(rows, "grade")


@query
def conform_columns(spark, sf):
    rows = b.facts(spark, sf, scores=False).select(F.col("student_id").alias("id"), "student_id", "cfit", "grade")
    return rounded(upsert.conform(rows, ASSESSMENTS), "grade")


def _loaded(store: tables.TableStore) -> DataFrame:
    """The loaded tables as one frame, without the ids the load made up."""
    rows = joins.join_facts(store.read("students"), store.read("assessments"))
    groups = store.read("groups").select(F.col("id").alias("group_id"), F.col("name").alias("group_name"))
    cohorts = store.read("cohorts").select(F.col("id").alias("cohort_id"), F.col("name").alias("cohort_name"))
    named = rows.join(groups, "group_id", "left").join(cohorts, "cohort_id")
    columns = ["student_key", "course", "group_name", "cohort_name", "cfit", *ATTR_COLS, "c_cert", "grade"]
    return rounded(named.select(*columns), "grade")


def _course_sheets(spark, sf):
    rows, results = b.profile_sheet(spark, sf), b.results_sheet(spark, sf)
    trimmed = rows.withColumn("Previous School", tx.strip(F.col("Previous School")))
    # Sheets are files: stored once, and read by every load.
    trimmed, results = tables.write_once(trimmed, "profile-sheet"), tables.write_once(results, "results-sheet")
    return [
        load_plan.CourseSheets(trimmed.filter(F.col("Course") == course), results) for course in COURSES
    ]


@query
def load_twice(spark, sf):
    """The whole load, run twice under two tags: the second run adds nothing."""
    store = tables.TableStore(spark, new_path(spark, "store"))
    sheets_of_courses = _course_sheets(spark, sf)
    for tag in (2000, 3000):
        load_plan.load(store, sheets_of_courses, tag)
    return _loaded(store)


@query
def load_committed(spark, sf):
    """The load by commits: after a job that ended before its commit, and once more afterwards."""
    store = commits.CommittedStore(spark, new_path(spark, "store"))
    sheets_of_courses = _course_sheets(spark, sf)
    staged = [tables.write_once(load_plan.stage(c), "staged") for c in sheets_of_courses]
    load_plan.load_batches(store.attempt(), staged, 1999)
    for _ in range(2):
        load_plan.load_committed(store, sheets_of_courses, 2000)
    return _loaded(store)


@query
def load_arriving(spark, sf):
    """The load as a stream of staged files."""
    store = tables.TableStore(spark, new_path(spark, "store"))
    path = new_path(spark, "arriving")
    for course in _course_sheets(spark, sf):
        load_plan.stage(course).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    staged = stream_load.arriving(spark, path, schema)
    stream_load.load_stream(staged, store, 2000, new_path(spark, "progress")).awaitTermination()
    return _loaded(store)


# Features and labels ---------------------------------------------------------------


@query
def one_hot_fixed(spark, sf):
    rows = features.one_hot(b.facts(spark, sf, False, False), "cfit", BANDS)
    return rows.select("student_id", *[F.col(f"cfit_{band}") for band in BANDS])


def _training(spark, sf):
    return features.training_frame(b.facts(spark, sf, certs=False), COHORTS)


@query
def training_features(spark, sf):
    return rounded(_training(spark, sf), "weighted")


@query
def binary_targets(spark, sf):
    return features.binary_targets(_training(spark, sf)).select("student_id", "label", "target_fail", "target_pass", "target_success")


@query
def one_hot_label(spark, sf):
    return features.one_hot_label(_training(spark, sf)).select("student_id", "label_0", "label_1", "label_2")


@query
def split_hash(spark, sf):
    return features.split_by_hash(_training(spark, sf), "student_id").select("student_id", "is_test")


@query
def fold_assign(spark, sf):
    return features.assign_folds(_training(spark, sf), "student_id").select("student_id", "fold")


@query
def verdict(spark, sf):
    e = F.col("embedding")
    size = [F.abs(e[k].cast("double")) for k in range(6)]
    total = size[0] + size[1] + size[2]
    shares = F.array(*[F.try_divide(size[k], total) for k in range(3)])
    free = F.array(*[size[k] * 4 for k in range(3, 6)])
    return b.table(spark, sf, "embeddings").select(
        "vec_id", sc.verdict(shares).alias("verdict_of_shares"), sc.verdict(free).alias("verdict_of_free")
    )


# Models ------------------------------------------------------------------------------


def _training_rows(spark, sf):
    return tables.write_spread(_training(spark, sf), "training")


def _ordinal_rows(spark, sf):
    frame = features.ordinal_training_frame(b.facts(spark, sf, certs=False), COHORTS)
    return tables.write_spread(frame, "ordinal-training")


@query
def assemble(spark, sf):
    return models.assemble(_training(spark, sf)).select("student_id", "label", "features")


@query
def vector_cells(spark, sf):
    """The assembled vectors cell by cell."""
    cells = vector_to_array("features")
    rows = models.assemble(_training(spark, sf)).select("student_id", F.posexplode(cells).alias("position", "value"))
    return rows


@query
def oversample(spark, sf):
    return balance.oversample(_training_rows(spark, sf), "label", FEATURES)


@query
def oversample_counts(spark, sf):
    """Rows per class after balancing, and how many of them are new."""
    rows = balance.oversample(_training_rows(spark, sf), "label", FEATURES)
    made = F.sum(F.col("is_synthetic").cast("bigint"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), made.alias("n_new"))


@query
def mlp_classify(spark, sf):
    return models.kfold_classifier(_ordinal_rows(spark, sf), "student_id", features.ORDINAL_FEATURES, balanced=False)


@query
def held_out_rows(spark, sf):
    """The rows that tell a network when to stop."""
    marked = early_stopping.mark_held_out(_training(spark, sf), "student_id")
    return marked.select("student_id", "is_held_out")


@query
def early_stop_curve(spark, sf):
    """Losses and accuracies of every round of a network that stops by itself."""
    rows = _ordinal_rows(spark, sf)
    return early_stopping.fit_until_flat(rows, "student_id", features.ORDINAL_FEATURES)[1]


@query
def early_stop_folds(spark, sf):
    return early_stopping.kfold_until_flat(_ordinal_rows(spark, sf), "student_id", features.ORDINAL_FEATURES)


@query
def fold_summary(spark, sf):
    """Mean and spread of the folds' accuracy and loss."""
    rows = _ordinal_rows(spark, sf)
    return models.mean_and_spread(
        models.kfold_classifier(rows, "student_id", features.ORDINAL_FEATURES, balanced=False)
    )


def _net_on_test_rows(spark, sf):
    rows = features.split_by_hash(_training_rows(spark, sf), "student_id")
    model = models.network(FEATURES, 3).fit(rows.filter("NOT is_test"))
    return models.class_probabilities(model.transform(rows.filter("is_test")))


@query
def eval_metrics(spark, sf):
    return models.classifier_metrics(_net_on_test_rows(spark, sf))


@query
def predicted_classes(spark, sf):
    """The class of every test row, and whether it is the one of the largest probability."""
    p = F.col("p")
    best = F.array_position(p, F.array_max(p)) - 1
    return _net_on_test_rows(spark, sf).select("student_id", "label", "predicted", (best == F.col("predicted")).alias("is_largest"))


@query
def probability_sums(spark, sf):
    """The probabilities of every test row add up to 1."""
    total = F.aggregate("p", F.lit(0.0), lambda x, y: x + y)
    return _net_on_test_rows(spark, sf).select("student_id", F.size("p").alias("n_classes"), F.round(total, 6).alias("total"))


@query
def kfold_eval(spark, sf):
    """Folds over the whole stack: base models, their scores and the top model inside each."""
    return models.kfold_stack(_training_rows(spark, sf), "student_id")


@query
def stack_train(spark, sf):
    rows = _training_rows(spark, sf)
    model = models.fit_stack(rows, "student_id")
    return model.transform(rows).select("student_id", "label", *BASE_SCORES, "p", "predicted")


@query
def batch_score(spark, sf):
    model = models.fit_stack(_training_rows(spark, sf), "student_id")
    students = b.profile_sheet(spark, sf).select("IDNumber", "CFIT", *ATTR_COLS)
    return models.score_students(model, filters.require_domain(students, "CFIT"))


@query
def scored_students(spark, sf):
    """Which students a batch scores, by a network in place of the stack, and that none lacks a verdict."""
    rows = _training_rows(spark, sf)
    fitted = models.fit_all([
        partial(models.network(FEATURES, 2, label=f"target_{name}").fit, features.binary_targets(rows))
        for name in BASE_SCORES
    ])
    base = models.StackedModel(dict(zip(BASE_SCORES, fitted)), None)
    top = models.network(STACK_FEATURES, 3).fit(tables.write_once(base.base_scores(rows), "scored"))
    model = models.StackedModel(base.base, top)
    scored = models.score_students(model, b.profile_sheet(spark, sf).select("IDNumber", "CFIT", *ATTR_COLS))
    told = [F.col(f"{c}-Verdict").isNotNull() for c in COURSES]
    return scored.select(F.col("IDNumber").alias("id_number"), (told[0] & told[1]).alias("has_verdicts"))


@query
def model_roundtrip(spark, sf):
    rows = _training_rows(spark, sf)
    path = new_path(spark, "model")
    models.fit_stack(rows, "student_id").save(path)
    return models.StackedModel.load(path).transform(rows).select("student_id", "p")


@query
def model_store(spark, sf):
    """A saved network gives the scores it gave before."""
    rows = _training_rows(spark, sf)
    path = new_path(spark, "model")
    model = models.network(FEATURES, 3).fit(rows)
    model.write().save(path)
    before = models.class_probabilities(model.transform(rows)).withColumnRenamed("p", "before").drop("predicted")
    after = models.class_probabilities(PipelineModel.load(path).transform(before))
    return after.select("student_id", (F.col("p") == F.col("before")).alias("is_same"))


# Scores computed from the vectors in place of a model's, so that SQL can tell the figures.


def _fixed_scores(spark, sf):
    cells = F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double")) + 0.001)
    rows = b.table(spark, sf, "embeddings").select("vec_id", cells.alias("s"))
    total = F.col("s")[0] + F.col("s")[1] + F.col("s")[2]
    return rows.select(
        "vec_id",
        (F.col("vec_id") % 3).cast("int").alias("label"),
        (F.col("vec_id") % 5).cast("int").alias("fold"),
        F.array(*[F.col("s")[k] / total for k in range(3)]).alias("p"),
        (100 * F.col("s")[3]).alias("weighted"),
        (100 * F.col("s")[0]).alias("prediction"),
    )


def _fixed_base_scores(spark, sf):
    p = F.col("p")
    return _fixed_scores(spark, sf).select("label", *[p[k].alias(name) for k, name in enumerate(BASE_SCORES)])


@query
def fixed_metrics(spark, sf):
    rows = models.classifier_metrics(_fixed_scores(spark, sf), by=["fold"])
    return rounded(rows, "accuracy", "loss")


@query
def fixed_fold_summary(spark, sf):
    rows = models.mean_and_spread(models.classifier_metrics(_fixed_scores(spark, sf), by=["fold"]))
    return rounded(rows, *rows.columns)


@query
def fixed_classes(spark, sf):
    return _fixed_scores(spark, sf).select("vec_id", "label", models.likeliest_class(F.col("p")).alias("predicted"))


@query
def fixed_audit(spark, sf):
    rows = models.score_audit(_fixed_scores(spark, sf), "vec_id")
    return rounded(rows, *rows.columns[1:])


@query
def fixed_corr_scores(spark, sf):
    return rounded(correlate.correlation_matrix(_fixed_base_scores(spark, sf), BASE_SCORES), "r")


@query
def fixed_base_metrics(spark, sf):
    return rounded(models.base_metrics(_fixed_base_scores(spark, sf)), "accuracy", "loss")


@query
def fixed_errors(spark, sf):
    return rounded(models.regression_metrics(_fixed_scores(spark, sf), by=["fold"]), "loss", "mae")


@query
def fixed_gaps(spark, sf):
    """Accuracy and absolute error of five models that all score every row alike, in and out of their folds."""
    rows = _fixed_scores(spark, sf).withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(4))))
    scored = rows.withColumn("held_out", F.col("fold") == F.col("model")).drop("fold").withColumnRenamed("model", "fold")
    right = (models.likeliest_class(F.col("p")) == F.col("label")).cast("double")
    error = F.abs(F.col("weighted") - F.col("prediction"))
    parts = [
        models.train_validation_gap(scored, measure).withColumn("measure", F.lit(name))
        for name, measure in (("accuracy", right), ("mae", error))
    ]
    return rounded(parts[0].unionByName(parts[1]), "train", "validation", "gap")


@query
def regress_gap(spark, sf):
    """Absolute error of boosted trees on the rows they were fitted on and on those held out."""
    scored = models.boosted_by_every_fold(_ordinal_rows(spark, sf), "student_id", features.ORDINAL_FEATURES)
    return models.train_validation_gap(scored, F.abs(F.col("weighted") - F.col("prediction")))


@query
def corr_scores(spark, sf):
    return correlate.correlation_matrix(models.stacked_features(_training_rows(spark, sf), "student_id"), BASE_SCORES)


@query
def base_accuracy(spark, sf):
    """Accuracy and loss of each base model on rows it did not see."""
    return models.base_metrics(models.stacked_features(_training_rows(spark, sf), "student_id"))


def _forest(spark, sf):
    return models.forest_regression(_ordinal_rows(spark, sf), "student_id", features.ORDINAL_FEATURES)[1]


@query
def forest_regress(spark, sf):
    return _forest(spark, sf)


@query
def forest_mae(spark, sf):
    return models.mean_absolute_error(_forest(spark, sf))


@query
def forest_test_rows(spark, sf):
    """The rows a forest is tested on and their actual values, restored from the logarithm."""
    positive = features.log_target(_ordinal_rows(spark, sf).filter(F.col("weighted") > 0))
    rows = features.split_by_hash(positive, "student_id").filter("is_test")
    return rounded(rows.select("student_id", F.col("restored").alias("actual")), "actual")


@query
def forest_classify(spark, sf):
    _, scored = models.forest_classification(_ordinal_rows(spark, sf), "student_id", features.ORDINAL_FEATURES)
    return scored.select("student_id", "label", "p", "predicted")


@query
def kfold_regress(spark, sf):
    return models.kfold_regression(_ordinal_rows(spark, sf), "student_id", features.ORDINAL_FEATURES)


@query
def score_audit(spark, sf):
    rows = _ordinal_rows(spark, sf)
    model = models.network(features.ORDINAL_FEATURES, 3).fit(rows)
    return models.score_audit(models.class_probabilities(model.transform(rows)), "student_id")


@query
def audit_originals(spark, sf):
    """The audited students with the grade their weight came from."""
    rows = _ordinal_rows(spark, sf).withColumn("p", F.array(*[F.lit(0.0)] * 3))
    return rounded(models.score_audit(rows, "student_id").select("student_id", "original"), "original")


@query
def regression_audit(spark, sf):
    rows = _ordinal_rows(spark, sf)
    return models.regression_audit(models.boosted(features.ORDINAL_FEATURES).fit(rows).transform(rows), "student_id")


# Rows of the survey that had no query of their own ------------------------------------


@query
def rank_of_one_group(spark, sf):
    return scorecard.rank_of_group(scorecard_of(spark, sf, None), 1)


@query
def compare_one_group(spark, sf):
    args = _profile_args(spark, sf)
    rows = profile.compare_attributes(profile.group_profile(*args, group_id=1), profile.overall_profile(*args))
    return rounded(rows, "group_value", "overall_value")


@query
def rejected_rows(spark, sf):
    """Rows of a batch whose student is not stored."""
    rows = upsert.rejected_assessments(b.profile_sheet(spark, sf), _stored_students(spark, sf))
    return rows.select("student_key", F.col("Course").alias("course"))


@query
def text_cells(spark, sf):
    """Cells with blanks at their ends, quotes, line breaks, nothing or NULL, written and read back."""
    key, name = F.col("c_custkey"), F.col("c_name")
    cell = (
        F.when(key % 6 == 0, F.concat(F.lit("  "), name, F.lit(" \t")))
        .when(key % 6 == 1, F.concat(name, F.lit('"quoted", with a comma')))
        .when(key % 6 == 2, F.concat(name, F.lit("\nsecond line")))
        .when(key % 6 == 3, F.lit(""))
        .when(key % 6 == 4, F.lit(None).cast("string"))
        .otherwise(F.concat(name, F.lit("\\")))
    )
    path = new_path(spark, "cells")
    tables.write_csv(b.table(spark, sf, "customer").select(key.alias("id"), cell.alias("cell")), path)
    return sheets.read_csv(spark, path).select(F.col("id").cast("bigint").alias("id"), "cell")
