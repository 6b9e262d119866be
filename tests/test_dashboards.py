import pytest
from pyspark.sql import functions as F

from cohortlens.operators import extremes, profile, scorecard
from cohortlens.plans import dashboards
from cohortlens.schema import ATTR_COLS

SCHEMA = (
    "student_id long, student_key string, group_id long, cohort_id long, course string, cfit string, "
    + ", ".join(f"{a} int" for a in ATTR_COLS)
    + ", c_cert int, grade double"
)


def student(i, group, grade, cert=40, cohort=1, course="BSCS", band="A", score=5):
    return (i, f"S{i:03d}", group, cohort, course, band, *[score] * len(ATTR_COLS), cert, grade)


@pytest.fixture(scope="module")
def groups(spark):
    names = [(g, f"group {g}") for g in range(1, 8)]
    return spark.createDataFrame(names, "id long, name string")


@pytest.fixture(scope="module")
def facts(spark):
    rows = []

    def add(group, grades, **more):
        for g in grades:
            rows.append(student(len(rows) + 1, group, g, **more))

    add(1, [4.0, 3.0, 2.0, 3.0])              # four: ranked
    add(2, [5.0, 5.0, 5.0])                   # three: too small
    add(3, [1.0, 2.0, 1.0, 2.0, 1.0])         # no passer: score NULL
    add(4, [3.0, 4.0, 3.0, 2.0])              # same score as group 1
    add(5, [5.0, 5.0, 5.0, 5.0], cert=80)     # best
    add(None, [5.0] * 6)                      # no group
    add(99, [5.0] * 6)                        # unknown group
    add(6, [3.0, 3.0, None, 3.0], cohort=2, course="BSIT", band="M")
    return spark.createDataFrame(rows, SCHEMA)


def test_scorecard_edges(facts, groups):
    cards = {r.group_id: r for r in scorecard.group_scorecard(facts, groups).collect()}
    assert set(cards) == {1, 3, 4, 5, 6}
    one = cards[1]
    assert (one.student_count, one.passing_rate, one.avg_cert_grade) == (4, 75.0, 50.0)
    assert one.avg_passing_grade == 66.67
    assert one.weighted_score == pytest.approx(50 * (10 / 3) / 5 + 30 * 0.75 + 20 * 0.5, abs=0.01)
    assert cards[3].weighted_score is None and cards[3].passing_rate == 0.0
    assert cards[5].weighted_score == 100.0
    assert cards[6].passing_rate == 75.0  # a missing grade is no pass
    assert set(r.group_id for r in scorecard.group_scorecard(facts, groups, cohort=2).collect()) == {6}
    assert scorecard.group_scorecard(facts, groups, min_size=4).count() == 1


def test_ranks_and_ends(facts, groups):
    cards = scorecard.group_scorecard(facts, groups)
    ranks = {r.group_id: r["rank"] for r in scorecard.group_rank(cards).collect()}
    assert ranks[5] == 1 and ranks[1] == ranks[4] and ranks[3] is None
    assert scorecard.rank_of_group(cards, 2).count() == 0
    assert scorecard.best_group(cards).first().group_id == 5
    assert scorecard.best_group(cards).first().avg_passing_grade == 5.0
    assert scorecard.worst_group(cards).first().group_id == 3
    assert scorecard.worst_group(cards, exclude_null=True).first().group_id in (1, 4, 6)
    top = [r.group_id for r in scorecard.top_groups(cards, 10).collect()]
    assert top[0] == 5 and top[-1] == 3 and top.index(1) < top.index(4)


def test_top_students_need_a_known_group(facts, groups):
    rows = scorecard.top_students(facts, groups, 8).collect()
    assert {r.group_name for r in rows} <= {f"group {g}" for g in range(1, 8)}
    assert [r.weighted_score for r in rows[:4]] == [1.0] * 4


def test_cohort_without_a_course(facts):
    stats = {(r.course, r.metric): r.value for r in scorecard.cohort_stats(facts, 2).collect()}
    assert stats[("BSCS", "Total Students")] == 0
    assert stats[("BSCS", "Pass Rate (%)")] is None
    assert stats[("BSIT", "Pass Rate (BSIT) (%)")] == 75.0
    assert scorecard.pass_counts_complete(facts, 2).count() == 0
    assert scorecard.pass_counts(facts, 2).first().pass_count == 3


def test_profiles(spark, facts, groups):
    registered = spark.createDataFrame([(1, "2001")], "id long, name string")
    rows = {r.group_id: r for r in profile.group_profiles(facts, groups, registered).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}  # cohort 2 is not registered, M has no place on the scale
    assert rows[1].total_count == 4 and rows[1].cfit == 6 and rows[1].bscs_count == 4
    overall = profile.overall_profile(facts, groups, registered).first()
    assert overall.total_count == 20
    compared = {r.group_id: r for r in profile.group_vs_overall(facts, groups, registered).collect()}
    assert compared[1].total_count_difference == pytest.approx((4 - 20) / 20 * 100)
    assert compared[1].bsit_count_difference is None
    nobody = profile.group_profile(facts, groups, registered, 7).collect()
    assert len(nobody) == 1 and nobody[0].total_count == 0 and nobody[0].cfit is None
    long = profile.unpivot_attributes(profile.group_profile(facts, groups, registered, 7), ())
    assert long.count() == 0


def test_dashboards_have_all_parts(spark, facts, groups):
    registered = spark.createDataFrame([(1, "2001"), (2, "2002")], "id long, name string")
    parts = dashboards.cohort_dashboard(facts, groups, 1)
    assert {k: v.count() for k, v in parts.items()}["statistics"] == 12
    assert parts["best_group"].filter("metric = 'performance'").first().value == "Best"
    own = dashboards.group_dashboard(facts, groups, registered, 5)
    assert own["rank"].first()["rank"] == 1
    assert own["attributes"].count() == 22 and own["kpis"].count() == 3
    explored = dashboards.exploration(facts.filter("cfit = 'A' AND grade IS NOT NULL"), ["attr_A", "cfit"])
    assert explored["correlations"].count() == 2
    assert explored["summary"].first().maximum == 100.0
    with pytest.raises(ValueError):
        dashboards.exploration(facts, ["attr_A"], [])


def test_extremes_overlap_and_null_scores(spark, groups):
    rows = [student(i, 1, 1.0 + i / 10, cert=i) for i in range(1, 41)] + [student(41, 1, None), student(42, 1, 3.0, None)]
    sides = extremes.extremes(spark.createDataFrame(rows, SCHEMA))
    count = {r.side: r["count"] for r in sides.groupBy("side").count().collect()}
    assert count == {"top": 30, "bottom": 30}
    bottom = [r.student_id for r in sides.filter("side = 'bottom'").collect()]
    assert {41, 42} <= set(bottom)
    assert sides.groupBy("student_id").count().filter("count = 2").count() > 0


def test_ties_go_by_id(spark):
    facts = spark.createDataFrame([student(i, 1, 3.0) for i in range(1, 41)], SCHEMA)
    top = extremes.extremes(facts.repartition(5), k=3).filter("side = 'top'")
    assert sorted(r.student_id for r in top.collect()) == [1, 2, 3]


def test_contrast_changes_sign_with_the_sides(spark):
    rows = [student(i, 1, 1.0 + i / 20, score=1 + i % 9, band="HLA"[i % 3]) for i in range(1, 81)]
    sides = extremes.extremes_with_rank(spark.createDataFrame(rows, SCHEMA))
    other = sides.withColumn("side", F.when(F.col("side") == "top", "bottom").otherwise("top"))
    one = {r.factor: r.contrast for r in extremes.factor_contrast(sides).collect()}
    two = {r.factor: r.contrast for r in extremes.factor_contrast(other).collect()}
    assert len(one) == 22
    assert all(one[f] == pytest.approx(-two[f]) for f in one)


def test_factor_dimension(spark):
    from cohortlens.sources import tables

    dim = tables.factor_dim(spark)
    assert dim.groupBy("factor_group").count().orderBy("factor_group").collect() == [("global", 5), ("primary", 16)]
    assert tables.band_dim(spark).count() == 5
