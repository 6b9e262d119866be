from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import numbering, upsert
from cohortlens.plans.load import CourseSheets, load, stage
from cohortlens.runtime import new_path, shared_dir
from cohortlens.schema import ASSESSMENTS, ATTR_COLS, ATTRIBUTES, STUDENTS
from cohortlens.sources import sheets, tables

SCORES = ", ".join(f"{a} string" for a in ATTR_COLS)
PROFILE = f"row_no int, IDNumber string, `Previous School` string, Course string, CFIT string, {SCORES}"
RESULTS = "IDNumber string, `C Certification` string, `Final Grades` string"


def profile_row(n, key, school, course="BSCS", score="5"):
    return (n, key, school, course, "A", *[score] * len(ATTR_COLS))


@pytest.fixture
def store(spark):
    return tables.TableStore(spark, new_path(spark, "store"))


def course(spark, profiles, results):
    return CourseSheets(spark.createDataFrame(profiles, PROFILE), spark.createDataFrame(results, RESULTS))


@pytest.fixture
def batch(spark):
    first = course(
        spark,
        [
            profile_row(1, "a", "Univ-ty of Cebu Main"),
            profile_row(2, "b", None),
            profile_row(3, "c", "School X"),
            profile_row(4, "d", "School X"),
            profile_row(5, "e", "School Y"),
            profile_row(6, None, "School Z"),
        ],
        [("a", "45.0", "2.5"), ("a", "50", "2.0"), ("b", "60", None), ("c", "70", "INC"), ("d", None, "3.0"),
         ("e", "10", "4"), ("zz", "10", "4"), (None, "1", "1")],
    )
    second = course(spark, [profile_row(1, "a", "School X", "BSIT"), profile_row(2, "f", "School Q", "BSIT")],
                    [("a", "11", "1.0"), ("f", "12", "1.0")])
    return [first, second]


def contents(store):
    return {
        name: sorted(map(tuple, store.read(name).collect()), key=repr)
        for name in ("groups", "cohorts", "students", "assessments")
    }


def test_cleaning_rules(spark, batch):
    staged = {(r.IDNumber, r["C Certification"]): r for r in stage(batch[0]).collect()}
    # INC and missing certifications drop out, a missing grade stays, repeated ids multiply
    assert set(staged) == {("a", "45.0"), ("a", "50"), ("b", "60"), ("e", "10")}
    assert staged[("b", "60")]["Final Grades"] is None
    assert staged[("a", "50")]["Previous School"] == "UNIVERSITY OF CEBU"
    bad = course(spark, [profile_row(1, "a", "x")], [("a", "1", "oops")])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        stage(bad).collect()


def test_load_and_reload(spark, store, batch):
    load(store, batch, 2324)
    once = contents(store)
    names = {name for _, name in once["groups"]}
    assert names == {"UNIVERSITY OF CEBU", "School Y", "School X", "School Q"}
    students = {r.student_key: r for r in store.read("students").collect()}
    assert set(students) == {"a", "b", "e", "f"}
    assert students["a"].course == "BSCS"  # the first course wins
    assert students["b"].group_id is None
    rows = store.read("assessments").join(
        store.read("students").select(F.col("id").alias("student_id"), "student_key"), "student_id"
    ).collect()
    # both rows of a's first batch, nothing from the second
    assert sorted((r.student_key, r.c_cert, r.grade) for r in rows if r.student_key != "b") == [
        ("a", 45, 2.5), ("a", 50, 2.0), ("e", 10, 4.0), ("f", 12, 1.0)
    ]
    assert len({r.id for r in rows}) == len(rows)

    load(store, batch, "2324")
    assert contents(store) == once
    load(store, batch, 2425)  # a stored student keeps the cohort
    again = contents(store)
    assert again["students"] == once["students"] and again["assessments"] == once["assessments"]
    assert [n for _, n in again["cohorts"]] == ["2324", "2425"]


@pytest.mark.parametrize("tag", [1999, 3001, "x", ""])
def test_bad_tags_load_nothing(store, batch, tag):
    with pytest.raises(ValueError):
        load(store, batch, tag)
    assert store.read("students").count() == 0


def test_append_rules(spark):
    students = spark.createDataFrame([(1, "a"), (2, "b")], "id long, student_key string")
    stored = spark.createDataFrame([(10, 1)], "id long, student_id long")
    batch = spark.createDataFrame(
        [(1, "a", "A"), (2, "b", "H"), (3, "b", "L"), (4, "who", "L")], "row_no int, IDNumber string, CFIT string"
    )
    added = upsert.new_assessments(batch, students, stored).collect()
    assert sorted(r.cfit for r in added) == ["H", "L"]
    assert all(r.student_id == 2 and r.attr_A is None and r.grade is None for r in added)
    assert sorted(r.id for r in added) == [11, 12]
    assert [r.cfit for r in upsert.new_assessments(batch, students, stored, dedupe=True).collect()] == ["H"]
    assert [r.student_key for r in upsert.rejected_assessments(batch, students).collect()] == ["who"]


def test_first_of_each_with_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 2990, "same").otherwise(F.col("id").cast("string")).alias("key"),
        (3000 - F.col("id")).alias("row_no"),
    )
    first = upsert.first_of_each(df, "key", ["row_no"])
    assert sorted(r.row_no for r in first.collect()) == list(range(1, 12))
    assert "partial_min_by" in first._jdf.queryExecution().toString()


def test_numeric_ids_match_stored_text(spark):
    groups = spark.createDataFrame([(1, "x")], "id long, name string")
    stored = spark.createDataFrame([(5, "17")], "id long, student_key string")
    batch = spark.createDataFrame([(1, 17, "x", "BSCS"), (2, 18, "x", "BSCS")],
                                  "row_no int, IDNumber int, `Previous School` string, Course string")
    rows = upsert.new_students(batch, stored, groups, 3).collect()
    assert [(r.id, r.student_key, r.group_id, r.cohort_id) for r in rows] == [(6, "18", 1, 3)]


def write_sheet(path, leading, rows):
    path.mkdir()
    heading = ["ID Number", "Previous School", "Course", "CFIT"]
    titles = (heading + [f"x{k}" for k in range(leading)])[:leading]
    first = ",".join(titles + ["16PF"] + [""] * 20)
    second = ",".join([""] * leading + ATTRIBUTES)
    (path / "part-0.csv").write_text("\n".join([first, second, *rows]) + "\n")


def test_profile_sheet(spark, tmp_path):
    scores = ",".join(str(k % 10 + 1) for k in range(21))
    cells = ["17,\t Univ of X ,BSCS,AA,,,", "18,,BSCS,L,,,"]
    write_sheet(tmp_path / "sheet", 7, [f"{c},{scores}" for c in cells])
    df = sheets.read_profile(spark, str(tmp_path / "sheet"))
    rows = df.orderBy("row_no").collect()
    assert [(r.IDNumber, r["Previous School"], r.CFIT) for r in rows] == [("17", "Univ of X", "AA"), ("18", None, "L")]
    assert [rows[0][a] for a in ATTR_COLS] == scores.split(",")


def test_load_from_csv_files(spark, store, tmp_path):
    """Sheets as exported: the place of a row in the file decides which one is first."""
    scores = ",".join(["4"] * 21)
    cells = ["17,Univ of X ,BSCS,AA,,,", "18,,BSCS,L,,,", "17,School Y,BSCS,H,,,"]
    write_sheet(tmp_path / "profile", 7, [f"{c},{scores}" for c in cells])
    (tmp_path / "results.csv").write_text(
        "IDNumber,C Certification,Final Grades\n17,60,2.5\n18,50,INC\n18,40,3.0\n"
    )
    sheet = CourseSheets(
        sheets.read_profile(spark, str(tmp_path / "profile")),
        sheets.read_results(spark, str(tmp_path / "results.csv")),
    )
    for _ in range(2):
        load(store, [sheet], 2324)
    groups = {r.id: r.name for r in store.read("groups").collect()}
    students = {r.student_key: groups.get(r.group_id) for r in store.read("students").collect()}
    assert students == {"17": "Univ of X", "18": None}
    rows = sorted((r.cfit, r.attr_A, r.c_cert, r.grade) for r in store.read("assessments").collect())
    assert rows == [("AA", 4, 60, 2.5), ("H", 4, 60, 2.5), ("L", 4, 40, 3.0)]


def test_score_sheet_starts_one_column_earlier(spark, tmp_path):
    scores = ",".join(["7"] * 21)
    write_sheet(tmp_path / "sheet", 6, [f"17,X,BSCS,AA,,,{scores}"])
    row = sheets.read_score_input(spark, str(tmp_path / "sheet")).first()
    assert row.attr_A == "7" and row.attr_SC == "7"


def test_missing_columns_become_null(spark):
    rows = upsert.conform(spark.createDataFrame([(1, "45.0")], "id int, c_cert string"), ASSESSMENTS)
    assert rows.schema.fieldNames() == ASSESSMENTS.fieldNames()
    assert rows.first().c_cert == 45 and rows.first().grade is None


def test_certifications(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ID No.,C Certification\n1,50\n")
    assert sheets.read_certifications(spark, str(tmp_path / "c.csv")).first().IDNumber == "1"


def test_metric_log_keeps_the_newest(spark):
    path = new_path(spark, "metrics")
    tables.log_metrics(spark, path, "one", {"accuracy": 0.5, "loss": 1.0})
    tables.log_metrics(spark, path, "two", {"accuracy": 0.75})
    rows = {r.metric: (r.run_id, r.value) for r in tables.latest_metrics(spark, path).collect()}
    assert rows == {"accuracy": ("two", 0.75), "loss": ("one", 1.0)}


def test_csv_sink(spark):
    path = new_path(spark, "out")
    tables.write_csv(spark.createDataFrame([(1, "x,y")], "a int, b string"), path)
    assert [tuple(r) for r in sheets.read_csv(spark, path).collect()] == [("1", "x,y")]


def test_students_of_a_cohort_are_read_alone(spark, store):
    rows = [(i, f"s{i}", 1, 5 + i % 2, "BSCS", 0) for i in range(1, 9)]
    store.append("students", spark.createDataFrame(rows, tables.TABLES["students"]))
    one = store.read("students").filter("cohort_id = 5")
    assert one.count() == 4
    assert "PartitionFilters: [isnotnull(cohort_id" in one._jdf.queryExecution().toString()


def test_shared_dir_is_the_checkpoint_dir(spark):
    assert new_path(spark, "x").startswith(shared_dir(spark))


def test_database_reader_wants_bounds(spark):
    with pytest.raises(ValueError):
        tables.read_database(spark, "jdbc:none", "t", {}, partition_column="id")


def test_load_leaves_no_intermediate_table(spark, store, batch):
    def written():
        root = Path(shared_dir(spark).removeprefix("file:")) / spark.sparkContext.applicationId
        return {p.name for p in root.iterdir() if p.name.startswith(("staged", "new-rows"))}

    before = written()
    load(store, batch, 2999)
    assert written() == before and store.read("students").count() == 4


def test_text_cells_come_back_as_they_were(spark):
    cells = ["  pad name \t", "", None, "l1\nl2", 'a "quoted", cell', "back\\slash", "plain"]
    path = new_path(spark, "cells")
    tables.write_csv(spark.createDataFrame(list(enumerate(cells)), "id int, cell string"), path)
    got = {int(r.id): r.cell for r in sheets.read_csv(spark, path).collect()}
    assert got == dict(enumerate(cells))


def test_files_with_other_headings_are_refused(spark):
    path = new_path(spark, "sheets")
    one = spark.createDataFrame([("1", "x")], "a string, b string").coalesce(1)
    tables.write_csv(one, f"{path}/k=1")
    tables.write_csv(one.select("b", "a"), f"{path}/k=2")
    with pytest.raises(Exception, match="header does not conform"):
        sheets.read_csv(spark, f"{path}/*").collect()


def test_wide_rows_move_once_to_get_their_ids(spark):
    """Rows that repeat id and row number all stay, with ids of their own; only keys are written on the way."""
    students = spark.createDataFrame([(7, "1", None, None, "BSCS", 0), (8, "2", None, None, "BSIT", 0)], STUDENTS)
    rows = [(1, "1", "H"), (1, "1", "H"), (1, "1", "A"), (2, "2", "L"), (3, "9", "L")]
    batch = spark.createDataFrame(rows, "row_no long, IDNumber string, CFIT string")
    stored = spark.createDataFrame([(40, 99, "H")], "id long, student_id long, cfit string")
    stored = upsert.conform(stored, ASSESSMENTS)
    written = []
    with pytest.MonkeyPatch.context() as watched:
        for module in (upsert, numbering):
            keep = module.write_once
            watched.setattr(module, "write_once", lambda df, name, keep=keep: written.append(df.columns) or keep(df, name))
        added = upsert.new_assessments(batch, students, stored)
        one = sorted((r.id, r.student_id, r.cfit) for r in added.collect())
        two = upsert.new_assessments(batch.repartition(5), students, stored).collect()
    assert [r[0] for r in one] == [41, 42, 43, 44]
    assert sorted(r[1:] for r in one) == [(7, "A"), (7, "H"), (7, "H"), (8, "L")]
    assert sorted((r.id, r.student_id, r.cfit) for r in two) == one
    assert written and all("CFIT" not in columns and "cfit" not in columns for columns in written)
