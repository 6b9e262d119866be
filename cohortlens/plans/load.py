"""The load: sheets to star tables, safe to repeat."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.joins import merge_on_id
from cohortlens.operators.upsert import check_tag, new_assessments, new_groups, new_students
from cohortlens.runtime import scratch
from cohortlens.sources.sheets import clean_profile, clean_results
from cohortlens.sources.commits import CommittedStore, batch_digest
from cohortlens.sources.tables import TableStore, write_once


@dataclass
class CourseSheets:
    """Profile and results of one course, as the readers return them."""

    profile: DataFrame
    results: DataFrame


def stage(sheets: CourseSheets) -> DataFrame:
    """Cleaned profiles joined with cleaned results."""
    return merge_on_id(clean_profile(sheets.profile), clean_results(sheets.results), "IDNumber")


def cohort_id(store: TableStore, tag: int) -> int:
    """Id of a registered cohort; an unknown one is registered."""
    cohorts = store.read("cohorts")
    found = cohorts.filter(F.col("name") == str(tag)).select("id").take(1)
    if found:
        return found[0].id
    new_id = cohorts.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    store.append("cohorts", store.spark.createDataFrame([(new_id, str(tag))], cohorts.schema))
    return new_id


def load_batches(store: TableStore, batches: Sequence[DataFrame], tag: int) -> None:
    """Append what is new: groups, then students, then assessments.

    The batches go in one after the other, so an id in two of them belongs to the first.
    A repeated or interrupted load adds nothing twice: every step leaves out what is stored.
    """
    for batch in batches:
        store.append("groups", new_groups(batch, store.read("groups")))
    cohort = cohort_id(store, tag)
    for batch in batches:
        store.append("students", new_students(batch, store.read("students"), store.read("groups"), cohort))
    for batch in batches:
        store.append(
            "assessments", new_assessments(batch, store.read("students"), store.read("assessments"))
        )


def load(store: TableStore, courses: Sequence[CourseSheets], tag: int | str) -> None:
    """Load the sheets of all courses under one cohort tag."""
    checked = check_tag(tag)
    with scratch(store.spark):
        load_batches(store, [write_once(stage(c), "staged") for c in courses], checked)


def commit_batches(store: CommittedStore, batches: Sequence[DataFrame], tag: int, attempts: int = 10) -> bool:
    """Add what is new in all three tables at once; False where these batches are listed already.

    Ids are counted from the version that was read, and only one job can follow a version: a job
    that comes second reads again and gives its rows new ids. Rows of a job that ended before
    its commit are in no list and are not read.
    """
    digest = batch_digest(list(batches), tag)
    for _ in range(attempts):
        attempt = store.attempt()
        if store.holds(digest):
            return False
        load_batches(attempt, batches, tag)
        if attempt.commit(digest):
            return True
    raise RuntimeError(f"other jobs were first {attempts} times")


def load_committed(store: CommittedStore, courses: Sequence[CourseSheets], tag: int | str) -> bool:
    """As ``load``, safe beside other jobs; tells whether this call stored the sheets."""
    checked = check_tag(tag)
    with scratch(store.spark):
        return commit_batches(store, [write_once(stage(c), "staged") for c in courses], checked)
