from pathlib import Path

import pytest
from test_load import batch, contents, course, profile_row  # noqa: F401

from cohortlens.plans import load as load_plan
from cohortlens.runtime import new_path
from cohortlens.sources import tables
from cohortlens.sources.commits import CommittedStore, batch_digest
from cohortlens.streaming.load import arriving, load_stream


@pytest.fixture
def committed(spark):
    return CommittedStore(spark, new_path(spark, "committed"))


@pytest.fixture
def other(spark):
    rows = [profile_row(1, "x", "School X"), profile_row(2, "y", "School New"), profile_row(3, "a", "School Y")]
    return [course(spark, rows, [("x", "1", "1.0"), ("y", "2", "2.0"), ("a", "3", "3.0")])]


def unique(store):
    return all(
        store.read(name).select("id").distinct().count() == store.read(name).count()
        for name in ("groups", "cohorts", "students", "assessments")
    )


def test_same_tables_as_the_plain_load(spark, committed, batch):  # noqa: F811
    plain = tables.TableStore(spark, new_path(spark, "plain"))
    assert contents(committed) == contents(plain)
    load_plan.load(plain, batch, 2000)
    assert load_plan.load_committed(committed, batch, 2000)
    assert contents(committed) == contents(plain)
    assert not load_plan.load_committed(committed, batch, 2000)
    assert contents(committed) == contents(plain)


def test_a_job_that_dies_leaves_nothing_and_is_run_again(spark, committed, batch, monkeypatch):  # noqa: F811
    plain = tables.TableStore(spark, new_path(spark, "plain"))
    load_plan.load(plain, batch, 2000)

    def dies(*_):
        raise OSError("killed between the appends")

    with monkeypatch.context() as broken:
        broken.setattr(load_plan, "new_assessments", dies)
        with pytest.raises(OSError):
            load_plan.load_committed(committed, batch, 2000)
    assert (Path(committed.root.removeprefix("file:")) / "students").exists()
    assert all(not rows for rows in contents(committed).values())
    assert load_plan.load_committed(committed, batch, 2000)
    assert contents(committed) == contents(plain)


def test_two_jobs_with_one_batch_leave_it_once(committed, batch):  # noqa: F811
    staged = [load_plan.stage(c) for c in batch]
    digest = batch_digest(staged, 2000)
    first, second = committed.attempt(), committed.attempt()
    load_plan.load_batches(first, staged, 2000)
    load_plan.load_batches(second, staged, 2000)
    assert first.commit(digest) and not second.commit(digest)
    before = contents(committed)
    assert not load_plan.commit_batches(committed, staged, 2000)
    assert contents(committed) == before and unique(committed)
    assert sorted(p.name for p in Path(committed.log.removeprefix("file:")).glob("*.json")) == [f"{0:020d}.json"]


def test_ids_of_interleaved_jobs_are_unique(committed, batch, other, monkeypatch):  # noqa: F811
    add = load_plan.load_batches
    came_between = []

    def slow(store, batches, tag):
        add(store, batches, tag)
        if not came_between:
            came_between.append(1)
            assert load_plan.load_committed(committed, other, 2001)

    monkeypatch.setattr(load_plan, "load_batches", slow)
    assert load_plan.load_committed(committed, batch, 2000)
    assert len(committed.entries()) == 2 and unique(committed)
    students = {r.student_key: r.cohort_id for r in committed.read("students").collect()}
    cohorts = {r.id: r.name for r in committed.read("cohorts").collect()}
    # The other job was first, so a belongs to it.
    assert {k: cohorts[v] for k, v in students.items()} == {
        "x": "2001", "y": "2001", "a": "2001", "b": "2000", "e": "2000", "f": "2000"
    }


def test_it_gives_up_when_others_are_always_first(committed, batch, monkeypatch):  # noqa: F811
    monkeypatch.setattr("cohortlens.sources.commits.Attempt.commit", lambda *_: False)
    staged = [load_plan.stage(c) for c in batch]
    with pytest.raises(RuntimeError, match="other jobs"):
        load_plan.commit_batches(committed, staged, 2000, attempts=2)


def test_digest_is_of_rows_not_of_their_order(spark):
    rows = [(1, "a", None), (2, None, "a"), (3, "b", "c")]
    schema = "row_no int, x string, y string"
    one = spark.createDataFrame(rows, schema)
    turned = spark.createDataFrame([(9 - n, x, y) for n, x, y in rows[::-1]], schema)
    assert batch_digest([one], 1) == batch_digest([turned], 1)
    swapped = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "b", "c")], schema)
    repeated = one.unionByName(one.filter("row_no = 3"))
    digests = {batch_digest([f], t) for f, t in [(one, 1), (one, 2), (swapped, 1), (repeated, 1), (one.limit(0), 1)]}
    assert len(digests) == 5


def test_replayed_stream_batch_is_listed_once(spark, committed, batch):  # noqa: F811
    path = new_path(spark, "arriving")
    load_plan.stage(batch[0]).write.parquet(path)
    schema = spark.read.parquet(path).schema
    for _ in range(2):  # a lost progress folder replays everything
        load_stream(arriving(spark, path, schema), committed, 2000, new_path(spark, "progress")).awaitTermination()
    assert len(committed.entries()) == 1 and unique(committed)


def test_rows_are_added_by_an_attempt_only(spark, committed):
    with pytest.raises(TypeError):
        committed.append("groups", spark.createDataFrame([(1, "x")], tables.TABLES["groups"]))
