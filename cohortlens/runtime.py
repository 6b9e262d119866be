"""Session defaults and the shared folder for written intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cohortlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's checkpoint folder.

    Only a local session without one gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="cohortlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """Fresh path in this application's part of the shared folder, which can be removed when it ends."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, name: str) -> bool:
    path, files = _files(spark, name)
    return files.exists(path)


def move_whole(spark: SparkSession, fresh: str, name: str) -> None:
    """Give a folder that is written to its end its name; where another job was first, its folder stays."""
    path, files = _files(spark, fresh)
    if not path_exists(spark, name) and files.rename(path, _files(spark, name)[0]):
        return
    if not path_exists(spark, name):
        raise OSError(f"could not move {fresh} to {name}")


# Paths written inside each open scope of ``scratch``.
_scopes: list[list[str]] = []


def note_written(path: str) -> None:
    for scope in _scopes:
        scope.append(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables written inside at the end.

    For jobs that store their result: a frame that still reads such a table fails afterwards.
    """
    scope: list[str] = []
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes.remove(scope)
        for name in scope:
            path, files = _files(spark, name)
            files.delete(path, True)
