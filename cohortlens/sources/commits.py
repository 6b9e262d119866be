"""Star tables whose batches count once they are listed in a log, all tables of a batch at once."""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.runtime import path_exists
from cohortlens.sources.tables import PARTITIONED_BY, TABLES, TableStore

ENTRY = "version long, batch string, folders map<string, array<string>>"


def batch_digest(batches: list[DataFrame], tag: int, apart_from: tuple[str, ...] = ("row_no",)) -> str:
    """Digest of the rows of all batches and the tag, whatever order the rows come in."""
    parts = [str(tag)]
    for batch in batches:
        columns = sorted(c for c in batch.columns if c not in apart_from)
        text = [F.col(f"`{c}`").cast("string") for c in columns]
        # NULLs are skipped by the hash, so their places are hashed as well.
        places = F.concat(*[c.isNull().cast("int").cast("string") for c in text])
        hashes = [F.xxhash64(F.lit(seed), places, *text).cast("decimal(38,0)") for seed in (1, 2)]
        sums = batch.agg(F.count(F.lit(1)), *[F.sum(h) for h in hashes]).first()
        parts.append(f"{columns} {[str(x) for x in sums]}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


class CommittedStore(TableStore):
    """Reads what the log lists; rows are added by an ``attempt`` and its commit.

    Entry n of the log is a small file that can be made once: it is renamed to its name, which
    fails where the name is taken. That is as safe as a rename of the file system is; HDFS does
    it in one step, an object store needs a file system layer that does. The log has an entry
    per batch and is read by the driver.
    """

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self.log = f"{root}/commits"

    def entries(self) -> list:
        if not path_exists(self.spark, self.log):
            return []
        return self.spark.read.schema(ENTRY).json(self.log).orderBy("version").collect()

    def holds(self, batch: str) -> bool:
        return any(e.batch == batch for e in self.entries())

    def attempt(self) -> Attempt:
        """A view of the tables as listed now, to which rows can be added."""
        return Attempt(self, self.entries())

    def read(self, name: str) -> DataFrame:
        return self.attempt().read(name)

    def append(self, name: str, rows: DataFrame) -> None:
        raise TypeError("rows are added by an attempt and its commit")


class Attempt(TableStore):
    """The tables of one version and the rows added since, which nobody else sees before the commit."""

    def __init__(self, store: CommittedStore, entries: list):
        super().__init__(store.spark, store.root)
        self.log = store.log
        self.version = len(entries)
        self.listed = {name: [f for e in entries for f in e.folders.get(name, [])] for name in TABLES}
        self.added: dict[str, list[str]] = {name: [] for name in TABLES}

    def read(self, name: str) -> DataFrame:
        folders = self.listed[name] + self.added[name]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        base = f"{self.root}/{name}"
        rows = self.spark.read.schema(TABLES[name]).option("basePath", base)
        return rows.parquet(*[f"{base}/{f}" for f in folders]).select(*TABLES[name].fieldNames())

    def append(self, name: str, rows: DataFrame) -> None:
        folder = f"batch={uuid.uuid4().hex}"
        rows.write.partitionBy(*PARTITIONED_BY.get(name, [])).parquet(f"{self.root}/{name}/{folder}")
        self.added[name].append(folder)

    def commit(self, batch: str) -> bool:
        """List the added rows as the next entry; False where another job made that entry first."""
        entry = {"version": self.version, "batch": batch, "folders": self.added}
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        fresh = hadoop.Path(f"{self.log}/.new-{uuid.uuid4().hex}")
        path = hadoop.Path(f"{self.log}/{self.version:020d}.json")
        files = path.getFileSystem(conf)
        out = files.create(fresh)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        rename = getattr(hadoop, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        try:
            hadoop.FileContext.getFileContext(files.getUri(), conf).rename(fresh, path, never_over)
        except Py4JJavaError:
            files.delete(fresh, False)
            if not files.exists(path):
                raise
            return False
        return True
