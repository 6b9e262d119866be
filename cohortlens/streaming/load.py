"""The load over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from cohortlens.operators.upsert import check_tag
from cohortlens.plans.load import commit_batches, load_batches
from cohortlens.runtime import scratch
from cohortlens.sources.commits import CommittedStore
from cohortlens.sources.tables import TableStore, write_once


def arriving(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Staged batches as they appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def load_stream(staged: DataFrame, store: TableStore, tag: int | str, progress: str) -> StreamingQuery:
    """Load every new staged batch, then stop.

    A batch that is replayed after a failure adds nothing twice, as in the batch load.
    """
    checked = check_tag(tag)
    store_batches = commit_batches if isinstance(store, CommittedStore) else load_batches

    def add(batch: DataFrame, _: int) -> None:
        with scratch(store.spark):
            store_batches(store, [write_once(batch, "arrived")], checked)

    return (
        staged.writeStream.foreachBatch(add)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
