"""Threshold-scaled fingerprints of documents: every shingle hash below a fixed fraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.text import shingle_hashes

SHINGLE = 5
FRACTION = 0.25
SEED = 42


def sketch(text: str | None, shingle: int = SHINGLE, fraction: float = FRACTION) -> np.ndarray:
    """Sorted distinct shingle hashes below ``fraction`` of the hash range.

    A text with shingles but none below keeps its smallest hash, so that only texts without
    words have an empty sketch.
    """
    hashes = np.unique(shingle_hashes(text, shingle, SEED))
    kept = hashes[: np.searchsorted(hashes, np.uint64(int(fraction * 2**64)))]
    return kept if len(kept) else hashes[:1]


def merged(left: np.ndarray, right: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """Sketch of both texts' shingles together, from their sketches alone."""
    both = np.union1d(left, right)
    kept = both[: np.searchsorted(both, np.uint64(int(fraction * 2**64)))]
    return kept if len(kept) else both[:1]


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Estimated share of common shingles among the shingles of both; two empty sketches are alike."""
    if not len(left) and not len(right):
        return 1.0
    common = len(np.intersect1d(left, right, assume_unique=True))
    return common / (len(left) + len(right) - common)


def containment(left: np.ndarray, right: np.ndarray) -> float:
    """Estimated share of the left text's shingles that the right text has too, however long it is."""
    if not len(left):
        return 1.0
    return len(np.intersect1d(left, right, assume_unique=True)) / len(left)


def as_text(hashes: np.ndarray) -> str:
    """The hashes in order, 16 hex digits each."""
    return hashes.astype(">u8").tobytes().hex()


def from_text(value: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(value), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``fingerprint``; null and empty texts have an empty one."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([as_text(sketch(t)) for t in texts], dtype=object)

    return docs.withColumn("fingerprint", of(F.col(text_col)))


def edited(text: str, following: str) -> str:
    """The last half of the characters (rounded down) replaced by the first of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FOLLOWED = (
    "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, contained_in_edited double"
)
_ROWS = 512


def _compared(doc: int, text: str, own: np.ndarray, following: str, next_sketch: np.ndarray) -> tuple:
    changed = edited(text, following)
    mark = sketch(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    near = likeness(own, mark), likeness(own, next_sketch), containment(own, mark)
    return doc, len(text), digest, as_text(own), as_text(mark), *near


def _compare(rows: Iterable[tuple[int, int, str, bool]]) -> Iterator[tuple]:
    """Each own row (range, id, text, lent) in order against the row after it in its range."""
    before = None
    for part, doc, text, lent in rows:
        now = sketch(text)
        if before is not None and before[0] == part:
            yield _compared(*before[1:], text, now)
        before = None if lent else (part, doc, text, now)


def _compare_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = _compare(row for batch in batches for row in batch.itertuples(index=False, name=None))
    names = [field.split()[0] for field in FOLLOWED.split(", ")]
    while block := list(islice(rows, _ROWS)):
        yield pd.DataFrame(block, columns=names)


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    Documents are dealt into ranges of ids and read in order; the first document of a range is
    lent to the range before it (that of the first range to the last one), so that every
    document meets its next one and a text moves once. The bounds of the ranges and their first
    ids are all the driver sees: four per shuffle partition. Rows without an id have no place in
    the order and come out with nulls for all that needs a next document. Rows that repeat an
    id follow each other by text. A single document is followed by itself; a null text is empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    named = rows.filter(F.col("id").isNotNull())
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = named.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 10_000)).first()[0]
    bounds = np.unique(np.array(cuts or [0], np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy()).astype(np.int32))

    firsts = named.groupBy(range_of("id").alias("part")).agg(F.min("id").alias("first")).orderBy("first").collect()
    parts = np.array([r["part"] for r in firsts], np.int32)
    first_ids = np.array([r["first"] for r in firsts], np.int64)

    @F.pandas_udf("array<struct<part: int, lent: boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        """A row's own range and, for the first of a range, the range before it."""
        out = []
        for doc in ids.to_numpy():
            at = int(np.searchsorted(first_ids, doc, side="right")) - 1
            own = [{"part": int(parts[at]), "lent": False}]
            out.append(own + [{"part": int(parts[at - 1]), "lent": True}] if first_ids[at] == doc else own)
        return pd.Series(out, dtype=object)

    dealt = (
        named.select("id", "text", F.explode(places("id")).alias("at"))
        .select("at.part", "id", "text", "at.lent")
        .repartition("part")
        .sortWithinPartitions("part", "lent", "id", "text")
    )
    compared = dealt.mapInPandas(_compare_batches, FOLLOWED)
    unnamed = fingerprints(rows.filter(F.col("id").isNull())).select(
        "id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint"
    )
    return compared.unionByName(unnamed, allowMissingColumns=True).withColumnRenamed("id", id_col)
