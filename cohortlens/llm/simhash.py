"""Near duplicates by SimHash, searched with Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.components import components
from cohortlens.llm.golay import fuzzy_keys
from cohortlens.llm.text import shingle_hashes
from cohortlens.sources.tables import write_once

_BLOCK = 1 << 15


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number of the bits set in over half the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _BLOCK):
        block = hashes[start : start + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int, seed: int = 42) -> Column:
    """64-bit SimHash of a text's word shingles (see ``shingle_hashes``); null counts as empty."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(t, shingle, seed)) for t in texts], dtype="int64")

    return of(text)


def differing_bits(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def _keyed(vertices: DataFrame, kept: Sequence[str]) -> DataFrame:
    """(key, kept columns): a row for every fuzzy key of the fingerprint ``mark``."""

    @F.pandas_udf("array<long>")
    def keys(marks: pd.Series) -> pd.Series:
        return pd.Series(fuzzy_keys(marks.to_numpy()), dtype=object)

    # Nothing is null; said here, it is the same in every plan, and plans can share a shuffle.
    known = " AND ".join(f"{c} IS NOT NULL" for c in kept)
    rows = vertices.filter(known).select(F.explode(keys("mark")).alias("key"), *kept)
    return rows.filter("key IS NOT NULL")


def linked(vertices: DataFrame, bits: int) -> DataFrame:
    """(node, root) of every node linked to a smaller one, over chains of links.

    ``vertices`` has one row per distinct fingerprint ``mark`` with a non-null ``node``. All
    fingerprints that share a fuzzy key are judged, inside the joins, where those that differ in
    more than ``bits`` bits leave no row; and the pairs of a group of alike nodes are not
    listed: first each node is compared with the smallest node of its key, and the groups found
    so are joined up; then only links between different groups are looked for. Distinct
    fingerprints that share a key differ in few of few bits, so a key has no part of the
    table's size; copies are one vertex. Keys are many times the rows that Spark sizes them by
    (an explode counts as one row), so the joins are told to merge and no side is broadcast.
    """
    keyed = _keyed(vertices, ["node", "mark"]).repartition("key")
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.min_by("mark", "node").alias("head_mark"))
    at_head = (
        (keyed["key"] == heads["key"])
        & (F.col("node") > F.col("head"))
        & (differing_bits(keyed["mark"], heads["head_mark"]) <= bits)
    )
    near_head = keyed.join(heads.hint("merge"), at_head).select(F.col("node").alias("a"), F.col("head").alias("b"))
    near_head = write_once(near_head.distinct(), "head-links")
    groups = components(near_head)

    grouped = vertices.join(groups.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = _keyed(write_once(grouped, "grouped"), ["node", "root", "mark"])
    left = rows.withColumnsRenamed({c: f"a_{c}" for c in rows.columns})
    right = rows.withColumnsRenamed({c: f"b_{c}" for c in rows.columns})
    across = left.join(
        right.hint("merge"),
        (F.col("a_key") == F.col("b_key"))
        & (F.col("a_root") < F.col("b_root"))
        & (differing_bits(F.col("a_mark"), F.col("b_mark")) <= bits),
    ).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return components(near_head.unionAll(across))


def classes(marks: DataFrame, bits: int, id_col: str = "doc_id") -> DataFrame:
    """``marks`` (id and fingerprint ``mark``) with ``component_id``: the smallest id reachable.

    Fingerprints are linked when they differ in ``bits`` bits at most. Equal ones are one
    vertex, however many documents share them. Rows without an id cannot be named: they take no
    part and have a null component. Each of several rows with one id is placed by its own
    fingerprint.
    """
    own = marks.filter(F.col(id_col).isNotNull())
    vertices = write_once(own.groupBy("mark").agg(F.min(id_col).cast("long").alias("node")), "vertices")
    # All of these tables have a row per fingerprint or document: written small, large on a driver.
    named = vertices.join(linked(vertices, bits).hint("merge"), "node", "left").select(
        "mark", F.coalesce("root", "node").alias("component_id")
    )
    return own.join(named.hint("merge"), "mark").select(*marks.columns, "component_id").unionByName(
        marks.filter(F.col(id_col).isNull()).withColumn("component_id", F.lit(None).cast("long"))
    )


SHINGLE, BITS = 4, 4


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS
) -> DataFrame:
    """(id, mark, component_id): fingerprint over word shingles and the smallest id linked to it.

    Fingerprints that differ in ``bits`` bits at most are linked (four at most: ``fuzzy_keys``
    promise no more), and links chain. Nothing else is compared. Null and empty texts have
    fingerprint zero and are linked like any other; a text is taken whole, however long. Each of
    several rows with one id is placed by its own text; rows without an id keep their fingerprint
    and have a null component. Other columns of ``docs`` are not read.
    """
    if bits > 4:
        raise ValueError("keys meet for four differing bits at most")
    marks = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("mark"))
    classed = classes(write_once(marks, "marks"), bits)
    return classed.select(F.col("doc_id").alias(id_col), "mark", "component_id")
