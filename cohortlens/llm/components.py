"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.sources.tables import write_once

# Links up to which Spark may broadcast a side. Files of links are small for their rows, by which Spark would size them.
BROADCAST_LINKS = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _sized(rows: DataFrame, links: int) -> DataFrame:
    """A side of a join that is not broadcast when it comes from many links."""
    return rows.hint("merge") if links > BROADCAST_LINKS else rows


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("hi", "lo").unionAll(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
    joined = both.join(_sized(least, links), "hi")
    return joined.filter(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = edges.join(_sized(least, links), "hi")
    moved = joined.filter(F.col("lo") > F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of a link that is not its own root; root is the smallest node.

    Alternates large and small stars until the links no longer change. Links with a null end
    or with equal ends say nothing. Each round is written to the shared folder, so that no
    lineage builds up and a lost executor costs one round at most. Nodes with many links are
    reduced by partial aggregates; the joins can be split by adaptive execution.
    """
    a, b = F.col(left), F.col(right)
    edges = links.filter(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges = write_once(edges, "links")
    state = _state(edges)
    while state[0]:
        edges = write_once(_small_star(_large_star(edges, state[0]), state[0]), "links")
        state, before = _state(edges), state
        if state == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
