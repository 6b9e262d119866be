"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 17
ADDED = ("copy", "mix_key")
_DIGITS = 13


def poisson_steps(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until the rest is below what a 52-bit draw can tell."""
    steps, total, k = [], 0.0, 0
    while rate > 0:
        term = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        total += term
        if total >= 1 or (k > rate and term < 1e-17):
            break
        steps.append(total)
        k += 1
    return steps


def drawn(seed: int, key: Column) -> Column:
    """Number in [0, 1) with 52 random bits, from the md5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, _DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**_DIGITS))


def repetition_rates(
    docs: DataFrame, weights: Mapping[str, float], size: int | None = None, source_col: str = "source"
) -> dict[str, float]:
    """Mean repetitions of each listed source so that it gets its weight's share of ``size`` rows.

    ``size`` is the number of rows of the listed sources unless given. The counts are those of
    all rows; the driver gets one per listed source. A source without rows has no rate.
    """
    if any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError("weights must not be negative, and one must be positive")
    counted = docs.filter(F.col(source_col).isin(list(weights))).groupBy(source_col).count().collect()
    counts = {row[0]: row[1] for row in counted}
    size = sum(counts.values()) if size is None else size
    total = sum(weights.values())
    return {s: weights[s] * size / (total * n) for s, n in sorted(counts.items())}


def mix(
    docs: DataFrame,
    weights: Mapping[str, float],
    size: int | None = None,
    other_rate: float = 1.0,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Documents repeated a Poisson number of times with their source's rate as mean, shuffled.

    The number is the inverse of the Poisson distribution at a draw that is a hash of seed and
    id, so that a repeated task repeats the same rows. Each copy has its number from 1 on in
    ``copy`` and a place in a random order, ``mix_key``: rows are dealt out by it and sorted by
    it in every partition. Sources without a weight, null among them, have ``other_rate``. Rows
    that repeat an id are repeated equally often; a null id counts as the empty text. Columns
    named like the added ones are replaced.
    """
    docs = docs.drop(*ADDED)
    rates = repetition_rates(docs, weights, size, source_col)
    steps = {s: poisson_steps(r) for s, r in rates.items()}
    other = F.array(*[F.lit(v) for v in poisson_steps(other_rate)]).cast("array<double>")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    of_source = other
    if steps:
        table = F.create_map(
            *[c for s, v in steps.items() for c in (F.lit(s), F.array(*map(F.lit, v)).cast("array<double>"))]
        )
        of_source = F.coalesce(F.try_element_at(table, F.col(source_col)), other)
    draws = docs.withColumn("_u", drawn(seed, key))
    count = F.size(F.filter(of_source, lambda step: step <= F.col("_u")))
    copies = draws.withColumn("_n", count).filter("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    order = F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), F.col("copy").cast("string")))
    return (
        copies.select(*docs.columns, "copy", order.alias("mix_key"))
        .repartition("mix_key")
        .sortWithinPartitions("mix_key", "copy")
    )
