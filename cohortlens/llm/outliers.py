"""Quality rules: base rules, then robust multivariate outliers. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.text import UPPER, WHITESPACE
from cohortlens.sources.tables import write_once

SYMBOLS = "#*$%&|<>"
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*BASE, "n_lines", "n_upper", "base_failed")

# The transformed statistics, in thousandths, and the least spread each is given.
UNIT = 1000
FLOORS = {"x_length": 60, "x_symbols": 40, "x_lines": 80, "x_repeats": 80, "x_upper": 60}
DIMS = tuple(FLOORS)
# Words (lines) that every text is imagined to have besides its own, with usual figures.
USUAL_WORDS, USUAL_LINES, USUAL_LENGTH = 50, 5, 5.0

SUBSET = 0.75
STEPS = 4
MIN_GROUP = 50
TAIL = 1e-6


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, the base figures of a text (long) and ``base_failed``.

    Columns of those names are replaced. A null text has no words; all its figures are 0.
    """
    # The document's columns travel in one struct, apart from the names used on the way.
    own = docs.select(F.struct(*docs.drop(*ADDED).columns).alias("_doc"), F.coalesce(text_col, F.lit("")).alias("_text"))
    text = F.col("_text")
    stripped = F.btrim(text, F.lit(WHITESPACE))
    words = F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, r"[ \t\n\x0b\x0c\r]+")
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITESPACE)) != "")
    dense = F.translate(text, WHITESPACE, "")
    parts = own.withColumns({"_words": words, "_lines": lines, "_dense": dense})
    hashes = F.when(
        F.size("_words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<long>"))
    counted = parts.withColumn("_windows", hashes).withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length("_dense").cast("long"),
        "n_symbols": (F.char_length("_dense") - F.char_length(F.translate("_dense", SYMBOLS, ""))).cast("long"),
        "n_upper": (F.char_length("_dense") - F.char_length(F.translate("_dense", UPPER, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    # Only texts with a window twice need to know where.
    found = counted.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    twice = F.filter(
        "_sorted",
        lambda x, k: (x["h"] == F.get(F.col("_sorted"), k - 1)["h"]) | (x["h"] == F.get(F.col("_sorted"), k + 1)["h"]),
    )
    placed = found.withColumn("_twice", F.array_sort(F.transform(twice, lambda x: x["i"])))
    gaps = F.zip_with(
        "_twice",
        F.expr("slice(_twice, 2, size(_twice))"),
        lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
    )
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap), F.lit(0)).cast("long")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        placed.withColumn("n_repeat_words", covered)
        .withColumn("base_failed", failed)
        .select("_doc.*", *ADDED)
    )


def with_vector(measured: DataFrame) -> DataFrame:
    """The statistics vector in whole thousandths, so that sums of it are exact in any order.

    Shares are taken over a few more words or lines than the text has, which steadies short texts.
    """
    words = F.col("n_words") + USUAL_WORDS
    chars = F.col("word_chars") + USUAL_LENGTH * USUAL_WORDS
    values = {
        "x_length": F.log(chars / words),
        "x_symbols": F.log(1 + F.col("n_symbols") / words),
        "x_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + USUAL_LINES)),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / words),
        "x_upper": F.sqrt(F.col("n_upper") / chars),
    }
    return measured.withColumns({name: F.round(UNIT * v).cast("long") for name, v in values.items()})


def chi_square_share(value: float, dims: int) -> float:
    """Probability that a chi-square variable of ``dims`` degrees stays below ``value``."""
    half, term, total, k = dims / 2, 1.0, 1.0, 0
    if value <= 0:
        return 0.0
    while term > total * 1e-17:
        k += 1
        term *= value / 2 / (half + k)
        total += term
    return min(1.0, total * math.exp(half * math.log(value / 2) - value / 2 - math.lgamma(half + 1)))


def chi_square_cut(share: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_share(mid, dims) < share else (low, mid)
    return high


def _attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; ``facts`` has a row per group."""
    facts = facts.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(facts[f"_g_{k}"]) for k in keys])
    return rows.join(facts, same, how).drop(*[f"_g_{k}" for k in keys])


def _moments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, and lower triangle of the covariance with the floors added, per group."""
    sums = {f"s_{a}": F.sum(a) for a in DIMS}
    products = {f"p_{a}_{b}": F.sum(F.col(a) * F.col(b)) for i, a in enumerate(DIMS) for b in DIMS[: i + 1]}
    total = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in (sums | products).items()]
    )
    means = total.withColumns({f"m_{a}": F.col(f"s_{a}") / F.col("n") for a in DIMS})
    spread = {}
    for i, a in enumerate(DIMS):
        for b in DIMS[: i + 1]:
            value = F.col(f"p_{a}_{b}") / F.col("n") - F.col(f"m_{a}") * F.col(f"m_{b}")
            spread[f"c_{a}_{b}"] = value + F.lit(float(FLOORS[a] ** 2)) if a == b else value
    return means.withColumns(spread)


def _factored(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means and Cholesky factor (columns l_a_b), and the log of the determinant, per group."""
    table = moments
    for j, b in enumerate(DIMS):
        done = [F.col(f"l_{b}_{c}") for c in DIMS[:j]]
        rest = reduce(lambda x, y: x - y * y, done, F.col(f"c_{b}_{b}"))
        table = table.withColumn(f"l_{b}_{b}", F.sqrt(F.greatest(rest, F.lit(1.0))))
        below = {}
        for a in DIMS[j + 1 :]:
            value = reduce(lambda x, c: x - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}"), DIMS[:j], F.col(f"c_{a}_{b}"))
            below[f"l_{a}_{b}"] = value / F.col(f"l_{b}_{b}")
        if below:
            table = table.withColumns(below)
    logs = reduce(lambda x, y: x + y, [F.log(f"l_{a}_{a}") for a in DIMS])
    factor = [f"l_{a}_{b}" for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]
    return table.select(*keys, *[f"m_{a}" for a in DIMS], *factor, (2 * logs).alias("log_det"))


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` of rows that carry their group's mean and factor."""
    for i, a in enumerate(DIMS):
        value = reduce(
            lambda x, b: x - F.col(f"l_{a}_{b}") * F.col(f"y_{b}"), DIMS[:i], F.col(a) - F.col(f"m_{a}")
        )
        rows = rows.withColumn(f"y_{a}", value / F.col(f"l_{a}_{a}"))
    return rows.withColumn("d2", reduce(lambda x, y: x + y, [F.col(f"y_{a}") * F.col(f"y_{a}") for a in DIMS]))


def _grade(d2: Column) -> Column:
    """Distance in fine steps of its logarithm: a whole number with a few thousand values."""
    return F.floor(256 * F.log2(1 + d2)).cast("int")


def _nearest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows among the nearest ``SUBSET`` of their group by ``grade``; those tied at the edge too."""
    cut = rows.groupBy(*keys).agg(F.percentile("grade", F.lit(SUBSET)).alias("cut"))
    return _attach(rows, write_once(cut, "cut"), keys).filter(F.col("grade") <= F.col("cut"))


def determinant_estimates(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and Cholesky factor per group of the subset whose covariance is smallest.

    Two fixed starts per group, the rows nearest its medians in the sum and in the largest of
    the scaled deviations; from each, concentration steps: estimate on the subset, take the
    ``SUBSET`` nearest by that estimate, again. The start that ends with the smaller
    determinant counts. Every step is a partial aggregate per group, so a group with a third
    of all rows costs no task more than others; the tables of groups are written in between.
    The covariance is scaled to be right for normal data.
    """
    middle = vectors.groupBy(*keys).agg(
        *[F.percentile(a, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"q_{a}") for a in DIMS]
    )
    placed = _attach(vectors, write_once(middle, "medians"), keys)
    parts = []
    for a, floor in FLOORS.items():
        low, median, high = (F.col(f"q_{a}")[k] for k in range(3))
        z = (F.col(a) - median) / F.greatest((high - low) / 1.349, F.lit(float(floor)))
        parts.append(z * z)
    starts = F.array(
        F.struct(F.lit(0).alias("start"), _grade(reduce(lambda x, y: x + y, parts)).alias("grade")),
        F.struct(F.lit(1).alias("start"), _grade(F.greatest(*parts)).alias("grade")),
    )
    own = [*keys, "start"]
    rows = placed.select(*keys, *DIMS, F.explode(starts).alias("s")).select(*keys, *DIMS, "s.start", "s.grade")
    both = vectors.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for step in range(STEPS):
        estimate = write_once(_factored(_moments(_nearest(rows, own), own), own), "estimate")
        if step + 1 < STEPS:
            rows = _distance(_attach(both, estimate, own)).select(*own, *DIMS, _grade(F.col("d2")).alias("grade"))
    best = estimate.groupBy(*keys).agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    scale = math.sqrt(SUBSET / chi_square_share(chi_square_cut(SUBSET, len(DIMS)), len(DIMS) + 2))
    factor = {f"l_{a}_{b}": F.col(f"l_{a}_{b}") * scale for i, a in enumerate(DIMS) for b in DIMS[: i + 1]}
    chosen = _attach(estimate, best.withColumnRenamed("start", "best"), keys).filter(F.col("start") == F.col("best"))
    return chosen.withColumns(factor).drop("start", "best", "log_det")


def judged(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """The columns of ``docs`` (without the text if not wanted), the base figures, ``base_failed``, ``distance`` and ``kept``.

    Groups are languages and sources (null is one of each); a language's sources with fewer
    than ``MIN_GROUP`` documents that pass the base rules are one group, and where that is too
    small as well the base rules decide. Estimates are made on the documents that pass. A
    document is rejected when its squared distance would be exceeded by a share ``TAIL`` of
    normal data. Columns named like the added ones are replaced; the table is written once
    with its figures, so that a text is read once.
    """
    added = (*BASE, "base_failed", "distance", "kept")
    wanted = [c for c in docs.columns if c not in added and (keep_text or c != text_col)]
    rows = docs.select(
        F.struct(*wanted).alias("_doc"),
        F.col(lang_col).alias("_lang"),
        F.col(source_col).alias("_source"),
        F.col(text_col).alias("_judged"),
    )
    measured = write_once(with_vector(with_base(rows, "_judged").drop("_judged")), "measured")
    passed = measured.filter(~F.col("base_failed"))
    large = (
        passed.groupBy("_lang", "_source").agg((F.count(F.lit(1)) >= MIN_GROUP).alias("large"))
    )
    large = write_once(large, "groups")

    def grouped(rows: DataFrame) -> DataFrame:
        told = _attach(rows, large, ["_lang", "_source"], "left")
        own = F.coalesce("large", F.lit(False))
        return told.withColumns({"own": own, "of": F.when(own, F.col("_source"))}).drop("large")

    keys = ["_lang", "own", "of"]
    vectors = grouped(passed.select("_lang", "_source", *DIMS)).select(*keys, *DIMS)
    enough = vectors.groupBy(*keys).count().filter(F.col("count") >= MIN_GROUP).drop("count")
    vectors = write_once(_attach(vectors, write_once(enough, "enough"), keys), "vectors")
    estimates = write_once(determinant_estimates(vectors, keys), "estimates")
    rows = _distance(_attach(grouped(measured), estimates, keys, "left"))
    distance = F.sqrt("d2")
    cut = math.sqrt(chi_square_cut(1 - TAIL, len(DIMS)))
    kept = ~F.col("base_failed") & F.coalesce(distance <= cut, F.lit(True))
    return rows.withColumns({"distance": distance, "kept": kept}).select("_doc.*", *added)
