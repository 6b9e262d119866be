"""Score, label and encoding expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.schema import BAND_SCALE, CERT_MAX, GRADE_MAX, LABEL_CUTS


def ordinal_band(band: Column, default: int | None = None) -> Column:
    """Band on the 2..10 scale; ``default`` for M, unknown and NULL."""
    out = None
    for name, value in BAND_SCALE.items():
        out = F.when(band == name, value) if out is None else out.when(band == name, value)
    return out.otherwise(F.lit(default).cast("int"))


def indicator(col: Column, value: str) -> Column:
    """1 where the column equals the value, else 0 (also for NULL)."""
    return F.when(col == value, 1).otherwise(0)


def discretize(weight: Column, cuts: tuple[float, float] = LABEL_CUTS, top: float = 100) -> Column:
    """Label 0, 1, 2 by two cuts; NULL above ``top`` and for NULL."""
    low, high = cuts
    return F.when(weight < low, 0).when(weight < high, 1).when(weight <= top, 2)


def grade_span(grade: Column) -> Column:
    """Grade 1..5 on 0..100."""
    return (grade - 1) / 4 * 100


def grade_share(grade: Column) -> Column:
    """Grade as a percentage of the best grade."""
    return grade / GRADE_MAX * 100


def grade_blend(grade: Column, cert: Column) -> Column:
    """70 points for the grade and 30 for the certification."""
    return grade / GRADE_MAX * 70 + cert / CERT_MAX * 30


def composite_score(grade: Column, cert: Column) -> Column:
    """Half grade, half certification, rounded to 2; NULL if either is NULL."""
    half = F.lit(0.5)
    return F.round(half * (grade / GRADE_MAX) + half * (cert / CERT_MAX), 2)


def round_binary(col: Column, digits: int = 2) -> Column:
    """Round the scaled double to the nearest whole number, ties to even, as data frames in
    memory do. ``round`` goes by the decimal digits instead: 4.515 becomes 4.52 there, 4.51 here.
    """
    return F.rint(col * 10**digits) / 10**digits


def percent_difference(value: Column, base: Column) -> Column:
    """Difference from ``base`` in percent; NULL for a NULL or zero base."""
    return F.try_divide(value - base, base) * 100


def padded_square(diff: Column, padding: float) -> Column:
    """Square of a difference moved away from zero by ``padding``, sign kept."""
    padded = diff + F.lit(padding) * F.signum(diff)
    return F.signum(padded) * F.pow(padded, F.lit(2.0))


# Verdict cut-offs and texts, in the order they are tried.
HIGH_CONFIDENCE = 0.6
MEDIUM_CONFIDENCE = 0.3
VERDICT_OUTCOMES = ["Failure", "Excellence", "Passing"]
CLOSE_CALL = "No Clear Dominant Outcome - Close Call"


def verdict(probability: Column) -> Column:
    """Text verdict for an array of the probabilities of fail, pass, excel.

    The order of the outcomes decides before the size of their probabilities:
    anything over a cut-off wins against larger ones that come later.
    """
    value = {"Failure": probability[0], "Passing": probability[1], "Excellence": probability[2]}

    def largest(name: str) -> Column:
        return reduce(
            lambda a, b: a & b, [value[name] > value[other] for other in value if other != name]
        )

    tests = [
        ("High", lambda n: value[n] > HIGH_CONFIDENCE),
        ("Medium", lambda n: value[n] > MEDIUM_CONFIDENCE),
        ("Low", largest),
    ]
    out = F
    for level, test in tests:
        for name in VERDICT_OUTCOMES:
            out = out.when(test(name), f"{level} Confidence in {name}")
    return out.otherwise(CLOSE_CALL)
