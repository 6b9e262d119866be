import pytest
from pyspark.sql import functions as F

from cohortlens.functions import scores as sc
from cohortlens.functions import text as tx


def values(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_strip_and_canonical_names(spark):
    names = [
        " \t University of Cebu - Main \n",
        "univ-ty of san carlos talamban",
        "UNIVERSITY OF SAN JOSE - Recoletos",
        "The University of Cebu",
        " Cebu ",
        None,
    ]
    got = values(spark, [(n,) for n in names], "n string", tx.canonical_name(tx.strip(F.col("n"))))
    assert [g[0] for g in got] == [
        "UNIVERSITY OF CEBU",
        "UNIVERSITY OF SAN CARLOS",
        "UNIVERSITY OF SAN JOSE RECOLETOS",
        "The University of Cebu",
        "Cebu",
        None,
    ]


def test_name_rules_apply_in_order(spark):
    got = values(spark, [("University of Cebu, University of San Carlos",)], "n string",
                 tx.canonical_name(F.col("n")))
    assert got == [("UNIVERSITY OF CEBU",)]


@pytest.mark.parametrize(
    "cuts, expected",
    [
        ((50, 88), [0, 0, 0, 1, 1, 2, 2, None, None]),
        ((50, 95), [0, 0, 0, 1, 1, 1, 2, None, None]),
    ],
)
def test_label_edges(spark, cuts, expected):
    weights = [-1.0, 0.0, 49.99, 50.0, 87.99, 88.0, 100.0, 100.01, None]
    got = values(spark, [(w,) for w in weights], "w double", sc.discretize(F.col("w"), cuts))
    assert [g[0] for g in got] == expected


def test_band_policies(spark):
    bands = [("L",), ("BA",), ("A",), ("AA",), ("H",), ("M",), ("x",), (None,)]
    got = values(spark, bands, "b string", sc.ordinal_band(F.col("b")), sc.ordinal_band(F.col("b"), 0))
    assert got == [(2, 2), (4, 4), (6, 6), (8, 8), (10, 10), (None, 0), (None, 0), (None, 0)]


def test_indicator_of_null_is_zero(spark):
    got = values(spark, [("BSCS",), ("BSIT",), (None,)], "c string", sc.indicator(F.col("c"), "BSCS"))
    assert got == [(1,), (0,), (0,)]


def test_grades_and_composite(spark):
    rows = [(1.0, 0), (5.0, 80), (3.0, 40), (None, 40), (3.0, None)]
    g, c = F.col("g"), F.col("c")
    got = values(spark, rows, "g double, c int", sc.grade_span(g), sc.grade_share(g),
                 sc.grade_blend(g, c), sc.composite_score(g, c))
    assert got[0] == (0.0, 20.0, 14.0, 0.1)
    assert got[1] == (100.0, 100.0, 100.0, 1.0)
    assert got[2] == (50.0, 60.0, pytest.approx(57.0), 0.55)
    assert got[3][3] is None and got[4][3] is None


def test_percent_difference_without_base(spark):
    rows = [(3.0, 2.0), (3.0, 0.0), (None, 2.0), (3.0, None)]
    got = values(spark, rows, "x double, y double", sc.percent_difference(F.col("x"), F.col("y")))
    assert [g[0] for g in got] == [50.0, None, None, None]


def test_padded_square(spark):
    got = values(spark, [(0.0,), (0.4,), (-0.4,)], "d double", sc.padded_square(F.col("d"), 0.1))
    assert [g[0] for g in got] == [0.0, pytest.approx(0.25), pytest.approx(-0.25)]


def test_round_binary_differs_from_decimal(spark):
    got = values(spark, [(90.3 * 5 / 100,), (2.5,)], "x double",
                 sc.round_binary(F.col("x")), F.round("x", 2), sc.round_binary(F.col("x"), 0))
    assert got[0][:2] == (4.51, 4.52)
    assert got[1][2] == 2.0


def test_percent_text(spark):
    got = values(spark, [(0.12346,), (1.0,), (0.0,), (0.28375,)], "p double", tx.percent_text(F.col("p")))
    assert [g[0] for g in got] == ["12.35%", "100.0%", "0.0%", "28.38%"]


def plain_verdict(p):
    fail, passing, excel = p
    order = [("Failure", fail), ("Excellence", excel), ("Passing", passing)]
    for level, cut in (("High", 0.6), ("Medium", 0.3)):
        for name, value in order:
            if value > cut:
                return f"{level} Confidence in {name}"
    for name, value in order:
        if all(value > other for n, other in order if n != name):
            return f"Low Confidence in {name}"
    return "No Clear Dominant Outcome - Close Call"


def test_verdict_over_a_grid(spark):
    steps = [0.0, 0.1, 0.2, 0.3, 0.31, 0.39, 0.6, 0.61, 1.0]
    grid = [[a, b, c] for a in steps for b in steps for c in steps]
    frame = spark.createDataFrame([(p,) for p in grid], "p array<double>")
    for row in frame.select("p", sc.verdict(F.col("p")).alias("v")).collect():
        assert row.v == plain_verdict(row.p)
    assert plain_verdict([0.31, 0.39, 0.30]) == "Medium Confidence in Failure"
