"""Questions by number on literal pages, and one reading of each spot."""

import pytest
from pyspark.sql import functions as F

from scholia.operators import locate

LINES = "page long, col long, id long, x0 double, y0 double, x1 double, y1 double, body string"
FIGURES = "page long, fx0 double, fy0 double, fx1 double, fy1 double, label int"


def found(spark, lines, wanted, figures=()):
    rows = spark.createDataFrame([(1, 0, k, 50.0, y, x1, y + 20.0, body) for k, (y, x1, body) in enumerate(lines)], LINES)
    labels = spark.createDataFrame([(1, n) for n in wanted], "page long, label long")
    return {r["label"]: r for r in locate.located(rows, labels, spark.createDataFrame([(1, *f) for f in figures], FIGURES), 1000, 1000).collect()}


@pytest.mark.parametrize("s,want", [("3. 求", 3), ("1.5 倍", None), ("第 4 题 求", 4), ("第4题图", None), ("【例 7】", 7), ("301. 求", None), ("14如图", None), ("", None), ("2、", 2)])
def test_question_number(spark, s, want):
    assert spark.createDataFrame([(s,)], "s string").select(locate.question_number(F.col("s")).alias("n")).first()["n"] == want


def test_from_number_to_number(spark):
    got = found(spark, [(100.0, 900.0, "1. a"), (130.0, 900.0, "b"), (200.0, 900.0, "2. c"), (230.0, 900.0, "解：d"), (300.0, 900.0, "14如图")], [1, 2, 14, 5])
    assert (got[1]["y0"], got[1]["y1"], got[1]["solution"]) == (0.1, 0.16, None) and (got[1]["x0"], got[1]["x1"]) == (0.03, 0.92)
    assert (got[2]["y0"], got[2]["y1"], got[2]["solution"]) == (0.2, 0.26, 0.23)
    assert got[14]["located"] and got[14]["y0"] == 0.3
    assert not got[5]["located"] and [got[5][c] for c in ("x0", "y0", "x1", "y1")] == [0, 0, 1, 1]


def test_notes_and_lines_in_a_body(spark):
    lines = [(100.0, 900.0, "1. a"), (130.0, 200.0, "x"), (160.0, 200.0, "y"), (190.0, 200.0, "z")]
    assert found(spark, lines, [1])[1]["y1"] == 0.13
    assert found(spark, lines[:3], [1])[1]["y1"] == 0.19
    assert found(spark, [(100.0, 900.0, "1. a\n2. b")], [2])[2]["y0"] == 0.11


def test_figures_go_to_their_question(spark):
    lines = [(100.0, 900.0, "1. a"), (300.0, 900.0, "2. b"), (330.0, 900.0, "第1题图")]
    got = found(spark, lines, [1, 2], [(40.0, 130.0, 960.0, 280.0, None), (100.0, 340.0, 200.0, 400.0, 2), (0.0, 150.0, 0.0, 160.0, None)])
    assert (got[1]["y1"], got[1]["x1"], got[1]["n_figures"]) == (0.28, 0.96, 1)
    assert (got[2]["y1"], got[2]["n_figures"]) == (0.4, 1)


def test_nothing_to_locate(spark):
    got = found(spark, [(100.0, 900.0, None)], [1])
    assert not got[1]["located"] and got[1]["n_figures"] == 0
    assert found(spark, [], []) == {}


REGIONS = "page long, id long, x0 double, y0 double, x1 double, y1 double, score double, body string"


def fused(spark, rows):
    return [r["id"] for r in sorted(locate.fused(spark.createDataFrame([(1, *r) for r in rows], REGIONS), "page").collect(), key=lambda r: r["place"])]


def test_best_reading_of_a_spot(spark):
    a, b = (0.0, 0.0, 100.0, 20.0), (0.0, 0.0, 98.0, 20.0)
    assert fused(spark, [(1, *a, 0.9, "got ll"), (2, *b, 0.8, "got 11.")]) == [2]  # a number beats the score
    assert fused(spark, [(1, *a, 0.9, "11. x"), (2, *b, 0.8, "12. y")]) == [1, 2]  # parts of one line
    assert fused(spark, [(1, *a, 0.9, "961"), (2, *b, 0.8, "1961")]) == [2]  # more digits
    assert fused(spark, [(1, *a, 0.9, "abc"), (2, *b, 0.8, "abcd")]) == [2]  # the one that holds the other
    assert fused(spark, [(1, *a, 0.9, "abc"), (2, *b, 0.8, "wxyz")]) == [1]  # the shorter
    assert fused(spark, [(1, *a, 0.9, None), (2, 0.0, 40.0, 100.0, 60.0, 0.8, "b")]) == [1, 2]
    assert fused(spark, [(1, *a, 0.9, "n1961."), (2, *b, 0.8, "61.d")]) == [1] and locate.numbers_in("61.d") == ()


def test_stroke_width(spark):
    from scholia.operators import layout

    ink = [(1, 10 * k + i, 0) for k in range(20) for i in range(3)] + [(1, 10 * k + i, 1) for k in range(20) for i in range(5)] + [(1, 5, 2), (1, 5, 2)] + [(1, i, 3) for i in range(90)] + [(2, i, 0) for i in range(4)]
    got = {r["image"]: (r["runs"], r["width"]) for r in layout.stroke_width(spark.createDataFrame(ink, "image long, x long, y long"), "image", 12).collect()}
    assert got == {1: (40, 4.0), 2: (1, 0.0)}
