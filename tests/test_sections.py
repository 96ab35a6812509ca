"""Question units and sections by hand, and the repair of sequences against a walk written anew over plain lists."""

import random

import pytest
from pyspark.sql import functions as F

from scholia.operators import sections

HEIGHT, COLUMNS = 1000, [(0.0, 500.0), (500.0, 1000.0)]
SCHEMA = "page long, id long, col int, x0 double, y0 double, x1 double, y1 double, body string"


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("3. what", [(0, "3.", 3)]),
        ("3、what 4) more", [(0, "3、", 3), (7, "4)", 4)]),
        ("3.5 × 1.2", []),
        ("5,000 people and 1,500", []),
        ("born in 1961. x", []),
        ("61.d", []),
        ("10.h", [(0, "10.", 10)]),
        ("A. (5) x", []),
        ("(5) x", [(0, "(5)", 5)]),
        ("the winds make it 14 homd to", [(18, "14", 14)]),
        ("at 3 o'clock", []),
        ("Unit 1 to", []),
        ("about 20 men", []),
        ("20 years ago", []),
        ("in 61 the", []),
        ("put it out? Because 13", [(20, "13", 13)]),
        ("the winds were strong, 9", [(23, "9", 9)]),
        ("26", []),
        ("7heat", [(0, "7", 7)]),
        ("（三）阅读 十一、选 ②", [(0, "（三）", 3), (6, "十一、", 11), (11, "②", 2)]),
        ("Ⅱ. x", [(0, "Ⅱ.", 2)]),
        ("", []),
        (None, []),
        ("x" * 20_000 + " 12. y", [(20_001, "12.", 12)]),
    ],
)
def test_tokens_by_hand(spark, line, want):
    df = spark.createDataFrame([(line,)], "s string").select(sections.tokens(F.col("s")).alias("t"))
    assert [tuple(t) for t in df.first()["t"]] == want


def page(rows, n=1):
    return [(n, k, c, float(x), float(y), float(x + 200), float(y + 20), t) for k, (c, x, y, t) in enumerate(rows)]


def labels(spark, rows):
    df = spark.createDataFrame(page(rows), SCHEMA)
    return {(r["id"], r["nth"]): r["label"] for r in sections.questions(df, HEIGHT).collect()}


def test_labels_of_two_columns(spark):
    """Each column counts on its own; what stands above the first title goes on from the page before."""
    rows = [(0, 10, 10, "6. rest"), (0, 10, 100, "Ⅱ.选词填空"), (0, 10, 150, "1. a"), (0, 10, 200, "2. b"), (1, 510, 100, "Ⅲ.汉译英"), (1, 510, 150, "1. c"), (1, 510, 400, "2. d"), (0, 10, 500, "3. e")]
    assert labels(spark, rows) == {(0, 0): "前页续 6", (2, 0): "Ⅱ.选词填空 1", (3, 0): "Ⅱ.选词填空 2", (7, 0): "Ⅱ.选词填空 3", (5, 0): "Ⅲ.汉译英 1", (6, 0): "Ⅲ.汉译英 2"}


def test_sections_and_a_false_lead(spark):
    rows = [(0, 10, 5, "1. first of the page"), (0, 10, 50, "【检测案】"), (0, 10, 100, "Ⅰ.选词填空"), (0, 10, 150, "1. a"), (0, 10, 300, "第二章"), (0, 10, 350, "1. no subsection")]
    got = labels(spark, rows)
    assert got[(3, 0)] == "检测案·Ⅰ.选词填空 1" and got[(5, 0)] is None and got[(0, 0)] == "检测案 1"


def test_numbering_counts_through(spark):
    rows = [(0, 10, 10, "Ⅰ.选词填空"), (0, 10, 50, "1. a"), (0, 10, 90, "2. b"), (0, 10, 200, "Ⅱ.汉译英"), (0, 10, 250, "3. c"), (0, 10, 300, "Ⅲ.阅读"), (0, 10, 350, "4. d")]
    df = spark.createDataFrame(page(rows), SCHEMA)
    assert {r["unified"] for r in sections.questions(df, HEIGHT).collect()} == {True}
    (r,) = sections.repaired(df, HEIGHT, COLUMNS).collect()
    assert (r["sub"], r["seq"], r["gaps"]) == (None, [1, 2, 3, 4], [])


def test_repairs_by_hand(spark):
    rows = [(0, 10, 100, "1. a"), (0, 10, 140, "2"), (0, 10, 180, ".narrow road"), (0, 10, 220, "4. d"), (0, 10, 260, "4. again"), (0, 10, 300, "7. g"), *((0, 10, 340 + 30 * k, f"{8 + k}. x") for k in range(2)), (0, 10, 420, "M0. lost"), (0, 10, 500, "11")]
    (r,) = sections.repaired(spark.createDataFrame(page(rows), SCHEMA), HEIGHT, COLUMNS).collect()
    assert r["seq"] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11][:4] + [7, 8, 9, 10, 11]
    assert (r["gaps"], r["duplicates"], r["injected"], [x["number"] for x in r["repairs"]]) == ([5, 6], [4], [2, 3, 11], [10])


def plain_walk(rows):
    """One column without titles: the rule over plain lists, one number or one region at a time."""
    heads = [(y, t) for _, _, y, t in rows if t.split(".")[0].isdigit() and "." in t]
    bare = {k: (y, t) for k, (_, _, y, t) in enumerate(rows) if t.isdigit() or t.startswith(".")}
    seq, gaps, twice, injected, low, want, used = [], [], [], [], 0.0, 1, set()

    def find(n, lo, hi):
        for lost in (False, True):
            for k, (y, t) in bare.items():
                if k not in used and y + 20 >= lo and y <= hi and (t.startswith(".") if lost else t == str(n)):
                    used.add(k)
                    return y + 20
        return None

    for y, t in sorted(heads):
        n = int(t.split(".")[0])
        if n < want:
            twice.append(n)
            continue
        while want < n:
            at = find(want, low, y + 10)
            if at is None:
                gaps.append(want)
            else:
                injected.append(want)
                seq.append(want)
                low = at
            want += 1
        seq.append(n)
        want, low = n + 1, y + 10
    for n in range(want, want + 13):
        at = find(n, low, HEIGHT)
        if at is None:
            break
        injected.append(n)
        seq.append(n)
        low = at
    return seq, gaps, twice, injected


def test_repairs_against_a_plain_walk(spark):
    rnd = random.Random(7)
    pages, want = [], {}
    for n in range(40):
        rows, number = [], 1
        for k in range(25):
            kind = rnd.random()
            number += rnd.choice([0, 1, 1, 1, 2, 3])
            rows.append((0, 10, 20 + 35 * k, f"{number}. item" if kind < 0.6 else str(rnd.choice([number, number + 1])) if kind < 0.75 else ".item" if kind < 0.85 else "plain words"))
        pages += page(rows, n)
        want[n] = plain_walk(rows)
    got = sections.repaired(spark.createDataFrame(pages, SCHEMA), HEIGHT, COLUMNS).collect()
    assert {r["page"]: (r["seq"], r["gaps"], r["duplicates"], r["injected"]) for r in got} == want


def test_odd_pages(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sections.questions(empty, HEIGHT).count() == 0 and sections.repaired(empty, HEIGHT, COLUMNS).count() == 0
    rows = page([(0, 10, 10, None), (0, 10, 40, ""), (1, 510, 10, "1. a"), (1, 510, 10, "1. a")])
    assert len(sections.questions(spark.createDataFrame(rows, SCHEMA), HEIGHT).collect()) == 2


def test_a_line_is_read_once(spark):
    """What is found in a line isn't worked out again for each token, column or filter that names it."""
    df = spark.createDataFrame(page([(0, 10, 10, "1. a")]), SCHEMA)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    titles = sections.headers(df)
    assert plan(titles).count(sections.ROMAN_TITLE + ", 2)") == 1
    assert plan(sections.units(df, titles.limit(0))).count("regexp_extract_all(") == 2


def test_tokens_of_a_long_line(spark):
    line = " ".join(f"{k % 20 + 1}. word" for k in range(300))
    got = spark.createDataFrame([(line,)], "s string").select(sections.tokens(F.col("s")).alias("t")).first()["t"]
    assert [t["number"] for t in got] == [k % 20 + 1 for k in range(300)] and all(line[t["at"] :].startswith(t["raw"]) for t in got)
