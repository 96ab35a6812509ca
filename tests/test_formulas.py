import random
import time

import pytest

from scholia.functions import formulas as f
from scholia.operators import formulas

CASES = [
    ("$\\frac{1}{2}$", "1/2"),
    ("$\\sqrt{3}$", "√3"),
    ("$\\sqrt{a^2+b^2}$", "√(a²+b²)"),
    ("$x^{2}$", "x²"),
    ("$\\pi$", "π"),
    ("普通文字不含命令", "普通文字不含命令"),
    ("如图[图1]，求$\\frac{1}{2}+\\sqrt{3}$的值", "如图[图1]，求1/2+√3的值"),
    ("\\sqrt{13}", "√13"),
    ("图[图2]和$\\dfrac{15\\sqrt{3}}{4}$", "图[图2]和15√3/4"),
    ("求解 # 号问题", "求解 # 号问题"),
    # scripts and degrees
    ("$90^\\circ$ $a_1^2$ $a^2_1$ $x^{10}$ $\\sum_{i=1}^{n}$ $^2$", "90° a₁² a₁² x^(10) ∑_(i=1)ⁿ ²"),
    ("$x^{}$", "x"),
    ("$\\sqrt[3]{8}+\\sqrt[n]{x-1}$", "∛8+n√(x-1)"),
    ("$\\frac{a+b}{(c-d)}$", "(a+b)/(c-d)"),
    ("$\\frac\\sqrt{2}3$", "√2/3"),
    ("$\\frac12$", "\\frac12"),  # one number, so an argument is missing
    # letters, signs and styles
    ("$\\mathbb{R}^n\\subset\\mathbb{X^2}$", "ℝⁿ⊂X²"),
    ("$\\not\\in\\not=\\lambda\\Lambda\\varphi$", "∉≠λΛϕ"),
    ("$\\sin x\\,\\text{if}\\;x\\geq 0$", "sin x if x≥ 0"),
    ("$\\left(\\frac{1}{2}\\right.$", "(1/2"),
    ("$\\vec{AB}+\\overleftarrow{c}-\\hat{x}\\bar z$", "→AB+←c-x(帽) (上划线)z"),  # an accent takes the next character, a blank as well
    ("$a\\equiv b\\pmod{m}$", "a≡ b(mod m)"),
    ("$50\\%\\{x\\}$", "50%{x}"),
    # environments
    ("$\\begin{cases}x & x>0\\\\ -x & x<0\\end{cases}$", "x>0时x；x<0时-x"),
    ("\\begin{pmatrix}a & b \\\\ c & d\\\\ \\end{pmatrix}", "a b；c d"),
    # what can't be read stays
    ("\\foo{1}", "\\foo{1}"),
    ("$a}$, ${a$, $a&b$, $x^$, $\\begin{cases}x$", "a}, {a, a&b, x^, \\begin{cases}x"),
    ("$$a$$ b $", "\na\n b $"),
    ("cost 5$ and 6$ more", "cost 5and 6 more"),
    ("\\[x\\] and \\(y\\)", "\nx\n and y"),
    (None, ""),
    (" \u3000x\ufeff", "x"),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_by_hand(source, want):
    assert f.readable(source) == want


def test_reading_twice_changes_nothing():
    for source, want in CASES[:10]:
        assert f.readable(f.readable(source)) == f.readable(source), want


@pytest.mark.parametrize(
    "source",
    ["${n}$".replace("{n}", "{" * 10_000 + "x" + "}" * 10_000), "\\frac{1}{" * 10_000 + "2" + "}" * 10_000, "x^{" * 10_000 + "2" + "}" * 10_000, "{" * 10_000 + "\\pi", "\\sqrt" * 10_000 + "2", "\\[" * 100_000, "$$$" * 50_000, "\\(" * 100_000,
     "".join(f"\\begin{{e{k}}}" for k in range(3000)) + "x" + "".join(f"\\end{{e{k}}}" for k in reversed(range(3000)))],
)
def test_depth_and_length_cost_no_more_than_their_size(source):
    began = time.perf_counter()
    f.readable(source)
    f.pieces(source)
    assert time.perf_counter() - began < 5


def test_ten_thousand_groups_are_read():
    assert f.readable("$" + "{" * 10_000 + "x" + "}" * 10_000 + "$") == "x"
    assert f.readable("\\frac{1}{" * 3 + "2" + "}" * 3) == "1/1/1/2"


def test_nothing_raises():
    rnd = random.Random(3)
    parts = ["\\", "{", "}", "^", "_", "$", "&", "#", "\\frac", "\\sqrt", "[", "]", "\\begin{a}", "\\end{a}", "\\not", "x", "12", ".5", " ", "\n", "\\left", "\\mathbb", "\\circ", "中", "(", "\\pmod", "\\\\"]
    for _ in range(5000):
        source = "".join(rnd.choice(parts) for _ in range(rnd.randrange(15)))
        got = f.readable(source)
        assert isinstance(got, str) and (got or not source.strip(f.BLANK) or "{" in source or "\\" in source or "$" in source)
        assert "".join(v for _, _, v in f.pieces(source) if v) is not None


def test_rows_and_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " plain ", None), (4, "$\\frac{1}{2}$", "c"), (4, "$\\frac{1}{2}$", "c"), (None, "\\pi\n\n$x$ y", "d")]
    df = spark.createDataFrame(rows, "id long, text string, line string")
    got = df.select("id", formulas.readable(df["text"]).alias("r")).collect()
    assert [r["r"] for r in got] == ["", "", "plain", "1/2", "1/2", "π\n\nx y"]
    cut = formulas.pieces(df.drop("line"), "text").collect()
    assert [tuple(r)[2:] for r in cut if r["id"] is None] == [(0, 0, "text", "\\pi"), (2, 0, "math", "x"), (2, 1, "text", " y")]
    assert [tuple(r)[2:] for r in cut if r["id"] == 3] == [(0, 0, "text", " plain ")] and not [r for r in cut if r["id"] in (1, 2)]
    assert formulas.pieces(df.drop("line").limit(0), "text").count() == 0


def test_the_same_text_is_read_once(monkeypatch):
    from scholia.functions import formulas as read

    reads = []
    monkeypatch.setattr(read, "Reader", lambda *a, own=read.Reader: (reads.append(a), own(*a))[1])
    long = r"$\frac{97}{31}$ " * 40
    assert [read.readable(r"$\frac{97}{53}$ once") for _ in range(5)] == ["97/53 once"] * 5 and len(reads) == 1
    assert read.readable(long) == read.readable(long) and read.readable(None) == "" and len(reads) == 2
