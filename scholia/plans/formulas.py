"""Formulas built from columns of the tables, whose readable form SQL knows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import formulas
from ..registry import Tables, query

# Formulas in which @q, @n and @p are a quantity, a line number (one digit) and a part, and what they read as in SQL.
FORMULAS: list[tuple[str, str]] = [
    (r"$\frac{@q}{@n}$", "q || '/' || n"),
    (r"$\sqrt{@q+@n}$ more", "'√(' || q || '+' || n || ') more'"),
    (r"$x_{@n}^{2}$", "'x' || chr(8320 + n::INTEGER) || '²'"),
    (r"as $x^{@q}$, $x_@n$", "'as x' || CASE WHEN length(q) = 1 THEN substr('⁰¹²³⁴⁵⁶⁷⁸⁹', q::INTEGER + 1, 1) ELSE '^(' || q || ')' END || ', x' || chr(8320 + n::INTEGER)"),
    ("see\n\\begin{pmatrix} @q & @n \\\\ @p & 1 \\end{pmatrix}", "'see' || chr(10) || q || ' ' || n || '；' || p || ' 1'"),
    (r"$\unknown{@q}$ and $\alpha+@n$", r"'\unknown{' || q || '} and α+' || n"),
    (r"图[图@n]: $\dfrac{@p\sqrt{@q}}{@n}$", "'图[图' || n || ']: ' || p || '√' || q || '/' || n"),
    (r"$\vec{AB}\leq\binom{@q}{@n}$", "'→AB≤C(' || q || ',' || n || ')'"),
    (r"\frac{@q-@n}{\sqrt[3]{@p}}", "'(' || q || '-' || n || ')/∛' || p"),
    (r"$$\begin{cases}@q&x>@n\\-x&x\le0\end{cases}$$ over $\mathbb{R}^@n$", "chr(10) || 'x>' || n || '时' || q || '；x≤0时-x' || chr(10) || ' over ℝ' || substr('⁰¹²³⁴⁵⁶⁷⁸⁹', n::INTEGER + 1, 1)"),
    (r"{@n \pi, $@q^\circ$", r"'{' || n || ' \pi, ' || q || '°'"),
    (r"$90^{\circ}-\hat{@n}\pmod{@q}$", "'90°-' || n || '(帽)(mod ' || q || ')'"),
]


def _built(pick: Column, values: dict[str, Column]) -> Column:
    made = F.element_at(F.array(*(F.lit(f) for f, _ in FORMULAS)), pick + 1)
    for mark, value in values.items():
        made = F.replace(made, F.lit(mark), value)
    return made


@query(
    "formula_readable",
    "SELECT l_orderkey, l_linenumber, CASE k "
    + " ".join(f"WHEN {k} THEN {sql}" for k, (_, sql) in enumerate(FORMULAS))
    + f""" END AS readable FROM (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % {len(FORMULAS)} AS k, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, CAST(l_linenumber AS VARCHAR) AS n, CAST(l_partkey AS VARCHAR) AS p FROM lineitem)""",
)
def formula_readable(t: Tables):
    values = {"@q": F.col("l_quantity").cast("int").cast("string"), "@n": F.col("l_linenumber").cast("string"), "@p": F.col("l_partkey").cast("string")}
    rows = t.lineitem.select("l_orderkey", "l_linenumber", _built(((F.col("l_orderkey") + F.col("l_linenumber")) % len(FORMULAS)).cast("int"), values).alias("formula"))
    return rows.select("l_orderkey", "l_linenumber", formulas.readable(F.col("formula")).alias("readable"))


@query(
    "formula_pieces",
    """SELECT p_partkey, line::INTEGER AS line, nth::INTEGER AS nth, kind, piece FROM part, (VALUES (0, 0, 'text', '1. '), (0, 1, 'math', 'x^S'), (0, 2, 'text', ' of N'), (1, 0, 'display', '\\frac{1}{S}'), (3, 0, 'math', 'y'), (3, 1, 'text', ' costs $S')) v(line, nth, kind, piece_)
    , LATERAL (SELECT replace(replace(piece_, 'S', p_size::VARCHAR), 'N', p_name) AS piece) WHERE p_partkey % 3 <> 0
    UNION ALL SELECT p_partkey, line, 0, 'text', CASE line WHEN 0 THEN p_name ELSE p_type END FROM part, (VALUES (0), (2)) v(line) WHERE p_partkey % 3 = 0""",
)
def formula_pieces(t: Tables):
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    mixed = F.concat(F.lit("1. $x^"), size, F.lit("$ of "), name, F.lit("$$ \\frac{1}{"), size, F.lit("}$$\n\\(y\\) costs $"), size)
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(name, F.lit("\n\n"), "p_type")).otherwise(mixed).alias("text"))
    return formulas.pieces(rows, "text").drop("text")
