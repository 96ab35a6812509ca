"""Questions found by their numbers, and readings of one spot made one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locate
from ..operators.locate import BARE, BRACKETED, CAPTION, FIGURE_LINE, OPTION, ORDINAL, ORDINAL_FIGURE, SEPARATED, SOLUTION
from ..registry import Tables, query

WIDTH, HEIGHT = 1000, 1600

_PART = "(SELECT *, p_partkey // 40 AS page, p_partkey % 17 + 1 AS n, p_size % 2 * 500 AS sx, p_size // 2 * 60 + p_partkey % 7 AS sy FROM part)"
_BODY = "CASE p_partkey % 12 WHEN 0 THEN n || '. ' || p_name WHEN 1 THEN '第' || n || '题 ' || p_name WHEN 2 THEN n || '如图' || chr(10) || n || '、' || p_name WHEN 3 THEN '解：' || p_name WHEN 4 THEN 'A. ' || p_name WHEN 5 THEN '第' || n || '题图' WHEN 6 THEN '【例' || n || '】' WHEN 7 THEN n || '.5' ELSE p_name END"


def _parts(t: Tables):
    k, s = F.col("p_partkey"), F.col("p_size")
    return t.part.select("*", F.floor(k / 40).alias("page"), (k % 17 + 1).cast("int").alias("n"), (s % 2 * 500).alias("sx"), (F.floor(s / 2) * 60 + k % 7).alias("sy"))


def _body():
    k, n, name = F.col("p_partkey") % 12, F.col("n").cast("string"), F.col("p_name")
    forms = [F.concat(n, F.lit(". "), name), F.concat(F.lit("第"), n, F.lit("题 "), name), F.concat(n, F.lit("如图\n"), n, F.lit("、"), name), F.concat(F.lit("解："), name), F.concat(F.lit("A. "), name), F.concat(F.lit("第"), n, F.lit("题图")), F.concat(F.lit("【例"), n, F.lit("】")), F.concat(n, F.lit(".5"))]
    out = F.when(k == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        out = out.when(k == i, form)
    return out.otherwise(name)


def _number(pattern: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(s, '{pattern}', 1), '') AS INTEGER)"


def _inside(n: str) -> str:
    return f"CASE WHEN {n} BETWEEN 1 AND 300 THEN {n} END"


_SHARE = "round(greatest(0.0, least(1.0, CAST({} AS DOUBLE) / {})), 6)"


@query(
    "locate_questions",
    f"""WITH l AS (SELECT page, p_size % 2 AS col, p_partkey AS id, sx + p_partkey % 20 AS x0, sy AS y0, sx + p_partkey % 20 + 60 + p_partkey * 7 % 380 AS x1, sy + 40 AS y1, {_BODY} AS body FROM {_PART}),
    e AS (SELECT *, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS pos, CAST(len(p) AS DOUBLE) AS parts FROM (SELECT *, string_split(body, chr(10)) AS p FROM l)), x AS (SELECT page, col, id, x0, x1, s, pos, y0 + (y1 - y0) / parts * pos AS y0, y0 + (y1 - y0) / parts * (pos + 1) AS y1 FROM e),
    t AS (SELECT *, row_number() OVER (PARTITION BY page, col ORDER BY y0, x0, id, pos) AS r, max(x1 - x0) OVER (PARTITION BY page, col) AS widest, coalesce({_inside(_number(BRACKETED))}, CASE WHEN NOT regexp_matches(s, '{ORDINAL_FIGURE}') THEN {_inside(_number(ORDINAL))} END, {_inside(_number(SEPARATED))}) AS number, {_number(BARE)} AS bare, {_number(CAPTION)} AS caption FROM x),
    w AS (SELECT DISTINCT page, unnest(range(1, 13)) AS label FROM l), k AS (SELECT *, number AS label, FALSE AS late FROM t WHERE number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page, number ORDER BY col, y0, x0, id, pos) = 1),
    b AS (SELECT t.*, t.bare AS label, TRUE AS late FROM t JOIN w ON w.page = t.page AND w.label = t.bare WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.page = t.page AND k.label = t.bare) QUALIFY row_number() OVER (PARTITION BY t.page, t.bare ORDER BY col, y0, x0, id, pos) = 1),
    a AS (SELECT page, label, late, col, y0 AS ay, r AS ar, x0 AS ax0, x1 AS ax1, y1 AS ay1 FROM (SELECT * FROM k UNION ALL SELECT * FROM b)), g AS (SELECT *, coalesce((SELECT min(n.ay) FROM a n WHERE n.page = a.page AND n.col = a.col AND n.ay > a.ay), {HEIGHT}) AS bound, coalesce((SELECT max(n.ay) FROM a n WHERE n.page = a.page AND n.col = a.col AND n.ay < a.ay), 0) AS floor FROM a),
    o AS (SELECT g.*, t.r, t.s, t.x0, t.x1, t.y0, t.y1, coalesce(t.caption = g.label, TRUE) AS own, t.x1 - t.x0 >= 0.6 * greatest(widest, 1) OR regexp_matches(s, '{OPTION}') OR regexp_matches(s, '{FIGURE_LINE}') AS printed FROM g JOIN t ON t.page = g.page AND t.col = g.col AND t.y0 >= ay AND t.y0 < bound),
    h AS (SELECT page, label, min(y0) AS note FROM (SELECT *, lead(printed, 1) OVER v AS p1, lead(printed, 2) OVER v AS p2 FROM o WHERE own WINDOW v AS (PARTITION BY page, label ORDER BY r)) WHERE NOT printed AND NOT p1 AND NOT p2 GROUP BY 1, 2),
    q AS (SELECT o.page, o.label, any_value(ay) AS ay, any_value(bound) AS bound, any_value(floor) AS floor, coalesce(min(x0) FILTER (WHERE own AND coalesce(y0 < note, TRUE)), min(x0) FILTER (WHERE own), any_value(ax0)) - 20 AS x0, coalesce(max(x1) FILTER (WHERE own AND coalesce(y0 < note, TRUE)), max(x1) FILTER (WHERE own), any_value(ax1)) + 20 AS x1,
    least(any_value(bound), coalesce(max(y1) FILTER (WHERE own AND coalesce(y0 < note, TRUE)), max(y1) FILTER (WHERE own), any_value(ay1)) + greatest(4, 0.5 * (any_value(ay1) - any_value(ay)))) AS fin, min(y0) FILTER (WHERE r > ar AND regexp_matches(s, '{SOLUTION}')) AS sol FROM o LEFT JOIN h ON h.page = o.page AND h.label = o.label GROUP BY 1, 2),
    f AS (SELECT page, p_partkey AS fid, sx + 100 AS fx0, sy - 80 AS fy0, sx + 350 AS fx1, sy + 40 AS fy1, CASE WHEN p_partkey % 2 = 0 THEN n END AS declared FROM {_PART} WHERE p_partkey % 7 = 0),
    c AS (SELECT f.*, g.label FROM f JOIN g ON g.page = f.page WHERE coalesce(declared = label, FALSE) OR least(fy1, bound) - greatest(fy0, ay) > 0 QUALIFY row_number() OVER (PARTITION BY f.page, fid ORDER BY coalesce(declared = label, FALSE) DESC, least(fy1, bound) - greatest(fy0, ay) DESC, late, col, ar, label DESC) = 1),
    d AS (SELECT page, label, min(fx0) AS fx0, min(fy0) AS fy0, max(fx1) AS fx1, max(fy1) AS fy1, count(*) AS n_figures FROM c GROUP BY 1, 2)
    SELECT w.page, w.label, fin IS NOT NULL AS located, CASE WHEN fin IS NULL THEN 0.0 ELSE {_SHARE.format("least(x0, fx0)", WIDTH)} END AS x0, CASE WHEN fin IS NULL THEN 0.0 ELSE {_SHARE.format("CASE WHEN fy0 IS NULL THEN ay ELSE greatest(floor, least(ay, fy0)) END", HEIGHT)} END AS y0, CASE WHEN fin IS NULL THEN 1.0 ELSE {_SHARE.format("greatest(x1, fx1)", WIDTH)} END AS x1, CASE WHEN fin IS NULL THEN 1.0 ELSE {_SHARE.format("least(bound, greatest(fin, fy1))", HEIGHT)} END AS y1,
    CASE WHEN sol < fin THEN {_SHARE.format("sol", HEIGHT)} END AS solution, CASE WHEN fin IS NULL THEN 0 ELSE coalesce(n_figures, 0) END AS n_figures FROM w LEFT JOIN q ON q.page = w.page AND q.label = w.label LEFT JOIN d ON d.page = w.page AND d.label = w.label""",
)
def locate_questions(t: Tables):
    p, k = _parts(t), F.col("p_partkey")
    x0 = F.col("sx") + k % 20
    lines = p.select("page", (F.col("p_size") % 2).alias("col"), k.alias("id"), x0.alias("x0"), F.col("sy").alias("y0"), (x0 + 60 + k * 7 % 380).alias("x1"), (F.col("sy") + 40).alias("y1"), _body().alias("body"))
    figures = p.where(k % 7 == 0).select("page", (F.col("sx") + 100).alias("fx0"), (F.col("sy") - 80).alias("fy0"), (F.col("sx") + 350).alias("fx1"), (F.col("sy") + 40).alias("fy1"), F.when(k % 2 == 0, F.col("n")).alias("label"))
    wanted = p.select("page").distinct().select("page", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("label"))
    return locate.located(lines, wanted, figures, WIDTH, HEIGHT)


@query("fused_regions")
def fused_regions(t: Tables):
    p, k = _parts(t), F.col("p_partkey")
    x0, y0 = F.col("p_size") % 3 * 200 + k % 13 * 4, F.floor(F.col("p_size") / 3) * 50 + k % 5 * 3
    body = F.when(k % 4 == 0, F.concat(F.col("n").cast("string"), F.lit(". "), "p_name")).when(k % 4 == 1, F.concat(F.lit("l"), F.col("n").cast("string"), F.lit(". "), "p_name")).otherwise(F.col("p_name"))
    return locate.fused(p.select("page", k.alias("id"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 150 + k % 30).cast("double").alias("x1"), (y0 + 40).cast("double").alias("y1"), (F.lit(0.5) + k % 50 / 100).alias("score"), body.alias("body")), "page")
