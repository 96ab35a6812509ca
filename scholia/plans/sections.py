"""Question units, their sections and their sequences, on pages made of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections
from ..registry import Tables, query

HEIGHT, COLUMNS = 1600, [(0.0, 500.0), (500.0, 1000.0)]

# Lines by the part's number of 40: titles (kind, Roman numeral, title), and a bare and a lost number.
TITLE_LINES = {
    5: ("【检测案】", "section", None, "检测案"), 21: ("第二章", "section", None, "二"), 9: ("Ⅱ.选词填空。", "subsection", 2, "选词填空。"),
    14: ("Ⅲ、汉译英", "subsection", 3, "汉译英"), 26: ("阅读短文", "subsection", None, "阅读短文"), 33: ("IV.完成句子", "subsection", 4, "完成句子"),
}
_PART = "(SELECT *, p_partkey // 40 AS page, CAST(p_partkey % 17 + 1 AS VARCHAR) AS n, p_size % 2 AS col, p_partkey % 40 AS k40, p_partkey % 9 AS k9 FROM part)"
#: The other lines by the part's number of 9: how it is written, and in SQL its tokens: at, raw, number.
LINES = [
    ("@n. @name", [("0", "n || '.'", "n")]),
    ("@n、@name", [("0", "n || '、'", "n")]),
    ("A. @name@n. x", []),
    ("@name, @n", [("length(p_name) + 2", "n", "n")]),
    ("3.5kg @name", []),
    ("in 1961. @name", []),
    ("（@n） @name ② @size", [("0", "'（' || n || '）'", "n"), ("length(n) + length(p_name) + 4", "'②'", "'2'")]),
    ("@name 12 homd d", [("length(p_name) + 1", "'12'", "'12'")]),
    ("@name", []),
]
_CASE = "CASE " + " ".join(f"WHEN k40 = {k} THEN '{v[0]}'" for k, v in TITLE_LINES.items()) + " WHEN k40 = 29 THEN n WHEN k40 = 30 THEN '.' || p_name ELSE CASE k9 " + " ".join(f"WHEN {k} THEN replace(replace(replace('{form}', '@name', p_name), '@n', n), '@size', p_size::VARCHAR)" for k, (form, _) in enumerate(LINES)) + " END END"
_PLAIN = f"k40 NOT IN ({', '.join(map(str, [*TITLE_LINES, 29, 30]))})"
_TOKENS = " UNION ALL ".join(f"SELECT p_partkey AS id, {nth} AS nth, {at} AS place, {raw} AS raw, CAST({number} AS INTEGER) AS number FROM {_PART} WHERE {_PLAIN} AND k9 = {k}" for k, (_, all_) in enumerate(LINES) for nth, (at, raw, number) in enumerate(all_)) + f" UNION ALL SELECT p_partkey, 0, 0, 'Ⅱ.', 2 FROM {_PART} WHERE k40 = 9"


def _regions(t: Tables):
    k, size = F.col("p_partkey"), F.col("p_size")
    n, name = (k % 17 + 1).cast("string"), F.col("p_name")
    line = F.element_at(F.array(*(F.lit(form) for form, _ in LINES)), (k % 9 + 1).cast("int"))
    body = F.replace(F.replace(F.replace(line, F.lit("@name"), name), F.lit("@n"), n), F.lit("@size"), size.cast("string"))
    for k40, (title, *_) in TITLE_LINES.items():
        body = F.when(k % 40 == k40, title).otherwise(body)
    body = F.when(k % 40 == 29, n).when(k % 40 == 30, F.concat(F.lit("."), name)).otherwise(body)
    x0, y0 = (size % 2 * 500 + k % 20).cast("double"), (F.floor(size / 2) * 60 + k % 7).cast("double")
    return t.part.select(F.floor(k / 40).alias("page"), k.alias("id"), (size % 2).cast("int").alias("col"), x0.alias("x0"), y0.alias("y0"), (x0 + 60 + k * 7 % 380).alias("x1"), (y0 + 40).alias("y1"), body.alias("body"))


@query("question_tokens", f"SELECT id, nth::INTEGER AS nth, place::INTEGER AS place, raw, number FROM ({_TOKENS})")
def question_tokens(t: Tables):
    return _regions(t).select("id", F.posexplode_outer(sections.tokens(F.col("body"))).alias("nth", "t")).where("nth IS NOT NULL").select("id", "nth", F.col("t.at").alias("place"), "t.raw", "t.number")


def _of_titles(which: int, otherwise: str) -> str:
    quote = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN k40 = {k} THEN {quote(v[which])}" for k, v in TITLE_LINES.items()) + f" ELSE {otherwise} END"


@query(
    "question_sections",
    f"""WITH l AS (SELECT page, p_partkey AS id, col, col * 500 + p_partkey % 20 AS x0, p_size // 2 * 60 + p_partkey % 7 AS y0, col * 500 + p_partkey % 20 + 60 + p_partkey * 7 % 380 AS x1, p_size // 2 * 60 + p_partkey % 7 + 40 AS y1, {_CASE} AS body, {_of_titles(1, "NULL")} AS kind, {_of_titles(2, "NULL")} AS roman, {_of_titles(3, "''")} AS title FROM {_PART}),
    h AS (SELECT *, count(*) FILTER (kind = 'section') OVER w - CASE WHEN first_value(kind) OVER w = 'section' THEN 1 ELSE 0 END AS sec FROM l WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY page ORDER BY y0, y1, id)),
    s0 AS (SELECT page, sec, title AS sec_title, y0 AS sec_y0 FROM h WHERE kind = 'section' UNION ALL SELECT page, 0, '', 0 FROM (SELECT DISTINCT page FROM l) p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.page = p.page AND h.sec = 0 AND kind = 'section')),
    s AS (SELECT *, coalesce((SELECT min(n.sec_y0) FROM s0 n WHERE n.page = s0.page AND n.sec > s0.sec), {HEIGHT}) AS sec_y1 FROM s0),
    b AS (SELECT h.page, h.sec, h.id, h.y0, h.y1 AS b, coalesce((SELECT min(n.y0) FROM h n WHERE n.page = h.page AND n.sec = h.sec AND n.col = h.col AND n.kind = 'subsection' AND (n.y0, n.id) > (h.y0, h.id)), sec_y1) AS fin, roman, title, col, FALSE AS lead FROM h JOIN s ON s.page = h.page AND s.sec = h.sec WHERE kind = 'subsection'),
    f AS (SELECT page, arg_min(y0, (y0, id)) AS y0, arg_min(coalesce(roman, -1), (y0, id)) AS roman FROM b WHERE sec = 0 GROUP BY page),
    a AS (SELECT * FROM b UNION ALL SELECT s.page, 0, NULL, 0, 0, coalesce(f.y0, {HEIGHT}), CASE WHEN f.roman >= 2 THEN f.roman - 1 END, '', NULL, TRUE FROM s LEFT JOIN f ON f.page = s.page WHERE s.sec = 0 AND coalesce(f.y0, {HEIGHT}) > 0),
    c AS (SELECT a.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.page = a.page AND l.col <> a.col AND (l.y0 + l.y1) / 2 >= a.y0 AND (l.y0 + l.y1) / 2 < fin) AND NOT EXISTS (SELECT 1 FROM b o WHERE o.page = a.page AND o.sec = a.sec AND o.col <> a.col AND o.y0 <= a.fin AND o.fin >= a.y0) THEN NULL ELSE col END AS col), row_number() OVER (PARTITION BY page, sec ORDER BY lead DESC, y0, b, id) - 1 AS sub FROM a),
    t AS (SELECT l.page, l.id, l.col, k.nth, k.number, l.x0 + (l.x1 - l.x0) * k.place::DOUBLE / length(l.body) AS ax, (l.y0 + l.y1) / 2 AS ay FROM l JOIN ({_TOKENS}) k ON k.id = l.id WHERE l.kind IS NULL),
    u AS (SELECT t.*, coalesce((SELECT max(sec) FROM s WHERE s.page = t.page AND sec_y0 <= ay), 0) AS sec FROM t),
    p AS (SELECT u.*, c.sub FROM u LEFT JOIN c ON c.page = u.page AND c.sec = u.sec QUALIFY row_number() OVER (PARTITION BY u.id, u.nth ORDER BY CASE WHEN coalesce(c.col = u.col, TRUE) AND c.y0 <= ay AND ay < fin THEN 3 WHEN coalesce(c.col = u.col, TRUE) AND c.y0 <= ay THEN 2 WHEN c.y0 <= ay THEN 1 WHEN c.sub = 0 THEN 0 ELSE -1 END DESC, c.sub DESC) = 1),
    g AS (SELECT *, sum(start) OVER (PARTITION BY page ORDER BY ay, ax, id, nth) AS band FROM (SELECT p.*, CASE WHEN ay - lag(ay) OVER (PARTITION BY page ORDER BY ay, ax, id, nth) <= 32 THEN 0 ELSE 1 END AS start, (SELECT count(DISTINCT col) > 1 FROM l WHERE l.page = p.page) AS many FROM p)),
    o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN many THEN col ELSE band END, CASE WHEN many THEN ay ELSE ax END, CASE WHEN many THEN ax ELSE ay END, id, nth) AS pos FROM g),
    e AS (SELECT page, sec, sub, arg_min(number, pos) AS lo, arg_max(number, pos) AS hi FROM o GROUP BY ALL),
    v AS (SELECT e.page, e.sec, coalesce(count(*) FILTER (e.lo = q.hi + 1 AND NOT (e.lo = 1 AND q.hi >= 1)) > count(*) FILTER (e.lo = 1 AND q.hi >= 1), FALSE) AS unified FROM e LEFT JOIN e q ON q.page = e.page AND q.sec = e.sec AND q.sub = e.sub - 1 GROUP BY ALL),
    m AS (SELECT c.page, c.sec, c.sub, s.sec_title, regexp_replace(CASE WHEN NOT c.lead AND c.roman IS NOT NULL THEN substr('ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ', c.roman, 1) || '.' ELSE '' END || CASE WHEN c.title <> '' THEN c.title WHEN c.lead AND coalesce(e.lo, 0) <> 1 THEN '前页续' ELSE '' END, '[\\s.、．,，:：;；]+$', '') AS name FROM c JOIN s ON s.page = c.page AND s.sec = c.sec LEFT JOIN e ON e.page = c.page AND e.sec = c.sec AND e.sub = c.sub)
    SELECT o.page, o.id, o.nth::INTEGER AS nth, o.number, o.sec::INTEGER AS sec, o.sub::INTEGER AS sub, v.unified, CASE WHEN m.sub IS NOT NULL THEN concat_ws('·', nullif(sec_title, ''), nullif(name, '')) || ' ' || number END AS label FROM o JOIN v ON v.page = o.page AND v.sec = o.sec LEFT JOIN m ON m.page = o.page AND m.sec = o.sec AND m.sub = o.sub""",
)
def question_sections(t: Tables):
    return sections.questions(_regions(t), HEIGHT)


@query("sequence_repair")
def sequence_repair(t: Tables):
    out = sections.repaired(_regions(t), HEIGHT, COLUMNS)
    return out.select("page", "sec", "sub", *(F.array_join(c, ",").alias(c) for c in ("seq", "gaps", "duplicates", "injected")), F.size("repairs").alias("repairs"))
