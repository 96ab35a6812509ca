"""Scalar text rules over documents and literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import patterns
from ..operators import relational as R
from ..operators import retrieval as Q
from ..registry import Tables, query


def _values(rows: list[str]) -> str:
    return ", ".join(f"({k}, '" + r.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for k, r in enumerate(rows, 1))


def _rows(t: Tables, rows: list[str]):
    return t.literal("id int, s string", list(enumerate(rows, 1)))


MIXED = ["AB=6，平行四边形 ABCD！\n第 3 题", "A(-3,0)、B(1,0)", "", "已知三角形ABC的面积为６０，求 BC 的长：", "Ｘ＝１２　。ok；"]


@query("normalize", f"SELECT id, regexp_replace(s, '[^一-龥A-Za-z0-9]', '', 'g') AS k FROM (VALUES {_values(MIXED)}) v(id, s) UNION ALL SELECT CAST(doc_id + 1000 AS INTEGER), md5(regexp_replace(text, '[^一-龥A-Za-z0-9]', '', 'g')) FROM documents")
def normalize(t: Tables):
    return _rows(t, MIXED).select("id", text.normalised(F.col("s")).alias("k")).unionByName(R.text_keys(t.documents, "text", "doc_id").select((F.col("doc_id") + 1000).cast("int").alias("id"), F.col("key").alias("k")))


@query("normalize_dedup", f"SELECT id, regexp_replace(regexp_replace(s, '\\s+', '', 'g'), '[，。、；：？！\"''“”‘’（）()【】\\[\\]{{}}《》·—\\-–_,.;:?!/\\\\|+=*#~`^$@%&]', '', 'g') AS k FROM (VALUES {_values(MIXED)}) v(id, s)")
def normalize_dedup(t: Tables):
    return _rows(t, MIXED).select("id", text.without_punctuation(F.col("s")).alias("k"))


@query("normalize_ocr", f"SELECT id, regexp_replace(translate(s, '，。：；ＸＯＫ＝０１２３４５６７８９！', ',.:;XOK=0123456789!'), '[\\s　]+', '', 'g') AS k FROM (VALUES {_values(MIXED)}) v(id, s)")
def normalize_ocr(t: Tables):
    return _rows(t, MIXED).select("id", text.folded(F.col("s")).alias("k"))


ASKS = ["下列说法正确的是", "判断三角形AGD的形状并证明", "求三角形ABC的面积", "角A为多少度", "求x的取值范围", "求点P的坐标", "AB与CD之比", "求线段AB的长", "求x的值", "你好", "是否存在点P", "求证AB等于CD"]


def _ask_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(w, '{r}') THEN '{k}'" for k, r in text.ASK_RULES) + " ELSE 'unknown' END"


@query("ask_kind", f"SELECT id, {_ask_sql()} AS kind FROM (SELECT id, right(regexp_replace(s, '\\s+', '', 'g'), 80) AS w FROM (VALUES {_values(ASKS)}) v(id, s))")
def ask_kind(t: Tables):
    return _rows(t, ASKS).select("id", text.ask_kind(F.col("s")).alias("kind"))


NUMBERED = ["第二大题 x", "（三）阅读", "十一、选择", "②选", "（4）求", "12. 已知", "无题号", "", "二十、x", "3)x"]


@query(
    "parse_number",
    f"""WITH v AS (SELECT id, trim(s) AS s FROM (VALUES {_values(NUMBERED)}) v(id, s)), m AS (SELECT id, regexp_extract(s, '^第\\s*([一二三四五六七八九十\\d]{{1,3}})\\s*(部分|大题|卷)', 1) AS part, regexp_extract(s, '^[（(]\\s*([一二三四五六七八九十]{{1,3}})\\s*[）)]', 1) AS paren,
    regexp_extract(s, '^([一二三四五六七八九十]{{1,3}})\\s*[、，,．.]', 1) AS han, CASE WHEN s = '' THEN 0 ELSE instr('①②③④⑤⑥⑦⑧⑨⑩', s[1]) END AS circ, coalesce(nullif(regexp_extract(s, '^[（(]\\s*(\\d{{1,2}})\\s*[）)]', 1), ''), regexp_extract(s, '^(\\d{{1,2}})\\s*[、，,．.)）]', 1)) AS ar FROM v),
    h AS (SELECT *, coalesce(nullif(part, ''), nullif(paren, ''), nullif(han, '')) AS hs FROM m)
    SELECT id, CASE WHEN part <> '' THEN 'part' WHEN paren <> '' THEN 'paren-cjk' WHEN han <> '' THEN 'cjk' WHEN circ > 0 THEN 'circled' WHEN ar <> '' THEN 'arabic' ELSE 'none' END AS kind,
    CAST(CASE WHEN hs IS NOT NULL THEN CASE WHEN instr(hs, '十') = 0 THEN instr('一二三四五六七八九', hs) ELSE CASE WHEN instr(hs, '十') = 1 THEN 10 ELSE instr('一二三四五六七八九', hs[1]) * 10 END + CASE WHEN instr(hs, '十') = length(hs) THEN 0 ELSE instr('一二三四五六七八九', hs[-1]) END END WHEN circ > 0 THEN circ ELSE TRY_CAST(ar AS INTEGER) END AS INTEGER) AS num FROM h""",
)
def parse_number(t: Tables):
    kind, num = text.numbering(F.col("s"))
    return _rows(t, NUMBERED).select("id", kind.alias("kind"), num.alias("num"))


SPANS = ["阅读短文，完成第1-3题", "完成4、6题", "回答 7 至 9 题", "第10—12题", "完成 5-2 题", "无"]


def _range_sql(k: int) -> str:
    parts = []
    for r in text.RANGES:
        a, b = (f"TRY_CAST(regexp_extract(s, '{r}', {g}) AS INTEGER)" for g in (1, 2))
        parts.append(f"WHEN coalesce({a} > 0 AND {b} >= {a}, FALSE) THEN {(a, b)[k]}")
    return "CASE " + " ".join(parts) + " END"


@query("declared_range", f"SELECT id, {_range_sql(0)} AS lo, {_range_sql(1)} AS hi FROM (VALUES {_values(SPANS)}) v(id, s)")
def declared_range(t: Tables):
    lo, hi = text.declared_range(F.col("s"))
    return _rows(t, SPANS).select("id", lo.alias("lo"), hi.alias("hi"))


STEMS = ["1．", "54．0", "x²+1=0", "3、做功", "12 + 5 = 17", "", "①②③", "�", "2024/05"]


@query("meaningless", f"SELECT id, trim(s) <> '' AND NOT regexp_matches(s, '[一-龥㐀-䶿a-zA-Z]') AND regexp_matches(trim(s), '^[0-9\\s.,;:+*/=^%()\\[\\]{{}}<>|_、。，．；：！？…—－×÷·~√△∵∴°℃①②③④⑤⑥⑦⑧⑨⑩\\-]+$') AS meaningless FROM (VALUES {_values(STEMS)}) v(id, s)")
def meaningless(t: Tables):
    return _rows(t, STEMS).select("id", text.meaningless(F.col("s")).alias("meaningless"))


ANSWERS = ["x=3\n解析：移项得x=3", "答案是5", "y=1\n【解答】先配方\n再开方", "z\n解析：", "【详解】全是过程"]


@query(
    "answer_split",
    f"""WITH v AS (SELECT id, s, string_split(s, chr(10)) AS l FROM (VALUES {_values(ANSWERS)}) v(id, s)), h AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(x, '^\\s*([【\\[]\\s*({text.SOLUTION_HEADINGS})\\s*[】\\]]|({text.SOLUTION_HEADINGS})\\s*[:：])')), TRUE) AS a FROM v),
    p AS (SELECT *, CASE WHEN a > 0 THEN trim(array_to_string(list_concat([regexp_replace(l[a], '^\\s*([【\\[]\\s*({text.SOLUTION_HEADINGS})\\s*[】\\]]\\s*[:：]?|({text.SOLUTION_HEADINGS})\\s*[:：])', '')], l[a + 1:]), chr(10)), chr(10) || ' ') ELSE '' END AS sol FROM h)
    SELECT id, CASE WHEN sol <> '' THEN array_to_string(l[1:a - 1], chr(10)) ELSE trim(s, chr(10) || ' ') END AS answer, sol AS solution FROM p""",
)
def answer_split(t: Tables):
    a, s = text.answer_parts(F.col("s"))
    return _rows(t, ANSWERS).select("id", a.alias("answer"), s.alias("solution"))


FIGURES = ["如图[图1]所示，求[图2]的面积", "无图", "[图3]", "a[图10]b[图x]c"]


@query(
    "inline_runs",
    f"""WITH v AS (SELECT id, string_split(regexp_replace(s, '(\\[图[0-9]+\\])', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM (VALUES {_values(FIGURES)}) v(id, s)), r AS (SELECT id, unnest(list_filter(p, lambda x: x <> '')) AS run, generate_subscripts(list_filter(p, lambda x: x <> ''), 1) AS k FROM v)
    SELECT id, CAST(k - 1 AS BIGINT) AS k, run, TRY_CAST(regexp_extract(run, '^\\[图([0-9]+)\\]$', 1) AS INTEGER) AS slot FROM r""",
)
def inline_runs(t: Tables):
    runs = F.filter(F.split(F.regexp_replace("s", r"(\[图[0-9]+\])", "\u0001$1\u0001"), "\u0001"), lambda x: x != "")
    return _rows(t, FIGURES).select("id", F.posexplode(runs).alias("k", "run")).select("id", F.col("k").cast("long").alias("k"), "run", F.regexp_extract("run", r"^\[图([0-9]+)\]$", 1).try_cast("int").alias("slot"))


@query("snippet", "SELECT doc_id, CASE WHEN p > 0 THEN substring(text, greatest(p - 60, 1), p - greatest(p - 60, 1) + 5 + 120) ELSE '' END AS snippet FROM (SELECT doc_id, text, instr(text, ' the ') AS p FROM documents)")
def snippet(t: Tables):
    return t.documents.select("doc_id", text.around(F.col("text"), F.lit(" the ")).alias("snippet"))


@query("text_digest", "SELECT doc_id, left(text, 12) AS head, replace(trim(left(text, 40)), 'th', 'TH') AS swapped, CAST(length(text) AS BIGINT) AS chars, md5(text) AS md5, sha256(text) AS sha, instr(text, 'and') AS at FROM documents")
def text_digest(t: Tables):
    x = F.col("text")
    return t.documents.select("doc_id", F.left(x, F.lit(12)).alias("head"), F.replace(F.trim(F.left(x, F.lit(40))), F.lit("th"), F.lit("TH")).alias("swapped"), F.length(x).cast("long").alias("chars"), F.md5(x).alias("md5"), F.sha2(x, 256).alias("sha"), F.instr(x, "and").cast("long").alias("at"))


@query("file_ext", "SELECT page_id, lower(regexp_extract(p, '\\.([A-Za-z0-9]{1,8})$', 1)) AS ext, regexp_replace(p, '[\\\\/:*?\"<>|]', '_', 'g') AS safe, CASE WHEN length(html) < 2048 THEN length(html) || ' B' ELSE round(length(html) / 1024.0, 1) || ' KB' END AS size FROM (SELECT page_id, html, regexp_replace(url, '[?#].*$', '') AS p FROM pages)")
def file_ext(t: Tables):
    p, n = F.regexp_replace("url", "[?#].*$", ""), F.length("html")
    size = F.when(n < 2048, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(F.round(n / 1024.0, 1).cast("string"), F.lit(" KB")))
    return t.pages.select("page_id", text.extension(p).alias("ext"), text.file_name(p).alias("safe"), size.alias("size"))


SPECS = ["1-3,7", "5", "", "3-1", "1-400", "2，4、6~8", "a", "9 9 9", "1-60", "1-61"]


@query(
    "seq_spec",
    f"""WITH v AS (SELECT id, list_filter(regexp_split_to_array(trim(s), '[,，、;；\\s]+'), lambda x: x <> '') AS p FROM (VALUES {_values(SPECS)}) v(id, s)), e AS (SELECT id, len(p) AS np, unnest(p) AS x FROM v),
    f AS (SELECT *, TRY_CAST(regexp_extract(x, '^(\\d{{1,3}})', 1) AS INTEGER) AS a, coalesce(TRY_CAST(regexp_extract(x, '^\\d{{1,3}}\\s*[-~～]\\s*(\\d{{1,3}})$', 1) AS INTEGER), TRY_CAST(regexp_extract(x, '^(\\d{{1,3}})', 1) AS INTEGER)) AS b, regexp_matches(x, '^\\d{{1,3}}(\\s*[-~～]\\s*\\d{{1,3}})?$') AS m FROM e),
    g AS (SELECT *, coalesce(m AND a >= 1 AND b <= 300 AND a <= b AND b - a < 60, FALSE) AS ok FROM f), n AS (SELECT DISTINCT id, unnest(range(a, b + 1)) AS i FROM g WHERE ok)
    SELECT id, array_to_string(list_sort((SELECT list(i) FROM n WHERE n.id = v.id AND (SELECT bool_and(ok) FROM g WHERE g.id = v.id) AND (SELECT count(*) FROM n n2 WHERE n2.id = v.id) <= 60)), ',') AS seqs FROM v""",
)
def seq_spec(t: Tables):
    return _rows(t, SPECS).select("id", F.array_join(F.transform(text.sequence_spec(F.col("s")), lambda x: x.cast("string")), ",").alias("seqs"))


@query(
    "dice",
    """WITH k AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS k FROM documents), g AS (SELECT doc_id, list_distinct(list_transform(range(1, length(k)), lambda i: substring(k, i, 2))) AS g FROM k WHERE length(k) > 1)
    SELECT a.doc_id, round(2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 6) AS dice FROM g a JOIN g b ON b.doc_id = a.doc_id + 1""",
)
def dice(t: Tables):
    k = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    g = t.documents.where(F.length(k) > 1).select("doc_id", text.letter_pairs(k).alias("g"))
    o = g.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h"))
    return g.join(o, "doc_id").select("doc_id", F.round(text.dice_of_pairs(F.col("g"), F.col("h")), 6).alias("dice"))


@query(
    "coverage",
    """WITH q AS (SELECT item_id, list_distinct(list_transform(range(1, length(k)), lambda i: substring(k, i, 2))) AS q FROM (SELECT item_id, regexp_replace(text, '[^一-龥A-Za-z0-9]', '', 'g') AS k FROM benchmark)), d AS (SELECT doc_id, list_distinct(list_transform(range(1, length(k)), lambda i: substring(k, i, 2))) AS g FROM (SELECT doc_id, regexp_replace(text, '[^一-龥A-Za-z0-9]', '', 'g') AS k FROM documents)),
    h AS (SELECT doc_id, item_id, len(q) AS n, len(list_intersect(q, g)) AS hits FROM d, q WHERE len(q) > 0) SELECT doc_id, item_id, round(hits / n, 6) AS coverage FROM h WHERE 10 * hits >= 9 * n""",
)
def coverage(t: Tables):
    q = t.benchmark.select("item_id", text.bigrams(text.normalised(F.col("text"))).alias("grams"))
    d = t.documents.select("doc_id", text.bigrams(text.normalised(F.col("text"))).alias("grams"))
    return Q.covering(d, "doc_id", q, "item_id", 9, 10).withColumn("coverage", F.round("coverage", 6))


@query(
    "phrase_relevance",
    """WITH q AS (SELECT item_id, list_distinct(list_transform(range(1, length(s) - 2, greatest(1, length(s) // 40)), lambda i: substring(s, i, 4))[1:40]) AS p FROM (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS s FROM benchmark)),
    h AS (SELECT doc_id, item_id, len(p) AS n, len(list_filter(p, lambda x: contains(d.k, x))) AS hits FROM q, (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS k FROM documents) d WHERE len(p) > 0) SELECT doc_id, item_id, round(hits / n, 6) AS relevance FROM h WHERE 2 * hits >= n""",
)
def phrase_relevance(t: Tables):
    s = F.regexp_replace("text", r"\s+", "")
    step = F.greatest(F.lit(1), F.floor(F.length(s) / 40).cast("int"))
    at = F.slice(F.sequence(F.lit(1), F.length(s) - 3, step), 1, 40)
    q = t.benchmark.where(F.length(s) >= 4).select("item_id", F.transform(at, lambda i: F.substring(s, i, F.lit(4))).alias("p"))
    found = patterns.covering(t.documents.select("doc_id", s.alias("k")), "doc_id", "k", q, "item_id", "p", 1, 2)
    return found.select("doc_id", "item_id", F.round(F.col("hits") / F.col("n"), 6).alias("relevance"))


@query("cer", "SELECT c_custkey, round(levenshtein(c_name, n_name) / greatest(length(n_name), 1), 6) AS cer FROM customer JOIN nation ON n_nationkey = c_nationkey")
def cer(t: Tables):
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.customer.join(n, "c_nationkey").select("c_custkey", F.round(F.levenshtein("c_name", "n_name") / F.greatest(F.length("n_name"), F.lit(1)), 6).alias("cer"))


@query(
    "charset_consistency",
    """WITH p AS (SELECT a.p_partkey, regexp_replace(a.p_name || a.p_type, '\\s+', '', 'g') AS x, regexp_replace(b.p_name || b.p_brand, '\\s+', '', 'g') AS y, a.p_size % 3 AS na, b.p_size % 3 AS nb FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    s AS (SELECT *, list_distinct(string_split(x, '')) AS sx, list_distinct(string_split(y, '')) AS sy FROM p)
    SELECT p_partkey, round(CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 THEN 0 ELSE 0.5 * len(list_intersect(sx, sy)) / (len(sx) + len(sy) - len(list_intersect(sx, sy))) + 0.25 * least(na, nb) / greatest(na, nb) + 0.25 * least(length(x), length(y)) / greatest(length(x), length(y)) END, 6) AS score FROM s""",
)
def charset_consistency(t: Tables):
    a = t.part.select("p_partkey", F.regexp_replace(F.concat("p_name", "p_type"), r"\s+", "").alias("x"), (F.col("p_size") % 3).alias("na"))
    b = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.regexp_replace(F.concat("p_name", "p_brand"), r"\s+", "").alias("y"), (F.col("p_size") % 3).alias("nb"))
    sx, sy = text.characters(F.col("x")), text.characters(F.col("y"))
    both = F.size(F.array_intersect(sx, sy))
    ratio = lambda p, q: F.least(p, q) / F.greatest(p, q)
    score = 0.5 * both / (F.size(sx) + F.size(sy) - both) + 0.25 * ratio(F.col("na"), F.col("nb")) + 0.25 * ratio(F.length("x"), F.length("y"))
    none = (F.col("na") == 0) & (F.col("nb") == 0)
    one = (F.col("na") == 0) | (F.col("nb") == 0)
    return a.join(b, "p_partkey").select("p_partkey", F.round(F.when(none, 1.0).when(one, 0.0).otherwise(score), 6).alias("score"))


@query(
    "cosine_topk",
    """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 5) AS cosine FROM embeddings, q WHERE vec_id <> 0 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) DESC, vec_id LIMIT 10""",
)
def cosine_topk(t: Tables):
    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = v.where("vec_id = 0").select(F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cos = dot(F.col("v"), F.col("q")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("q"), F.col("q")))
    return v.where("vec_id <> 0").join(F.broadcast(q)).select("vec_id", cos.alias("c")).orderBy(F.desc("c"), "vec_id").limit(10).select("vec_id", F.round("c", 5).alias("cosine"))


@query("fingerprint", "SELECT doc_id, sha256(doc_id || chr(1) || coalesce(lang, '') || chr(1) || coalesce(text, '') || chr(1) || 'v1') AS fingerprint, sha256(coalesce(text, '')) AS revision FROM documents")
def fingerprint(t: Tables):
    fields = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("doc_id"), F.col("lang"), F.col("text"), F.lit("v1"))]
    return t.documents.select("doc_id", F.sha2(F.concat_ws("\u0001", *fields), 256).alias("fingerprint"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("revision"))


@query("dedupe_key", "SELECT event_id, sha256(user_id || '|' || event_type || '|' || props) AS key FROM events")
def dedupe_key(t: Tables):
    return t.events.select("event_id", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props"), 256).alias("key"))


CAUSES = [("", "3"), ("x", ""), ("-3", "3"), ("x=11", "x=10"), ("5", "50"), ("移项错误", "移项正确"), ("不会做题", "先配方后开方"), ("方程无解答案", "方程无解因为")]


@query(
    "error_cause",
    f"""WITH v AS (SELECT id, trim(w) AS w, trim(k) AS k, TRY_CAST(regexp_extract_all(w, '-?[0-9]+(\\.[0-9]+)?')[-1] AS DOUBLE) AS wn, TRY_CAST(regexp_extract_all(k, '-?[0-9]+(\\.[0-9]+)?')[-1] AS DOUBLE) AS kn FROM (VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(CAUSES, 1))}) v(id, w, k)),
    g AS (SELECT *, list_distinct(list_transform(range(1, length(w)), lambda i: substring(w, i, 2))) AS gw, list_distinct(list_transform(range(1, length(k)), lambda i: substring(k, i, 2))) AS gk FROM v), d AS (SELECT *, coalesce(2.0 * len(list_intersect(gw, gk)) / nullif(len(gw) + len(gk), 0), 0) AS dice FROM g)
    SELECT id, CASE WHEN w = '' AND k <> '' THEN 'no-answer' WHEN k = '' THEN 'unscored' WHEN wn IS NOT NULL AND kn IS NOT NULL THEN CASE WHEN sign(wn) <> sign(kn) AND wn <> 0 AND kn <> 0 THEN 'careless-sign' WHEN kn <> 0 AND abs(wn / kn) > 0.82 AND abs(wn / kn) < 1.22 THEN 'careless-calc' ELSE 'concept-mix' END
    WHEN dice > 0.5 THEN 'misread' WHEN dice > 0.22 THEN 'concept-mix' ELSE 'method-step' END AS cause FROM d""",
)
def error_cause(t: Tables):
    rows = t.literal("id int, w string, k string", [(i, a, b) for i, (a, b) in enumerate(CAUSES, 1)])
    w, k = F.trim("w"), F.trim("k")
    last = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1), F.lit(-1)).try_cast("double")
    wn, kn = last(w), last(k)
    dice_ = F.coalesce(text.dice(text.bigrams(w), text.bigrams(k)), F.lit(0.0))
    ratio = F.abs(wn / F.nullif(kn, F.lit(0.0)))
    cause = (
        F.when((w == "") & (k != ""), "no-answer").when(k == "", "unscored")
        .when(wn.isNotNull() & kn.isNotNull(), F.when((F.signum(wn) != F.signum(kn)) & (wn != 0) & (kn != 0), "careless-sign").when((ratio > 0.82) & (ratio < 1.22), "careless-calc").otherwise("concept-mix"))
        .when(dice_ > 0.5, "misread").when(dice_ > 0.22, "concept-mix").otherwise("method-step")
    )
    return rows.select("id", cause.alias("cause"))


ROMANS = ["Ⅲ", "ⅠⅠ", "IL", "II", "11", "111", "IV", "XII", "VIII", "XX", "abc", "", "ll", "iv"]


@query(
    "roman",
    f"""WITH v AS (SELECT id, s, replace(upper(s), 'L', 'I') AS u FROM (VALUES {_values(ROMANS)}) v(id, s)), r(w, n) AS (VALUES ('I', 1), ('II', 2), ('III', 3), ('IV', 4), ('V', 5), ('VI', 6), ('VII', 7), ('VIII', 8), ('IX', 9), ('X', 10), ('XI', 11), ('XII', 12))
    SELECT id, CAST(CASE WHEN regexp_matches(s, '^[Ⅰ-Ⅹ]+$') THEN list_sum(list_transform(string_split(s, ''), lambda x: instr('ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ', x))) WHEN regexp_matches(s, '^[ILil]{{2}}$') AND regexp_matches(s, '[Ll]') THEN 3 WHEN regexp_matches(s, '^[Ii]{{2}}$') THEN 2 WHEN regexp_matches(s, '^1[il1]?$') THEN CASE WHEN length(s) = 3 THEN 3 ELSE 2 END ELSE r.n END AS INTEGER) AS num FROM v LEFT JOIN r ON r.w = u""",
)
def roman(t: Tables):
    return _rows(t, ROMANS).select("id", text.roman(F.col("s")).alias("num"))


@query("map_explode", "SELECT event_id, key, CAST(json_extract_string(props, '$.' || key) AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def map_explode(t: Tables):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


GUARDED = ["已知三角形ABC中AB等于6，BC等于8，求三角形ABC的面积是多少", "太短", "一段没有信号的文字一段没有信号的文字一段没有信号的文字", "1. 求x的值是多少呢\n2. 求y的值是多少呢求y的值是多少呢", "长" * 1201, "下列说法正确的是（　）A. 甲 B. 乙 C. 丙 D. 丁 共四个选项"]


@query(
    "input_guard",
    f"""SELECT id, CASE WHEN length(s) > 1200 THEN 'too_long' WHEN len(regexp_extract_all(s, '(^|\\n)[ \\t]*([（(]\\s*[）)]\\s*)?(([（(]\\s*)?\\d{{1,3}}\\s*[）)]|\\d{{1,3}}\\s*[．.、]|\\d{{1,3}}\\s*[)）])[ \\t]*')) > 1 THEN 'multi_item' WHEN length(s) < 25 OR NOT (regexp_matches(s, '{text.ASK_HINT}') OR regexp_matches(s, '_{{3,}}|（\\s*）|\\(\\s*\\)')) THEN 'not_a_question' ELSE '' END AS reason FROM (VALUES {_values(GUARDED)}) v(id, s)""",
)
def input_guard(t: Tables):
    return _rows(t, GUARDED).select("id", text.input_guard(F.col("s")).alias("reason"))


@query(
    "quality_gate",
    """SELECT doc_id, CASE WHEN avg_len < 12 THEN 'short' WHEN ratio < 0.15 THEN 'noise' WHEN conf < 0.6 THEN 'confidence' ELSE 'ok' END AS reason FROM (SELECT doc_id, length(text) / len(string_split(text, chr(10))) AS avg_len, length(regexp_replace(text, '[^a-z]', '', 'g')) / greatest(length(text), 1) AS ratio, (doc_id % 10) / 10.0 AS conf FROM documents)""",
)
def quality_gate(t: Tables):
    x = F.col("text")
    mean, ratio, conf = F.length(x) / F.size(F.split(x, "\n")), F.length(F.regexp_replace(x, "[^a-z]", "")) / F.greatest(F.length(x), F.lit(1)), (F.col("doc_id") % 10) / 10.0
    return t.documents.select("doc_id", F.when(mean < 12, "short").when(ratio < 0.15, "noise").when(conf < 0.6, "confidence").otherwise("ok").alias("reason"))


QUESTIONS = ["如图，在平行四边形ABCD中，AB=6，BC=10，角B为60度，点M在BC上，求三角形ABM的面积", "The tsunami swept through the village quickly", "已知函数y=2x+3的图像经过点P12，求k的值", "BMDN是菱形，求证四边形BMDN的对角线互相垂直"]
TOPICS = ["平行四边形", "三角形", "函数", "菱形"]


@query(
    "anchors",
    f"""WITH v AS (SELECT id, regexp_replace(s, '[^一-龥A-Za-z0-9]', '', 'g') AS q FROM (VALUES {_values(QUESTIONS)}) v(id, s)), w AS (SELECT id, q, list_distinct_ordered FROM (SELECT id, q, list_transform(range(1, length(q) - 4, 3), lambda i: substring(q, i, 6)) AS l FROM v) x, LATERAL (SELECT list(u ORDER BY k) AS list_distinct_ordered FROM (SELECT u, min(k) AS k FROM (SELECT unnest(l) AS u, generate_subscripts(l, 1) AS k) WHERE NOT regexp_matches(u, '^({"|".join(Q.NOISE)})') AND NOT regexp_matches(u, '^[0-9]+$|^[A-Za-z]+$') AND NOT list_contains([{", ".join(f"contains(u, '{x}') AND 6 - {len(x)} <= 2" for x in TOPICS)}], TRUE) GROUP BY u))),
    n AS (SELECT id, list_concat(coalesce(list_distinct_ordered, [])[1:12], regexp_extract_all(q, '[0-9]{{2,}}|[A-Za-z]?[0-9]+[A-Za-z一-龥]')) AS a, regexp_extract_all(q, '[A-Z]{{2,4}}') AS caps FROM w), d AS (SELECT id, (SELECT list(u ORDER BY k) FROM (SELECT u, min(k) AS k FROM (SELECT unnest(a) AS u, generate_subscripts(a, 1) AS k) WHERE length(u) >= 2 GROUP BY u)) AS a, caps FROM n)
    SELECT id, coalesce(array_to_string((SELECT list(u ORDER BY k) FROM (SELECT u, min(k) AS k FROM (SELECT unnest(list_concat(coalesce(a, [])[1:18], caps)) AS u, generate_subscripts(list_concat(coalesce(a, [])[1:18], caps), 1) AS k) GROUP BY u)), '|'), '') AS anchors FROM d""",
)
def anchors(t: Tables):
    return _rows(t, QUESTIONS).select("id", F.array_join(Q.anchors(F.col("s"), TOPICS), "|").alias("anchors"))


@query("recall_keys")
def recall_keys(t: Tables):
    return _rows(t, QUESTIONS).select("id", F.array_join(Q.recall_keys(F.col("s"), TOPICS), "|").alias("keys"))


@query("recall_anchors")
def recall_anchors(t: Tables):
    return _rows(t, QUESTIONS).select("id", F.array_join(Q.recall_anchors(F.col("s"), Q.anchors(F.col("s"), TOPICS)), "|").alias("picked"))
