"""Whole rules over the driver's tables: stored objects, folders, handwriting, recall of lines and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, layout, relational
from ..operators import retrieval as Q
from ..registry import Tables, query
from ..streaming import rules
from .layout import _KINDS, _kinds
from .retrieval import _JUDGED, _judged

_VERSION = "v1"
# The start of a next question inside a solution, without look-ahead.
_BOUNDARY = r"\n[ \t]*(?:【\s*例\s*\d+\s*】|【\s*练习\s*\d+\s*】|(?:问题|演练)\s*[一二三四五六七八九十\d]+\s*[:：.．]|\d{1,3}\s*(?:[．、]|\.(?:[^\d]|$)))"


@query(
    "validate_stored",
    f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'v0' ELSE 'v1' END AS engine, CASE WHEN doc_id % 13 = 0 THEN 'rejected' ELSE 'ok' END AS status, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE md5(text) END AS revision, md5(text) AS now_rev, CASE WHEN doc_id % 7 = 0 THEN '' ELSE string_split(text, chr(10))[1] END AS stem, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE 0 END AS c0, n_chars AS c1, CASE WHEN doc_id % 3 = 0 THEN n_chars + 5 ELSE 30 END AS s1,
    doc_id % 4 <> 0 AS has, CASE WHEN doc_id % 23 < 3 THEN 'as above' || chr(10) || ' 12. prove that' WHEN doc_id % 23 < 5 THEN 'as above' || chr(10) || '1.25 of it' ELSE left(text, 200) END AS solution FROM documents),
    p AS (SELECT *, sha256(concat_ws(chr(1), CAST(doc_id AS VARCHAR), '0', '1.', CAST(c0 AS VARCHAR), CAST(c1 AS VARCHAR), '0', CAST(s1 AS VARCHAR), stem, solution, CASE WHEN has THEN '1' ELSE '0' END, 'v1')) AS f FROM s)
    SELECT doc_id, CASE WHEN engine <> 'v1' THEN 'engine' WHEN status <> 'ok' THEN 'status' WHEN revision <> now_rev THEN 'revision' WHEN (CASE WHEN doc_id % 19 = 0 THEN 'x' ELSE '' END) || f <> f THEN 'fingerprint' WHEN trim(stem) = '' THEN 'stem' WHEN c0 < 0 OR c1 <= c0 THEN 'range' WHEN s1 < 0 OR s1 > c1 THEN 'stem_range' WHEN has AND regexp_matches(solution, '{_BOUNDARY}') THEN 'boundary' ELSE '' END AS reason FROM p""",
)
def validate_stored(t: Tables):
    i, n = F.col("doc_id"), F.col("n_chars")
    stem = F.when(i % 7 == 0, "").otherwise(F.split("text", "\n")[0])
    c0, s1 = F.when(i % 5 == 0, -1).otherwise(0), F.when(i % 3 == 0, n + 5).otherwise(30)
    solution = F.when(i % 23 < 3, "as above\n 12. prove that").when(i % 23 < 5, "as above\n1.25 of it").otherwise(F.substring("text", 1, 200))
    has, version = i % 4 != 0, F.lit(_VERSION)
    mark = Q.object_fingerprint(version, i, F.lit(0), F.lit("1."), c0, n, F.lit(0), s1, stem, solution, has.cast("int"))
    x = t.documents.select("doc_id", "n_chars", "text", mark.alias("mark"))
    kept = F.concat(F.when(i % 19 == 0, "x").otherwise(""), F.col("mark"))
    reason = Q.stored_reason(
        F.when(i % 17 == 0, "v0").otherwise("v1"), version, F.when(i % 13 == 0, "rejected").otherwise("ok"), F.when(i % 11 == 0, "old").otherwise(F.md5("text")), F.md5("text"), kept, F.col("mark"), stem, c0, n, F.lit(0), s1, has, solution
    )
    return x.select("doc_id", reason.alias("reason"))


@query(
    "judge_stored",
    f"""WITH {_JUDGED}, s AS (SELECT *, TRUE AS structured FROM r WHERE object_id % 2 = 1 AND object_id // 10 % 10 < 3), u AS (SELECT * FROM s UNION ALL SELECT *, FALSE FROM r WHERE object_id % 2 = 0 AND question NOT IN (SELECT question FROM s)),
    o AS (SELECT *, row_number() OVER w AS rn, lead(reason) OVER w AS nr, lead(hit) OVER w AS nh, lead(ratio) OVER w AS nq FROM u WINDOW w AS (PARTITION BY question ORDER BY CASE WHEN reason = '' THEN 0 ELSE 1 END, hit DESC, ratio DESC, solution_chars DESC, object_id))
    SELECT question, object_id, structured, CASE WHEN reason = '' AND coalesce(nr = '' AND nh = hit AND nq = ratio, FALSE) THEN 'not_unique' ELSE reason END AS reason, reason = '' AND NOT coalesce(nr = '' AND nh = hit AND nq = ratio, FALSE) AS exact FROM o WHERE rn = 1""",
)
def judge_stored(t: Tables):
    rows, k = _judged(t), F.col("object_id")
    stored = rows.where((k % 2 == 1) & (F.floor(k / 10) % 10 < 3)).withColumn("structured", F.lit(True))
    live = rows.where(k % 2 == 0).withColumn("structured", F.lit(False))
    return Q.unique(Q.stored_or_live(stored, live, "question"), "question").select("question", "object_id", "structured", "reason", "exact")


@query(
    "similarity_score",
    """WITH k AS (SELECT doc_id, list_distinct(list_transform(range(1, length(k)), lambda i: substring(k, i, 2))) AS g, CASE WHEN doc_id % 5 = 0 THEN [] ELSE list_filter([lang, source, left(text, 1)], lambda x: x IS NOT NULL) END AS tags FROM (SELECT *, regexp_replace(lower(text), '[^a-z]', '', 'g') AS k FROM documents) WHERE length(k) > 1),
    p AS (SELECT a.doc_id, 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) AS d, a.tags AS x, b.tags AS y FROM k a JOIN k b ON b.doc_id = a.doc_id + 1)
    SELECT doc_id, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN 0.7 * d + 0.3 * 2.0 * len(list_intersect(x, y)) / (len(list_distinct(x)) + len(list_distinct(y))) ELSE d END, 6) AS score FROM p""",
)
def similarity_score(t: Tables):
    k = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    tags = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.array("lang", "source", F.substring("text", 1, 1))))
    g = t.documents.where(F.length(k) > 1).select("doc_id", text.letter_pairs(k).alias("g"), tags.alias("tags"))
    o = g.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h"), F.col("tags").alias("other"))
    return g.join(o, "doc_id").select("doc_id", F.round(text.similarity(text.dice_of_pairs(F.col("g"), F.col("h")), F.col("tags"), F.col("other")), 6).alias("score"))


@query(
    "number_recall",
    """WITH d AS (SELECT doc_id, text || ' 3.5 and ' || CAST(n_chars AS VARCHAR) AS ref, replace(text, '1', 'l') || ' 3.5' AS hyp FROM documents), n AS (SELECT doc_id, regexp_extract_all(ref, '\\d+(?:\\.\\d+)?') AS n, regexp_replace(hyp, '\\s+', '', 'g') AS h FROM d)
    SELECT doc_id, CAST(len(n) AS BIGINT) AS total, CAST(len(list_filter(n, lambda x: contains(h, x))) AS BIGINT) AS hit FROM n""",
)
def number_recall(t: Tables):
    total, hit = text.number_recall(F.concat("text", F.lit(" 3.5 and "), F.col("n_chars").cast("string")), F.concat(F.replace("text", F.lit("1"), F.lit("l")), F.lit(" 3.5")))
    return t.documents.select("doc_id", total.cast("long").alias("total"), hit.cast("long").alias("hit"))


@query(
    "line_recall",
    """WITH p AS (SELECT p_partkey, replace(p_name, ' ', '') AS a, replace(p_type, ' ', '') AS b, replace(replace(p_name, 'a', 'e'), ' ', '') || replace(p_brand, ' ', '') || replace(left(p_type, 9), ' ', '') AS h FROM part), l AS (SELECT p_partkey, unnest([a, b]) AS x, h FROM p), n AS (SELECT *, length(x) AS n FROM l WHERE x <> ''),
    w AS (SELECT *, unnest(range(greatest(1, CAST(floor(n * 0.75) AS BIGINT)), least(length(h), CAST(ceil(n * 1.4) AS BIGINT)) + 1, greatest(1, n // 6))) AS w FROM n), c AS (SELECT p_partkey, x, n, h, w, unnest(range(1, length(h) - w + 2)) AS i FROM w), e AS (SELECT p_partkey, x, min(levenshtein(x, substring(h, i, w)) / CAST(n AS DOUBLE)) AS err FROM c GROUP BY 1, 2)
    SELECT p_partkey, count(*) AS total, count(*) FILTER (WHERE contains(n.h, n.x) OR coalesce(e.err, 1) <= 0.25) AS hit FROM n LEFT JOIN e USING (p_partkey, x) GROUP BY 1""",
)
def line_recall(t: Tables):
    read = F.concat(F.replace("p_name", F.lit("a"), F.lit("e")), "p_brand", F.substring("p_type", 1, 9))
    total, hit = text.line_recall(F.concat("p_name", F.lit("\n"), "p_type"), read)
    return t.part.select("p_partkey", total.cast("long").alias("total"), hit.cast("long").alias("hit"))


_SECTIONED = ["一6,二5,二6,二16,二22", "（一）6,(二)5", "一、6-8", "3", "一6,3", "一6，二a", "", "二 1-60", "二1-61", "一9-3", "一0", "十：301", "一1;二2；三3 4"]


@query(
    "seq_sections",
    """WITH v(id, s) AS (VALUES """ + ", ".join(f"({k}, '{x}')" for k, x in enumerate(_SECTIONED, 1)) + f"""), b AS (SELECT id, regexp_replace(trim(s), '([（(]?[一二三四五六七八九十][)）]?)\\s*[、.．:：]\\s*(\\d)', '\\1\\2', 'g') AS s FROM v),
    p AS (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS k FROM (SELECT id, list_filter(regexp_split_to_array(s, '[,，、;；\\s]+'), lambda x: x <> '') AS l FROM b)), m AS (SELECT *, regexp_matches(x, '{text.SECTION_ITEM}') AS named FROM p),
    i AS (SELECT id, k, CASE WHEN named THEN regexp_extract(x, '{text.SECTION_ITEM}', 1) || regexp_extract(x, '{text.SECTION_ITEM}', 2) END AS section, TRY_CAST(CASE WHEN named THEN regexp_extract(x, '{text.SECTION_ITEM}', 3) ELSE regexp_extract(x, '{text.PLAIN_ITEM}', 1) END AS INTEGER) AS a, TRY_CAST(CASE WHEN named THEN regexp_extract(x, '{text.SECTION_ITEM}', 4) ELSE regexp_extract(x, '{text.PLAIN_ITEM}', 2) END AS INTEGER) AS b0 FROM m),
    f AS (SELECT *, coalesce(b0, a) AS b, coalesce(a >= 1 AND coalesce(b0, a) <= 300 AND a <= coalesce(b0, a) AND coalesce(b0, a) - a < 60, FALSE) AS fine FROM i), g AS (SELECT id, bool_and(fine) AND bool_or(section IS NOT NULL) AND coalesce(sum(CASE WHEN fine THEN b - a + 1 END), 0) <= 60 AS ok FROM f GROUP BY 1),
    n AS (SELECT f.id, f.k, f.section, unnest(range(a, b + 1)) AS label FROM f JOIN g ON g.id = f.id AND g.ok) SELECT v.id, string_agg(coalesce(n.section, '') || n.label, ',' ORDER BY n.k, n.label) AS refs FROM v LEFT JOIN n ON n.id = v.id GROUP BY 1""",
)
def seq_sections(t: Tables):
    rows = t.literal("id int, s string", list(enumerate(_SECTIONED, 1)))
    labels = F.transform(text.sectioned_spec(F.col("s")), lambda x: F.concat(F.coalesce(x["section"], F.lit("")), x["label"].cast("string")))
    return rows.select("id", F.array_join(labels, ",").alias("refs"))


_FOLDERS = "n AS (SELECT p_partkey AS id, CASE WHEN p_partkey <= 1 THEN NULL ELSE p_partkey // 2 END AS parent FROM part)"


def _folders(t: Tables):
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), F.when(k > 1, F.floor(k / 2)).alias("parent"))


@query(
    "folder_moves",
    f"""WITH RECURSIVE {_FOLDERS}, up(node, ancestor, depth) AS (SELECT id, id, 0 FROM n UNION ALL SELECT node, n.parent, depth + 1 FROM up JOIN n ON n.id = up.ancestor WHERE n.parent IS NOT NULL), m AS (SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN p_partkey WHEN p_size % 10 = 1 THEN NULL WHEN p_size % 10 < 5 THEN p_partkey * 2 + p_size % 2 ELSE p_size * 61 END AS target FROM part)
    SELECT m.id, m.target, CASE WHEN target = m.id THEN 'self' WHEN target IS NULL THEN '' WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.id = m.target) THEN 'missing' WHEN EXISTS (SELECT 1 FROM up WHERE up.node = m.target AND up.ancestor = m.id) THEN 'cycle' ELSE '' END AS reason FROM m""",
)
def folder_moves(t: Tables):
    k, s = F.col("p_partkey"), F.col("p_size")
    target = F.when(s % 10 == 0, k).when(s % 10 == 1, F.lit(None)).when(s % 10 < 5, k * 2 + s % 2).otherwise((s * 61).cast("long"))
    return graph.moves(_folders(t), t.part.select(k.alias("id"), target.alias("target")), "id", "parent")


@query(
    "folder_lift",
    f"""WITH RECURSIVE {_FOLDERS}, up(node, ancestor, depth) AS (SELECT id, id, 0 FROM n UNION ALL SELECT node, n.parent, depth + 1 FROM up JOIN n ON n.id = up.ancestor WHERE n.parent IS NOT NULL), x AS (SELECT node, arg_min(ancestor, depth) AS parent FROM up WHERE depth > 0 AND ancestor % 3 <> 0 GROUP BY 1)
    SELECT n.id, x.parent FROM n LEFT JOIN x ON x.node = n.id WHERE n.id % 3 <> 0""",
)
def folder_lift(t: Tables):
    return graph.lifted(_folders(t), t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id")), "id", "parent")


@query(
    "block_merge",
    """WITH RECURSIVE b AS (SELECT CAST(p_partkey // 40 AS BIGINT) AS page, p_size % 3 AS col, p_partkey AS id, p_size % 3 * 100 AS x0, p_size // 8 * 30 + p_partkey % 4 AS y0, p_size % 3 * 100 + p_partkey % 70 + 5 AS x1, p_size // 8 * 30 + 25 + p_partkey % 5 AS y1 FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY page, col ORDER BY y0, id) AS r FROM b),
    f(page, col, r, block, parts, x0, y0, x1, y1) AS (SELECT page, col, r, id, 1, x0, y0, x1, y1 FROM o WHERE r = 1 UNION ALL SELECT page, col, r, CASE WHEN j THEN block ELSE id END, CASE WHEN j THEN parts + 1 ELSE 1 END, CASE WHEN j THEN least(fx0, x0) ELSE x0 END, CASE WHEN j THEN least(fy0, y0) ELSE y0 END, CASE WHEN j THEN greatest(fx1, x1) ELSE x1 END, CASE WHEN j THEN greatest(fy1, y1) ELSE y1 END
    FROM (SELECT o.page, o.col, o.r, o.id, o.x0, o.y0, o.x1, o.y1, f.block, f.parts, f.x0 AS fx0, f.y0 AS fy0, f.x1 AS fx1, f.y1 AS fy1, coalesce((least(f.y1, o.y1) - greatest(f.y0, o.y0) + 1) / CAST(greatest(f.y1, o.y1) - least(f.y0, o.y0) + 1 AS DOUBLE) >= 0.85, FALSE) AS j FROM f JOIN o ON o.page = f.page AND o.col = f.col AND o.r = f.r + 1))
    SELECT page, col, block, max(parts) AS parts, arg_max(x0, parts) AS x0, arg_max(y0, parts) AS y0, arg_max(x1, parts) AS x1, arg_max(y1, parts) AS y1 FROM f GROUP BY 1, 2, 3""",
)
def block_merge(t: Tables):
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = s % 3 * 100, F.floor(s / 8) * 30
    b = t.part.select(F.floor(k / 40).alias("page"), (s % 3).cast("long").alias("col"), k.alias("id"), x.cast("long").alias("x0"), (y + k % 4).alias("y0"), (x + k % 70 + 5).alias("x1"), (y + 25 + k % 5).alias("y1"))
    return layout.merged_blocks(b, ["page", "col"], 0.85)


_CLUSTERS = f"""{_KINDS}, b AS (SELECT *, 12 + page % 3 * 4 AS h FROM k WHERE kind <> 'underline'), e AS (SELECT p.page, p.id AS u, q.id AS v FROM b p JOIN b q ON p.page = q.page AND p.x0 - p.h <= q.x1 AND q.x0 - p.h <= p.x1 AND p.y0 - p.h <= q.y1 AND q.y0 - p.h <= p.y1),
    reach(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v), c AS (SELECT u AS id, min(v) AS cluster FROM reach GROUP BY 1),
    g AS (SELECT page, cluster, count(*) AS parts, CAST(sum(n) AS BIGINT) AS ink, CAST(coalesce(sum(n) FILTER (WHERE greatest(x1 - x0, y1 - y0) + 1 >= 2.2 * h), 0) AS BIGINT) AS long_ink, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(h) AS h FROM b JOIN c USING (id) GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(n) >= floor(0.8 * min(h) * min(h) + 0.5))"""


def _clusters(t: Tables):
    return layout.writing_clusters(_kinds(t).withColumn("h", 12 + F.col("page") % 3 * 4), "page", "h")


@query("mark_clusters", f"WITH RECURSIVE {_CLUSTERS} SELECT page, cluster, parts, ink, long_ink, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM g")
def mark_clusters(t: Tables):
    return _clusters(t).drop("h")


@query(
    "cluster_verdict",
    f"""WITH RECURSIVE {_CLUSTERS}, d AS (SELECT *, ink / CAST(greatest(1, (x1 - x0 + 1) * (y1 - y0 + 1)) AS DOUBLE) AS density, long_ink / CAST(greatest(1, ink) AS DOUBLE) AS lines, parts >= 8 OR ink >= 2 * h * h AS strong FROM g), w AS (SELECT *, NOT strong AND (parts < 5 OR density < 0.01 OR density > 0.35) AS weak FROM d)
    SELECT page, cluster, 'wrong' AS verdict, CASE WHEN strong THEN CASE WHEN lines > 0.7 THEN 0.78 ELSE 0.9 END WHEN weak THEN 0.6 ELSE 0.78 END AS confidence, weak OR (lines > 0.85 AND NOT strong) AS suspect FROM w""",
)
def cluster_verdict(t: Tables):
    return layout.cluster_verdict(_clusters(t), "h").select("page", "cluster", "verdict", "confidence", "suspect")


@query("guarded_delete", "WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice < 60000) AS d FROM orders) SELECT o_orderkey FROM orders, s WHERE d > 0.5 * n OR d = n OR NOT coalesce(o_totalprice < 60000, FALSE)")
def guarded_delete(t: Tables):
    return relational.guarded_delete(t.orders.select("o_orderkey", "o_totalprice"), F.col("o_totalprice") < 60000).select("o_orderkey")


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS began, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS ended, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(t: Tables):
    """Sessions of a user: events no more than six hours apart; the plan of the stream, over the whole table."""
    x, shown = rules.sessions(t.events, "6 hours"), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return x.select("user_id", shown("start").alias("began"), shown("end").alias("ended"), "n")
