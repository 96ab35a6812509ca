"""Recall, gates and choices over documents and benchmark items, caches and retention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import retrieval as Q
from ..operators.patterns import containing
from ..registry import Tables, query

_KEYS = """k AS (SELECT item_id AS question, unnest(list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) >= 9 AND NOT regexp_matches(w, '[^a-z]')))[1:6]) AS k FROM benchmark),
hit AS (SELECT question, doc_id, count(*) FILTER (WHERE contains(string_split(text, chr(10))[1], k)) AS name_hits, count(*) FILTER (WHERE contains(text, k)) AS text_hits FROM documents JOIN k ON contains(text, k) GROUP BY 1, 2),
sized AS (SELECT question, count(*) AS n FROM k GROUP BY 1), scored AS (SELECT question, doc_id, name_hits, text_hits, name_hits + 2 * text_hits AS key_hits, round((name_hits + 2 * text_hits) / (3.0 * n), 3) AS score, row_number() OVER (PARTITION BY question ORDER BY name_hits + 2 * text_hits DESC, text_hits DESC, doc_id) AS rank FROM hit JOIN sized USING (question))"""

_KEYS = _KEYS.replace("list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) >= 9 AND NOT regexp_matches(w, '[^a-z]')))[1:6]", "list_sort(list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) >= 9 AND NOT regexp_matches(w, '[^a-z]'))))[1:6]")


def _recalled(t: Tables, top: int):
    words = F.slice(F.array_sort(F.array_distinct(F.filter(F.split("text", " "), lambda w: (F.length(w) >= 9) & ~w.rlike("[^a-z]")))), 1, 6)
    keys = t.benchmark.select(F.col("item_id").alias("question"), F.explode(words).alias("k"), F.lit(True).alias("in_name"), F.lit(True).alias("in_text"))
    docs = t.documents.select("doc_id", F.split("text", "\n")[0].alias("name"), "text")
    return Q.recall(keys, docs, "name", "text", "doc_id", top)


@query("recall_dual", f"WITH {_KEYS} SELECT question, doc_id, name_hits, text_hits, key_hits, score FROM scored WHERE rank <= 300")
def recall_dual(t: Tables):
    return _recalled(t, 300).select("question", "doc_id", "name_hits", "text_hits", "key_hits", "score")


@query("recall_topn", f"WITH {_KEYS} SELECT question, doc_id, rank FROM scored WHERE rank <= 8")
def recall_topn(t: Tables):
    return _recalled(t, 8).select("question", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(
    "references_topk",
    """WITH w AS (SELECT doc_id, lang, n_chars, list_distinct(list_filter(string_split(text, ' '), lambda x: length(x) >= 8)) AS s FROM documents WHERE n_chars >= 60), b AS (SELECT item_id, list_distinct(list_filter(string_split(text, ' '), lambda x: length(x) >= 8)) AS q, text FROM benchmark),
    p AS (SELECT item_id, doc_id, lang, n_chars, len(list_intersect(q, s)) AS shared FROM b JOIN w ON TRUE), r AS (SELECT *, row_number() OVER (PARTITION BY item_id, lang ORDER BY shared DESC, n_chars DESC, doc_id) AS a FROM p WHERE shared >= 3), m AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, n_chars DESC, doc_id) AS rank FROM r WHERE a <= 3)
    SELECT item_id, rank, doc_id, CAST(shared AS BIGINT) AS shared FROM m WHERE rank <= 3""",
)
def references_topk(t: Tables):
    long_words = F.array_distinct(F.filter(F.split("text", " "), lambda x: F.length(x) >= 8))
    q = t.benchmark.select("item_id", F.explode(long_words).alias("w"))
    # the shared words are found by a join on the word, not by comparing every question with every document
    d = t.documents.where("n_chars >= 60").select("doc_id", "lang", "n_chars", F.explode(long_words).alias("w"))
    p = d.join(q, "w").groupBy("item_id", "doc_id", "lang", "n_chars").agg(F.count("*").alias("shared")).where("shared >= 3")
    order = [F.desc("shared"), F.desc("n_chars"), F.col("doc_id")]
    r = p.withColumn("a", F.row_number().over(Window.partitionBy("item_id", "lang").orderBy(*order))).where("a <= 3")
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)).cast("long")).where("rank <= 3").select("item_id", "rank", "doc_id", "shared")


SHEETS = [
    (1, "专题一\n1．求x的值【答案】x=3\n【解析】移项得到x=3即可\n2．求y的面积\n【解析】面积等于长乘宽所以是六"),
    (2, "1.18 2.5 表格\n2.5 3.6"),
    (3, "【例 1】已知AB=6\n解：因为AB=6所以结论成立\n【练习 2】求证"),
    (4, "问题一：是否存在点P\n答案：存在点P使得成立"),
]


def _sheets(t: Tables):
    return t.literal("sheet int, body string", SHEETS)


@query("split_objects")
def split_objects(t: Tables):
    return Q.objects(_sheets(t), "sheet", "body").select("sheet", "object_index", "label", "stem", "solution")


@query("solution_section")
def solution_section(t: Tables):
    x = _sheets(t).withColumn("wanted", F.array(F.lit("面积等于长乘"), F.lit("移项得到")))
    return Q.solution_section(x, "sheet", "body", "wanted")


_TERMS = {"light": ["the", "that"], "heavy": ["tion", "ment"], "umlaut": ["ung", "keit"], "tilde": ["ción"]}


@query(
    "keyword_tags",
    """WITH lex(tag, pos, k) AS (VALUES ('light', 1, 'the'), ('light', 2, 'that'), ('heavy', 1, 'tion'), ('heavy', 2, 'ment'), ('umlaut', 1, 'ung'), ('umlaut', 2, 'keit'), ('tilde', 1, 'ción')),
    hit AS (SELECT doc_id, tag, arg_min(1 + least(2, length(k) / 3.0), pos) AS weight FROM documents JOIN lex ON contains(text, k) GROUP BY 1, 2)
    SELECT doc_id, tag, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, tag) AS rank FROM hit) WHERE rank <= 3""",
)
def keyword_tags(t: Tables):
    # each tag's first word that the text holds weighs by its length; the lexicon is part of the expression
    of = lambda ks: F.coalesce(*(F.when(F.contains("text", F.lit(k)), F.lit(1 + min(2.0, len(k) / 3.0))) for k in ks))
    tags = F.array(*(F.struct(F.lit(tag).alias("tag"), of(ks).alias("weight")) for tag, ks in _TERMS.items()))
    hit = t.documents.select("doc_id", F.inline(F.filter(tags, lambda x: x["weight"].isNotNull())))
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "tag")
    return hit.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("doc_id", "tag", "rank")


_JUDGED = """j AS (SELECT l_orderkey AS question, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS object_id, CAST(l_quantity AS INTEGER) % 9 + 2 AS total, l_partkey % 9 AS hit0, CAST(l_extendedprice AS INTEGER) % 7000 AS stem_chars, CASE l_suppkey % 4 WHEN 0 THEN 'conflict' WHEN 1 THEN 'unknown' ELSE 'same' END AS ask, l_linestatus = 'F' AND l_partkey % 5 = 0 AS crosses, l_returnflag <> 'R' AS has_solution, CAST(l_quantity AS INTEGER) % 30 AS solution_chars FROM lineitem),
g AS (SELECT *, least(hit0, total) AS hit, round(least(hit0, total) / CAST(total AS DOUBLE), 6) AS ratio FROM j), r AS (SELECT *, CASE WHEN total < 3 THEN 'few_anchors' WHEN stem_chars > 6000 THEN 'too_long' WHEN ask = 'conflict' THEN 'ask_conflict' WHEN hit < 3 OR hit / CAST(total AS DOUBLE) < CASE WHEN ask = 'same' THEN 0.4 ELSE 0.55 END THEN 'low_hits' WHEN crosses THEN 'crosses_boundary' WHEN NOT has_solution OR solution_chars < 8 THEN 'no_solution' ELSE '' END AS reason FROM g)"""


def _judged(t: Tables):
    c = F.col
    # prices are cut to whole numbers the same way in both engines: half to even is avoided by flooring cents first
    price = F.floor(F.round(c("l_extendedprice") * 100) / 100 + 0.5).cast("int")
    ask = F.when(c("l_suppkey") % 4 == 0, "conflict").when(c("l_suppkey") % 4 == 1, "unknown").otherwise("same")
    q = c("l_quantity").cast("int")
    j = t.lineitem.select(
        c("l_orderkey").alias("question"), (c("l_partkey") * 100000 + c("l_suppkey") * 10 + c("l_linenumber")).alias("object_id"), (q % 9 + 2).alias("total"), (c("l_partkey") % 9).alias("hit0"), (price % 7000).alias("stem_chars"), ask.alias("ask"),
        ((c("l_linestatus") == "F") & (c("l_partkey") % 5 == 0)).alias("crosses"), (c("l_returnflag") != "R").alias("has_solution"), (q % 30).alias("solution_chars"),
    )
    j = j.withColumn("hit", F.least("hit0", c("total").cast("long"))).withColumn("ratio", F.round(c("hit") / c("total"), 6))
    return j.withColumn("reason", Q.gate(c("total"), c("hit"), c("stem_chars"), c("ask"), c("crosses"), c("has_solution"), c("solution_chars")))


_JUDGED = _JUDGED.replace("CAST(l_extendedprice AS INTEGER) % 7000", "CAST(floor(round(l_extendedprice * 100) / 100 + 0.5) AS INTEGER) % 7000")


@query("gate_reason", f"WITH {_JUDGED} SELECT question, object_id, hit, ratio, reason FROM r")
def gate_reason(t: Tables):
    return _judged(t).select("question", "object_id", "hit", "ratio", "reason")


@query(
    "unique_select",
    f"""WITH {_JUDGED}, o AS (SELECT *, row_number() OVER w AS rn, lead(reason) OVER w AS nr, lead(hit) OVER w AS nh, lead(ratio) OVER w AS nq FROM r WINDOW w AS (PARTITION BY question ORDER BY CASE WHEN reason = '' THEN 0 ELSE 1 END, hit DESC, ratio DESC, solution_chars DESC, object_id))
    SELECT question, object_id, CASE WHEN reason = '' AND coalesce(nr = '' AND nh = hit AND nq = ratio, FALSE) THEN 'not_unique' ELSE reason END AS reason, reason = '' AND NOT coalesce(nr = '' AND nh = hit AND nq = ratio, FALSE) AS exact FROM o WHERE rn = 1""",
)
def unique_select(t: Tables):
    return Q.unique(_judged(t), "question").select("question", "object_id", "reason", "exact")


@query("link_confidence", "SELECT l_orderkey, l_linenumber, round(least(1.0, 0.6 + least(0.25, (l_linenumber % 3 * 2 + l_partkey % 4) * 0.05) + CASE WHEN l_suppkey % 2 = 0 THEN 0.15 ELSE 0 END), 2) AS confidence FROM lineitem")
def link_confidence(t: Tables):
    score = F.col("l_linenumber") % 3 * 2 + F.col("l_partkey") % 4
    ask = F.when(F.col("l_suppkey") % 2 == 0, "same").otherwise("unknown")
    return t.lineitem.select("l_orderkey", "l_linenumber", Q.confidence(score, ask).alias("confidence"))


@query(
    "answer_cascade",
    """WITH c AS (SELECT b.item_id, 1 AS tier, 'own' AS origin, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND d.source IN ('src0', 'src1', 'src2') UNION ALL SELECT b.item_id, 2, 'shared', d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    f AS (SELECT item_id, origin, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY tier, doc_id) AS r FROM c) SELECT b.item_id, coalesce(f.origin, 'none') AS origin, f.doc_id FROM benchmark b LEFT JOIN f ON f.item_id = b.item_id AND f.r = 1""",
)
def answer_cascade(t: Tables):
    held = containing(t.documents.select("doc_id", "text"), "doc_id", ["text"], t.benchmark.select(F.col("text").alias("item")), "item").select("doc_id", "item")
    held = held.join(t.benchmark.select("item_id", F.col("text").alias("item")), "item").join(t.documents.select("doc_id", "source"), "doc_id")
    own = F.col("source").isin("src0", "src1", "src2")
    best = held.groupBy("item_id").agg(F.min(F.struct(F.when(own, 1).otherwise(2).alias("tier"), "doc_id")).alias("x"))
    return t.benchmark.select("item_id").join(best, "item_id", "left").select("item_id", F.when(F.col("x").isNull(), "none").when(F.col("x.tier") == 1, "own").otherwise("shared").alias("origin"), F.col("x.doc_id").alias("doc_id"))


@query(
    "validate_rows",
    """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'v0' ELSE 'v1' END AS engine, CASE WHEN doc_id % 13 = 0 THEN 'rejected' ELSE 'ok' END AS status, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE md5(text) END AS revision, md5(text) AS now_rev, CASE WHEN doc_id % 7 = 0 THEN '' ELSE string_split(text, chr(10))[1] END AS stem, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE 0 END AS c0, n_chars AS c1, CASE WHEN doc_id % 3 = 0 THEN n_chars + 5 ELSE 30 END AS s1 FROM documents)
    SELECT doc_id, CASE WHEN engine <> 'v1' THEN 'engine' WHEN status <> 'ok' THEN 'status' WHEN revision <> now_rev THEN 'revision' WHEN trim(stem) = '' THEN 'stem' WHEN c0 < 0 OR c1 <= c0 THEN 'range' WHEN s1 < c0 OR s1 > c1 THEN 'stem_range' ELSE '' END AS reason FROM s""",
)
def validate_rows(t: Tables):
    i, n = F.col("doc_id"), F.col("n_chars")
    stem = F.when(i % 7 == 0, "").otherwise(F.split("text", "\n")[0])
    c0, s1 = F.when(i % 5 == 0, -1).otherwise(0), F.when(i % 3 == 0, n + 5).otherwise(30)
    rev = F.when(i % 11 == 0, "old").otherwise(F.md5("text"))
    reason = F.when(i % 17 == 0, "engine").when(i % 13 == 0, "status").when(rev != F.md5("text"), "revision").when(F.trim(stem) == "", "stem").when((c0 < 0) | (n <= c0), "range").when((s1 < c0) | (s1 > n), "stem_range").otherwise("")
    return t.documents.select("doc_id", reason.alias("reason"))


@query(
    "rebuild_needed",
    """WITH now AS (SELECT source, count(*) AS n, max(md5(text)) AS rev FROM documents GROUP BY 1), kept AS (SELECT source, count(*) - CASE WHEN source = 'src3' THEN 1 ELSE 0 END AS n, max(CASE WHEN source = 'src4' THEN md5(lang) ELSE md5(text) END) AS rev, CASE WHEN source = 'src5' THEN 'v0' ELSE 'v1' END AS engine FROM documents WHERE source <> 'src6' GROUP BY 1)
    SELECT source, NOT coalesce(kept.n = now.n AND kept.rev = now.rev AND kept.engine = 'v1', FALSE) AS rebuild FROM now LEFT JOIN kept USING (source)""",
)
def rebuild_needed(t: Tables):
    now = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.max(F.md5("text")).alias("rev"))
    s = F.col("source")
    kept = t.documents.where("source <> 'src6'").groupBy("source").agg(
        (F.count("*") - F.when(s == "src3", 1).otherwise(0)).alias("kn"), F.max(F.when(s == "src4", F.md5("lang")).otherwise(F.md5("text"))).alias("krev"), F.first(F.when(s == "src5", "v0").otherwise("v1")).alias("engine")
    )
    same = (F.col("kn") == F.col("n")) & (F.col("krev") == F.col("rev")) & (F.col("engine") == "v1")
    return now.join(kept, "source", "left").select("source", (~F.coalesce(same, F.lit(False))).alias("rebuild"))


@query(
    "cache_ttl",
    """SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'hit' WHEN ts >= TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR THEN 'negative' ELSE 'expired' END AS outcome, CASE WHEN event_type IN ('purchase', 'signup') OR ts >= TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR THEN 1 ELSE 0 END AS bump FROM events""",
)
def cache_ttl(t: Tables):
    answered = F.col("event_type").isin("purchase", "signup")
    fresh = F.col("ts") >= F.expr("timestamp_ntz '2024-01-31 00:00:00' - interval 12 hours")
    return t.events.select("event_id", F.when(answered, "hit").when(fresh, "negative").otherwise("expired").alias("outcome"), F.when(answered | fresh, 1).otherwise(0).alias("bump"))


@query(
    "retention_due",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_shipdate < TIMESTAMP '2001-08-02' - INTERVAL 7 DAY THEN 'release' WHEN l_quantity < 5 AND l_shipdate < TIMESTAMP '2001-08-02' - INTERVAL 24 HOUR THEN 'collect' ELSE 'keep' END AS act FROM lineitem""",
)
def retention_due(t: Tables):
    now = lambda back: F.expr(f"timestamp_ntz '2001-08-02 00:00:00' - interval {back}")
    act = F.when((F.col("l_returnflag") == "R") & (F.col("l_shipdate") < now("7 days")), "release").when((F.col("l_quantity") < 5) & (F.col("l_shipdate") < now("24 hours")), "collect").otherwise("keep")
    return t.lineitem.select("l_orderkey", "l_linenumber", act.alias("act"))


_SHEETS = """SELECT p_partkey // 20 AS page, string_agg(CASE WHEN p_partkey // 20 % 4 = 0 THEN p_name WHEN p_partkey % 6 = 0 THEN p_size || '. 已知图形' || p_name WHEN p_partkey % 6 = 1 THEN '  ' || p_name WHEN p_partkey % 6 = 2 THEN '（' || p_partkey % 9 || '）求它的面积' || p_size WHEN p_partkey % 6 = 3 THEN '②' WHEN p_partkey % 6 = 4 THEN '三、选' ELSE '' END, chr(10) ORDER BY p_partkey) AS s FROM part GROUP BY 1"""


@query(
    "line_blocks",
    f"""WITH t AS ({_SHEETS}), l AS (SELECT page, trim(unnest(p)) AS line, generate_subscripts(p, 1) AS k FROM (SELECT page, string_split(s, chr(10)) AS p FROM t)),
    b AS (SELECT page, blk, string_agg(line, chr(10) ORDER BY k) AS b FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '{Q.NUMBERED_LINE}') AND length(trim(regexp_replace(line, '{Q.NUMBERED_LINE}', ''))) >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY k) AS blk FROM l WHERE line <> '') GROUP BY 1, 2),
    i AS (SELECT page, item, string_agg(b, chr(10) ORDER BY blk) AS s FROM (SELECT *, sum(CASE WHEN r = 1 OR (regexp_matches(b, '[一-龥]') AND length(b) >= 6) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY blk) AS item FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY blk) AS r FROM b)) GROUP BY 1, 2),
    g AS (SELECT page, string_agg(s, '|' ORDER BY item) AS items, count(*) AS n, sum(length(s)) / count(*) AS mean, sum(length(regexp_replace(s, '[^一-龥]', '', 'g'))) / sum(length(s)) AS han FROM i GROUP BY 1)
    SELECT page, items, n, round(mean, 6) AS mean_length, round(han, 6) AS han_share, CASE WHEN mean < 12 THEN 'short' WHEN han < 0.15 THEN 'noise' WHEN page % 10 / 10 < 0.6 THEN 'confidence' ELSE 'ok' END AS reason FROM g""",
)
def line_blocks(t: Tables):
    k, size, page = F.col("p_partkey"), F.col("p_size").cast("string"), F.floor(F.col("p_partkey") / 20)
    line = F.when(page % 4 == 0, F.col("p_name")).when(k % 6 == 0, F.concat(size, F.lit(". 已知图形"), "p_name")).when(k % 6 == 1, F.concat(F.lit("  "), "p_name")).when(k % 6 == 2, F.concat(F.lit("（"), (k % 9).cast("string"), F.lit("）求它的面积"), size)).when(k % 6 == 3, "②").when(k % 6 == 4, "三、选").otherwise("")
    sheets = t.part.groupBy(page.alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("s"))
    out = Q.structured(sheets.withColumn("confidence", F.col("page") % 10 / 10), "page", "s", "confidence")
    return out.select("page", F.array_join("items", "|").alias("items"), "n", F.round("mean_length", 6).alias("mean_length"), F.round("han_share", 6).alias("han_share"), "reason")
