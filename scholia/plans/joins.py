"""Joins, semi and anti joins, range and nearest joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text
from ..operators import layout as L
from ..operators import relational as R
from ..operators import retrieval
from ..registry import Tables, query


@query(
    "embed_left",
    "SELECT o_orderkey, coalesce(c_name, 'none') AS subject, coalesce(c_mktsegment, '-') AS color FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON c_custkey = o_custkey",
)
def embed_left(t: Tables):
    c = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return t.orders.join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("none")).alias("subject"), F.coalesce("c_mktsegment", F.lit("-")).alias("color"))


@query(
    "multi_join",
    """SELECT n_name, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
)
def multi_join(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nationkey"))
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nationkey"))
    x = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(c, "o_custkey").join(s, ["l_suppkey", "nationkey"])
    return x.join(t.nation.select(F.col("n_nationkey").alias("nationkey"), "n_name"), "nationkey").groupBy("n_name").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))


@query(
    "exists_count",
    """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS finished FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)""",
)
def exists_count(t: Tables):
    big = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    n = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("finished"))
    return t.customer.select("c_custkey").join(big, "c_custkey", "left_semi").join(n, "c_custkey", "left").na.fill(0, ["finished"])


@query(
    "anti_multi",
    "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT user_id FROM events)",
)
def anti_multi(t: Tables):
    return R.without_any(t.customer.select(F.col("c_custkey").alias("user_id")), "user_id", [t.orders.select(F.col("o_custkey").alias("user_id")), t.events.select("user_id")])


@query(
    "attach_figures",
    """SELECT o_orderkey, count(l_orderkey) AS figures, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS seqs FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def attach_figures(t: Tables):
    seq = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    figs = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), seq.alias("s"))
    seqs = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return t.orders.select("o_orderkey").join(figs, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("figures"), F.coalesce(seqs, F.lit("")).alias("seqs"))


@query(
    "child_brief",
    """SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant,
    arg_min(text, turn) FILTER (WHERE role = 'assistant') AS cover, arg_min(role, turn) AS first_role FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations ORDER BY conv_id, turn, role, text) GROUP BY conv_id""",
)
def child_brief(t: Tables):
    c = R.latest(t.conversations, ["conv_id", "turn"], [F.col("role"), F.col("text")])
    kind = F.col("role")
    return c.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.count_if(kind == "user").alias("n_user"), F.count_if(kind == "assistant").alias("n_assistant"),
        F.min_by("text", F.when(kind == "assistant", F.col("turn"))).alias("cover"), F.min_by("role", "turn").alias("first_role"),
    )


@query(
    "range_join",
    """WITH u AS (SELECT DISTINCT p_size AS unit_id, p_size * 100 AS y0, p_size * 100 + 60 AS y1 FROM part), q AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity * 100 AS INTEGER) + l_linenumber * 7 AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber, y, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, y ORDER BY CASE WHEN y BETWEEN y0 AND y1 THEN 0 ELSE 1 END, greatest(y0 - y, y - y1, 0), unit_id) AS r FROM q JOIN u ON y BETWEEN y0 - 30 AND y1 + 30) WHERE r = 1""",
)
def range_join(t: Tables):
    units = t.part.select(F.col("p_size").alias("unit_id"), (F.col("p_size") * 100).alias("y0"), (F.col("p_size") * 100 + 60).alias("y1")).distinct()
    points = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", ((F.col("l_quantity") * 100).cast("int") + F.col("l_linenumber") * 7).alias("y"))
    return L.containing(points, units, ["l_orderkey", "l_linenumber", "l_partkey", "y"], "y", "y0", "y1", "unit_id", snap=30, bin_size=200).select("l_orderkey", "l_linenumber", "y", "unit_id")


_BOXES = """box(page, id, src, x0, y0, x1, y1) AS (SELECT p_partkey // 20, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'local' ELSE 'model' END, p_size % 7 * 10, p_size // 7 * 10, p_size % 7 * 10 + 14, p_size // 7 * 10 + 12 FROM part)"""


def _boxes(t: Tables):
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = s % 7 * 10, F.floor(s / 7).cast("int") * 10
    return t.part.select(F.floor(k / 20).alias("page"), k.alias("id"), F.when(k % 2 == 0, "local").otherwise("model").alias("src"), x.alias("x0"), y.alias("y0"), (x + 14).alias("x1"), (y + 12).alias("y1"))


@query(
    "iou_match",
    f"""WITH {_BOXES}, pair AS (SELECT m.page, m.id AS model_id, l.id AS local_id, greatest(0, least(m.x1, l.x1) - greatest(m.x0, l.x0)) * greatest(0, least(m.y1, l.y1) - greatest(m.y0, l.y0)) AS i, 168 AS a FROM box m JOIN box l ON l.page = m.page AND l.src = 'local' WHERE m.src = 'model'),
    best AS (SELECT *, row_number() OVER (PARTITION BY page, model_id ORDER BY i / (2.0 * a - i) DESC, local_id) AS r FROM pair WHERE i / (2.0 * a - i) >= 0.1)
    SELECT b.page, b.id AS model_id, best.local_id, round(coalesce(best.i / (2.0 * best.a - best.i), 0), 6) AS iou, best.local_id IS NULL AS appended FROM box b LEFT JOIN best ON best.page = b.page AND best.model_id = b.id AND best.r = 1 WHERE b.src = 'model'""",
)
def iou_match(t: Tables):
    b = _boxes(t)
    m = L.best_iou(b.where("src = 'model'"), b.where("src = 'local'"), ["page"], "id", least=0.1)
    return m.select("page", F.col("id").alias("model_id"), F.col("match_id").alias("local_id"), F.round(F.coalesce("iou", F.lit(0.0)), 6).alias("iou"), F.col("match_id").isNull().alias("appended"))


@query(
    "nearest_join",
    f"""WITH {_BOXES} SELECT page, title_id, figure_id, dist FROM (SELECT m.page, m.id AS title_id, l.id AS figure_id, abs(m.y1 - l.y0) AS dist, row_number() OVER (PARTITION BY m.page, m.id ORDER BY abs(m.y1 - l.y0), l.id) AS r
    FROM box m JOIN box l ON l.page = m.page AND l.src = 'local' AND least(m.x1, l.x1) > greatest(m.x0, l.x0) AND abs(m.y1 - l.y0) <= 24 WHERE m.src = 'model') WHERE r = 1""",
)
def nearest_join(t: Tables):
    b = _boxes(t)
    m, l = b.where("src = 'model'").alias("m"), b.where("src = 'local'").alias("l")
    overlap = F.least("m.x1", "l.x1") > F.greatest("m.x0", "l.x0")
    dist = F.abs(F.col("m.y1") - F.col("l.y0"))
    near = m.join(l, (F.col("m.page") == F.col("l.page")) & overlap & (dist <= 24)).select(F.col("m.page").alias("page"), F.col("m.id").alias("title_id"), F.struct(dist.alias("dist"), F.col("l.id").alias("figure_id")).alias("x"))
    return near.groupBy("page", "title_id").agg(F.min("x").alias("x")).select("page", "title_id", "x.figure_id", "x.dist")


@query(
    "attribute_best",
    f"""WITH {_BOXES}, cand AS (SELECT g.page, g.id AS group_id, u.id AS unit_id, abs(g.y0 - u.y0) * CASE WHEN g.y0 > u.y0 THEN 0.7 ELSE 1.0 END AS dist, abs(g.x0 - u.x0) AS hd, g.x0 <= u.x0 + 40 AS in_zone
    FROM box g JOIN box u ON u.page = g.page AND u.src = 'local' AND abs(g.y0 - u.y0) <= 18 AND g.x0 >= u.x0 - 12 WHERE g.src = 'model'),
    ring AS (SELECT *, min(dist) OVER (PARTITION BY page, group_id) AS best FROM cand)
    SELECT page, group_id, unit_id, round(dist, 6) AS dist, hd FROM (SELECT *, row_number() OVER (PARTITION BY page, group_id ORDER BY CASE WHEN in_zone THEN 0 ELSE 1 END, hd, unit_id) AS r FROM ring WHERE dist <= best + 3.6) WHERE r = 1""",
)
def attribute_best(t: Tables):
    b = _boxes(t)
    return L.attributed(b.where("src = 'model'"), b.where("src = 'local'"), "page", line_height=12.0, zone=40).withColumn("dist", F.round("dist", 6))


@query(
    "dict_match",
    """WITH term AS (SELECT DISTINCT p_type AS w FROM part UNION SELECT DISTINCT string_split(p_type, ' ')[1] FROM part), hit AS (SELECT p_partkey, w, instr(p_type, w) AS pos, row_number() OVER (PARTITION BY p_partkey ORDER BY length(w) DESC, instr(p_type, w), w) AS r FROM part JOIN term ON length(w) >= 2 AND instr(p_type, w) > 0)
    SELECT p_partkey, r AS rank, w AS tag, CAST(pos AS BIGINT) AS pos FROM hit WHERE r <= 3""",
)
def dict_match(t: Tables):
    terms = t.part.select(F.explode(F.array("p_type", F.split("p_type", " ")[0])).alias("w")).distinct()
    return retrieval.dictionary(t.part, "p_partkey", "p_type", terms, "w", top=3).select("p_partkey", F.col("rank").cast("long").alias("rank"), F.col("w").alias("tag"), F.col("pos").cast("long").alias("pos"))


@query("update_from", "SELECT c.c_custkey, coalesce(v.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'moved' END AS c_mktsegment FROM customer WHERE c_custkey % 5 = 0) v USING (c_custkey)")
def update_from(t: Tables):
    v = t.customer.where("c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "moved").alias("c_mktsegment"))
    return R.update_from(t.customer.select("c_custkey", "c_mktsegment"), v, "c_custkey", "c_mktsegment")


@query(
    "pending_sources",
    """SELECT s.source, s.lang, count(*) AS waiting FROM documents s JOIN (SELECT DISTINCT source FROM documents WHERE n_chars > 5000) b USING (source) WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.doc_id) GROUP BY 1, 2 HAVING count(*) > 1""",
)
def pending_sources(t: Tables):
    big = t.documents.where("n_chars > 5000").select("source").distinct()
    rest = t.documents.select("doc_id", "source", "lang").join(t.labels.select("doc_id"), "doc_id", "left_anti").join(big, "source")
    return rest.groupBy("source", "lang").agg(F.count("*").alias("waiting")).where("waiting > 1")


@query(
    "similar_items",
    """WITH d AS (SELECT doc_id, list_distinct(list_transform(range(1, length(k)), lambda i: substring(k, i, 2))) AS g FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS k FROM documents) WHERE length(k) >= 2),
    q AS (SELECT g FROM d WHERE doc_id = (SELECT min(doc_id) FROM d))
    SELECT doc_id, round(2.0 * len(list_intersect(d.g, q.g)) / (len(d.g) + len(q.g)), 6) AS dice FROM d, q WHERE round(2.0 * len(list_intersect(d.g, q.g)) / (len(d.g) + len(q.g)), 6) >= 0.6""",
)
def similar_items(t: Tables):
    k = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    d = t.documents.where(F.length(k) >= 2)
    target = d.join(F.broadcast(d.agg(F.min("doc_id").alias("doc_id"))), "doc_id").select(text.letter_pairs(k).alias("q"))
    d = d.select("doc_id", text.letter_pairs(k).alias("g"))
    dice = F.round(text.dice_of_pairs(F.col("g"), F.col("q")), 6)
    return d.join(F.broadcast(target)).select("doc_id", dice.alias("dice")).where("dice >= 0.6")


@query(
    "simhash_dups",
    rf"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id AS id, regexp_replace(regexp_replace(text, '\s+', '', 'g'), '[，。、；：？！"''“”‘’（）()【】\[\]{{{{}}}}《》·—\-–_,.;:?!/\\|+=*#~`^$@%&]', '', 'g') AS t FROM documents),
    u AS (SELECT id, flatten([CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END FOR c IN regexp_extract_all(t, '(?s).')]) AS u FROM t WHERE length(t) >= 8),
    g AS (SELECT id, unnest(u[1:-2])::UBIGINT AS a, unnest(u[2:])::UBIGINT AS b FROM u),
    f AS (SELECT id, ((xor((((xor(14695981039346656037::UBIGINT, a))::UHUGEINT * 1099511628211) % 18446744073709551616)::UBIGINT, b))::UHUGEINT * 1099511628211 % 18446744073709551616)::UBIGINT AS f FROM g),
    h AS MATERIALIZED (SELECT id, ({" + ".join(f"CASE WHEN 2 * sum((f >> {k}) & 1) > count(*) THEN 1::UHUGEINT << {k} ELSE 0 END" for k in range(64))})::UBIGINT AS h FROM f GROUP BY id),
    p AS MATERIALIZED (SELECT a.id, list(b.id ORDER BY b.id) AS o FROM h a JOIN h b ON b.id < a.id AND bit_count(xor(a.h, b.h)::BIT) <= 3 GROUP BY a.id),
    n AS MATERIALIZED (SELECT id, o, row_number() OVER (ORDER BY id) AS k FROM p),
    r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL SELECT n.k, CASE WHEN len(list_filter(n.o, lambda x: NOT list_contains(r.gone, x))) > 0 THEN list_append(r.gone, n.id) ELSE r.gone END FROM r JOIN n ON n.k = r.k + 1),
    last AS (SELECT gone FROM r ORDER BY k DESC LIMIT 1)
    SELECT n.id, list_filter(n.o, lambda x: NOT list_contains(last.gone, x))[1] AS kept_id FROM n, last WHERE list_contains(last.gone, n.id)""".replace("{{}}", "{}"),
)
def simhash_dups(t: Tables):
    from ..operators import simhash

    return simhash.duplicates(t.documents, "doc_id", "text")


@query(
    "box_iou",
    f"""WITH {_BOXES}, p AS (SELECT a.page, a.id AS a_id, b.id AS b_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1) AS i, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1) AS yi FROM box a JOIN box b ON a.page = b.page AND b.id = a.id + 1)
    SELECT page, a_id, b_id, round(i / (2.0 * 195 - i), 6) AS iou, round(yi / (26.0 - yi), 6) AS y_iou FROM p""",
)
def box_iou(t: Tables):
    b = _boxes(t)
    n = b.select("page", (F.col("id") - 1).alias("id"), F.col("id").alias("b_id"), *(F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")))
    a, o = [F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col("b" + c) for c in ("x0", "y0", "x1", "y1")]
    return b.join(n, ["page", "id"]).select("page", F.col("id").alias("a_id"), "b_id", F.round(G.iou_pixels(a, o), 6).alias("iou"), F.round(G.iou_1d(a[1], a[3], o[1], o[3]), 6).alias("y_iou"))
