"""Boxes, marks, histograms, trees and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph, layout, pages
from ..registry import Tables, query

_MARKS = """m AS (SELECT CAST(p_partkey // 40 AS BIGINT) AS page, p_partkey AS id, p_size % 8 * 40 AS x0, p_size // 8 * 40 AS y0, p_size % 8 * 40 + p_partkey % 37 + 3 AS x1, p_size // 8 * 40 + p_partkey % 23 + 2 AS y1, CAST(p_partkey % 320 AS BIGINT) AS n FROM part)"""


def _marks(t: Tables):
    k, s = F.col("p_partkey"), F.col("p_size")
    x, y = s % 8 * 40, F.floor(s / 8) * 40
    return t.part.select(F.floor(k / 40).alias("page"), k.alias("id"), x.cast("long").alias("x0"), y.alias("y0"), (x + k % 37 + 3).alias("x1"), (y + k % 23 + 2).alias("y1"), (k % 320).alias("n"))


_KIND = """CASE WHEN (x1 - x0 + 1) / CAST(y1 - y0 + 1 AS DOUBLE) > 6 AND y1 - y0 + 1 <= 20 * 0.3 THEN 'underline' WHEN n > 300 THEN 'correction' WHEN a BETWEEN 0.7 AND 1.4 AND f BETWEEN 0.25 AND 0.75 THEN 'circle' WHEN a BETWEEN 0.7 AND 1.5 AND f BETWEEN 0.12 AND 0.5 THEN 'cross' WHEN a > 1.5 AND a <= 5 AND f BETWEEN 0.12 AND 0.7 THEN 'tick' ELSE 'unknown' END"""
_KINDS = f"{_MARKS}, k AS (SELECT *, {_KIND} AS kind FROM (SELECT *, (x1 - x0 + 1) / CAST(y1 - y0 + 1 AS DOUBLE) AS a, n / CAST((x1 - x0 + 1) * (y1 - y0 + 1) AS DOUBLE) AS f FROM m))"


def _kinds(t: Tables):
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return _marks(t).withColumn("kind", G.shape(box, F.col("n"), F.lit(20.0)))


@query("shape_class", f"WITH {_KINDS} SELECT id, kind FROM k")
def shape_class(t: Tables):
    return _kinds(t).select("id", "kind")


@query(
    "components",
    f"""WITH RECURSIVE {_KINDS}, b AS (SELECT * FROM k WHERE kind <> 'underline'), e AS (SELECT p.page, p.id AS u, q.id AS v FROM b p JOIN b q ON p.page = q.page AND p.x0 - 10 <= q.x1 AND q.x0 - 10 <= p.x1 AND p.y0 - 10 <= q.y1 AND q.y0 - 10 <= p.y1),
    reach(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v), c AS (SELECT u AS id, min(v) AS cluster FROM reach GROUP BY 1)
    SELECT page, cluster, count(*) AS parts, CAST(sum(n) AS BIGINT) AS ink, CAST(min(x0) AS BIGINT) AS x0, CAST(max(y1) AS BIGINT) AS y1 FROM b JOIN c USING (id) GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(n) >= 320""",
)
def components(t: Tables):
    return layout.clusters(_kinds(t), "page", 5, 3, 320).select("page", "cluster", "parts", "ink", "x0", "y1")


@query(
    "otsu",
    """WITH h AS (SELECT event_type AS g, CAST(least(255, floor(value)) AS BIGINT) AS level, count(*) AS c FROM events GROUP BY 1, 2), x AS (SELECT *, sum(c) OVER w AS n0, sum(c * level) OVER w AS s0, sum(c) OVER (PARTITION BY g) AS n, sum(c * level) OVER (PARTITION BY g) AS s FROM h WINDOW w AS (PARTITION BY g ORDER BY level ROWS UNBOUNDED PRECEDING)),
    v AS (SELECT *, CASE WHEN n > n0 THEN round(CAST(n0 AS DOUBLE) * (n - n0) * pow(CAST(s0 AS DOUBLE) / n0 - CAST(s - s0 AS DOUBLE) / (n - n0), 2) / pow(CAST(n AS DOUBLE), 2), 9) ELSE 0 END AS var FROM x), b AS (SELECT *, max(var) OVER (PARTITION BY g) AS most FROM v)
    SELECT g, CAST(floor((min(level) + max(level)) / 2) AS BIGINT) AS threshold, round(max(var), 4) AS variance FROM b WHERE var = most GROUP BY g""",
)
def otsu(t: Tables):
    h = t.events.groupBy(F.col("event_type").alias("g"), F.least(F.lit(255), F.floor("value")).cast("long").alias("level")).agg(F.count("*").alias("c"))
    return layout.otsu(h, ["g"], "level", "c").withColumn("variance", F.round("variance", 4))


@query(
    "row_cluster",
    f"""WITH RECURSIVE {_MARKS}, b AS (SELECT page, id, x0, (y0 + y1) / 2.0 AS cy, greatest(1, y1 - y0) AS h FROM m), u AS (SELECT page, median(h) AS usual FROM b GROUP BY 1), o AS (SELECT b.*, usual, row_number() OVER (PARTITION BY b.page ORDER BY cy, x0, id) AS r FROM b JOIN u ON u.page = b.page),
    f(page, id, x0, r, row, head) AS (SELECT page, id, x0, r, CAST(0 AS BIGINT), cy FROM o WHERE r = 1 UNION ALL SELECT o.page, o.id, o.x0, o.r, CASE WHEN abs(o.cy - f.head) > 0.6 * least(o.h, o.usual) THEN f.row + 1 ELSE f.row END, CASE WHEN abs(o.cy - f.head) > 0.6 * least(o.h, o.usual) THEN o.cy ELSE f.head END FROM f JOIN o ON o.page = f.page AND o.r = f.r + 1)
    SELECT page, id, row, row_number() OVER (PARTITION BY page ORDER BY row, x0, id) - 1 AS place FROM f""",
)
def row_cluster(t: Tables):
    return layout.rows_of_lines(_marks(t), "page")


def _ink(t: Tables):
    image = F.col("l_suppkey") % 23
    return t.lineitem.where(image < F.col("l_quantity") / 2).select(image.alias("image"), (F.col("l_partkey") % 90).alias("x"), (F.col("l_orderkey") % 120).alias("y"))


_INK = "SELECT DISTINCT l_suppkey % 23 AS image, l_partkey % 90 AS x, l_orderkey % 120 AS y FROM lineitem WHERE l_suppkey % 23 < l_quantity / 2"


@query(
    "ink_components",
    f"""WITH RECURSIVE p AS ({_INK}), r AS MATERIALIZED (SELECT image, y, min(x) AS x0, max(x) AS x1, row_number() OVER (ORDER BY image, y, min(x)) AS k FROM (SELECT *, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS start FROM p) GROUP BY image, y, start),
    t AS MATERIALIZED (SELECT a.k AS u, b.k AS v FROM r a JOIN r b ON b.image = a.image AND abs(b.y - a.y) = 1 AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1),
    c(k, label) USING KEY (k) AS (SELECT k, k FROM r UNION SELECT t.u, min(n.label) FROM c n JOIN t ON t.v = n.k JOIN recurring.c o ON o.k = t.u WHERE n.label < o.label GROUP BY t.u),
    g AS (SELECT image, label, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y) AS y1, sum(x1 - x0 + 1)::BIGINT AS n FROM r JOIN c USING (k) GROUP BY image, label)
    SELECT image, row_number() OVER (PARTITION BY image ORDER BY label) - 1 AS label, x0, y0, x1, y1, n FROM g""",
)
def ink_components(t: Tables):
    return layout.ink_components(_ink(t), "image")


@query(
    "stroke_width",
    """WITH p AS (SELECT DISTINCT l_suppkey % 23 AS image, l_partkey % 90 AS x, l_orderkey % 120 AS y FROM lineitem WHERE l_suppkey % 23 < l_quantity / 2), r AS (SELECT image, y, count(*) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS start FROM p) GROUP BY image, y, start)
    SELECT image, len(l) AS runs, CASE WHEN len(l) < 24 THEN 0.0 ELSE (l[CAST(floor(len(l) * 0.4) AS BIGINT) + 1] + l[CAST(floor(len(l) * 0.6) AS BIGINT) + 1]) / 2.0 END AS width FROM (SELECT image, coalesce(list(n ORDER BY n) FILTER (WHERE n BETWEEN 2 AND 12), []) AS l FROM r GROUP BY 1)""",
)
def stroke_width(t: Tables):
    return layout.stroke_width(_ink(t), "image", 12)


@query("reading_order")
def reading_order(t: Tables):
    return pages.reading_order(_marks(t), "page")


QUESTIONS = ["三、阅读下面短文，完成1-2题", "1. 甲", "2. 乙", "3. 丙", "四、实验题", "17. 某实验", "（1）步骤", "（2）结论", "五、按要求回答", "无号一", "无号二", ""]


@query("hierarchy")
def hierarchy(t: Tables):
    rows = t.literal("page long, place long, body string", [(1, k, q) for k, q in enumerate(QUESTIONS)] + [(2, 0, "1. 材料"), (2, 1, "①甲"), (2, 2, "②乙"), (2, 3, "④丁")])
    return pages.hierarchy(rows, "page", "place", "body")


@query("pack_pages")
def pack_pages(t: Tables):
    m = _marks(t).select("page", "id", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    return layout.packed(m, "page", 120, 160)


@query(
    "region_split",
    """SELECT l_orderkey AS block, count(*) FILTER (WHERE kind = 'print') AS print, count(*) FILTER (WHERE kind = 'handwriting') AS handwriting, count(*) FILTER (WHERE kind = 'red') AS red, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey) FILTER (WHERE kind = 'print'), '') AS stem, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey) FILTER (WHERE kind = 'handwriting'), '') AS wrong
    FROM (SELECT *, CASE WHEN l_discount >= 0.08 THEN CASE WHEN l_quantity >= 18 THEN 'red' ELSE 'handwriting' END WHEN l_tax * 10 + 0.5 < 0.75 THEN 'handwriting' ELSE 'print' END AS kind FROM lineitem) GROUP BY 1""",
)
def region_split(t: Tables):
    kind = F.when(F.col("l_discount") >= 0.08, F.when(F.col("l_quantity") >= 18, "red").otherwise("handwriting")).when(F.col("l_tax") * 10 + 0.5 < 0.75, "handwriting").otherwise("print")
    x = t.lineitem.withColumn("kind", kind)
    joined = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("l_linenumber", "l_partkey")))), lambda s: s["l_partkey"].cast("string")), " ")
    return x.groupBy(F.col("l_orderkey").alias("block")).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("print", "handwriting", "red")), joined("print").alias("stem"), joined("handwriting").alias("wrong"))


@query(
    "verdict_rules",
    f"""WITH {_KINDS}, g AS (SELECT page, count(*) FILTER (WHERE kind = 'correction') AS corr, count(*) FILTER (WHERE kind = 'cross' AND y1 - y0 + 1 >= 8) AS neg, count(*) FILTER (WHERE kind = 'circle' AND y1 - y0 + 1 >= 8) AS circ, count(*) FILTER (WHERE kind = 'tick' AND y1 - y0 + 1 >= 8) AS tick FROM (SELECT *, id % 200 AS blk FROM k) GROUP BY page)
    SELECT page, CASE WHEN corr > 0 OR neg > 0 OR circ > 0 THEN 'wrong' WHEN tick > 0 THEN 'correct' ELSE 'unknown' END AS verdict, CASE WHEN corr > 0 THEN 0.7 WHEN neg > 0 THEN 0.6 WHEN circ > 0 THEN 0.55 WHEN tick > 0 THEN 0.5 ELSE 0.3 END AS confidence FROM g""",
)
def verdict_rules(t: Tables):
    plausible = F.col("y1") - F.col("y0") + 1 >= 8
    n = lambda k, gated=True: F.count_if((F.col("kind") == k) & (plausible if gated else F.lit(True)))
    g = _kinds(t).groupBy("page").agg(n("correction", False).alias("corr"), n("cross").alias("neg"), n("circle").alias("circ"), n("tick").alias("tick"))
    c = F.col
    verdict = F.when((c("corr") > 0) | (c("neg") > 0) | (c("circ") > 0), "wrong").when(c("tick") > 0, "correct").otherwise("unknown")
    conf = F.when(c("corr") > 0, 0.7).when(c("neg") > 0, 0.6).when(c("circ") > 0, 0.55).when(c("tick") > 0, 0.5).otherwise(0.3)
    return g.select("page", verdict.alias("verdict"), conf.alias("confidence"))


@query(
    "tree_closure",
    """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey <= 1 THEN NULL ELSE p_partkey // 2 END AS parent FROM part), up(node, ancestor, depth) AS (SELECT id, id, 0 FROM n UNION ALL SELECT node, n.parent, depth + 1 FROM up JOIN n ON n.id = up.ancestor WHERE n.parent IS NOT NULL)
    SELECT node, ancestor, depth FROM up""",
)
def tree_closure(t: Tables):
    k = F.col("p_partkey")
    n = t.part.select(k.alias("id"), F.when(k > 1, F.floor(k / 2)).alias("parent"))
    return graph.closure(n, "id", "parent")


_DRIVE = "n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, p_partkey % 11 <> 5 AS dir, p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 2 AS same FROM part)"


@query(
    "crawl",
    f"""WITH RECURSIVE {_DRIVE}, c(id, depth, state) AS (SELECT id, 0, 'listed' FROM n WHERE parent IS NULL UNION ALL SELECT n.id, depth + 1, CASE WHEN NOT dir THEN 'file' WHEN same THEN 'skipped' ELSE 'listed' END FROM c JOIN n ON n.parent = c.id WHERE c.state = 'listed')
    SELECT id, depth, state FROM c""",
)
def crawl(t: Tables):
    k = F.col("p_partkey")
    nodes = t.part.select(k.alias("id"), F.when(k > 1, F.floor(k / 2)).alias("parent"), (k % 11 != 5).alias("is_dir"), F.col("p_size").alias("mtime"))
    known = t.part.where(k % 3 != 0).select(k.alias("id"), F.when((k % 7 == 0) | (k % 5 == 2), F.col("p_size") - 1).otherwise(F.col("p_size")).alias("mtime"))
    return graph.crawl(nodes, known, nodes.where("parent IS NULL"))
