"""Window functions, sorting, paging and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..registry import Tables, query


@query(
    "stagger_schedule",
    """SELECT o_orderkey, strftime(TIMESTAMP '2001-08-02' + to_days(CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END, TIMESTAMP '1995-01-01'), o_orderkey) - 1) % 7 + 1 AS INTEGER)), '%Y-%m-%d') AS due FROM orders""",
)
def stagger_schedule(t: Tables):
    at = F.coalesce(F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")), F.expr("timestamp_ntz '1995-01-01 00:00:00'"))
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(at, "o_orderkey"))
    return t.orders.select("o_orderkey", F.date_format(F.date_add(F.lit("2001-08-02").cast("date"), ((r - 1) % 7 + 1).cast("int")), "yyyy-MM-dd").alias("due"))


@query("blind_sample", "SELECT source, doc_id, rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 50")
def blind_sample(t: Tables):
    return R.stratified(t.documents.select("source", "doc_id"), ["source"], "doc_id", 50).select("source", "doc_id", F.col("rn").cast("long").alias("rn"))


@query("layer_sample", "SELECT lang, bucket, doc_id FROM (SELECT lang, least(n_chars // 1000, 5) AS bucket, doc_id, row_number() OVER (PARTITION BY lang, least(n_chars // 1000, 5) ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 5")
def layer_sample(t: Tables):
    d = t.documents.select("lang", F.least(F.floor(F.col("n_chars") / 1000), F.lit(5)).alias("bucket"), "doc_id", "n_chars")
    w = Window.partitionBy("lang", "bucket").orderBy(F.desc("n_chars"), "doc_id")
    return d.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("lang", "bucket", "doc_id")


@query("dedupe_mark", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 THEN 'ok' ELSE 'rejected' END AS link_status FROM documents")
def dedupe_mark(t: Tables):
    return R.mark_repeats(t.documents.select("doc_id", F.md5("text").alias("k")), ["k"], [F.col("doc_id")]).select("doc_id", "link_status")


@query("share_of_total", "SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY 1")
def share_of_total(t: Tables):
    n = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("total")))).select("o_orderpriority", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))


@query(
    "daily_seq",
    """SELECT event_id, event_type || '-' || strftime(ts + INTERVAL 8 HOUR, '%m%d') || '-' || row_number() OVER (PARTITION BY user_id, event_type, CAST(ts + INTERVAL 8 HOUR AS DATE) ORDER BY ts, event_id) AS title FROM events""",
)
def daily_seq(t: Tables):
    local = F.col("ts") + F.expr("interval 8 hours")
    r = F.row_number().over(Window.partitionBy("user_id", "event_type", local.cast("date")).orderBy("ts", "event_id"))
    return t.events.select("event_id", F.concat_ws("-", "event_type", F.date_format(local, "MMdd"), r.cast("string")).alias("title"))


@query("latest_by_hash", "SELECT k AS hash, doc_id, in_trash FROM (SELECT md5(text) AS k, doc_id, doc_id % 5 = 0 AS in_trash, row_number() OVER (PARTITION BY md5(text) ORDER BY CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END, doc_id DESC) AS r FROM documents) WHERE r = 1")
def latest_by_hash(t: Tables):
    d = t.documents.select(F.md5("text").alias("hash"), "doc_id", (F.col("doc_id") % 5 == 0).alias("in_trash"))
    return d.groupBy("hash").agg(F.min(F.struct(F.col("in_trash").cast("int").alias("a"), (-F.col("doc_id")).alias("b"))).alias("x")).select("hash", (-F.col("x.b")).alias("doc_id"), (F.col("x.a") == 1).alias("in_trash"))


@query(
    "split_segments",
    """WITH l AS (SELECT doc_id, length(text) AS len, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), m AS (SELECT doc_id, len, k, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS pos FROM l)
    SELECT doc_id, CAST(pos AS BIGINT) AS start_at, CAST(coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY k), len) AS BIGINT) AS end_at FROM (SELECT * FROM m WHERE pos <= len)""",
)
def split_segments(t: Tables):
    lines = t.documents.select("doc_id", F.length("text").alias("len"), F.posexplode(F.split("text", "\n")).alias("k", "line")).select("doc_id", "len", "k", (F.length("line") + 1).alias("step"))
    w = Window.partitionBy("doc_id").orderBy("k")
    m = lines.withColumn("pos", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("pos <= len")
    end = F.coalesce(F.lead("pos").over(w), F.col("len"))
    return m.select("doc_id", F.col("pos").cast("long").alias("start_at"), end.cast("long").alias("end_at"))


@query(
    "seq_gaps",
    """SELECT l_orderkey, n AS seen, prev, CASE WHEN n = prev THEN 'duplicate' WHEN n > prev + 1 THEN 'gap' ELSE 'ok' END AS kind FROM (SELECT l_orderkey, n, lag(n) OVER (PARTITION BY l_orderkey ORDER BY n, l_linenumber) AS prev FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 10 AS BIGINT) AS n FROM lineitem)) WHERE prev IS NOT NULL""",
)
def seq_gaps(t: Tables):
    x = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 10).alias("n"))
    x = x.withColumn("prev", F.lag("n").over(Window.partitionBy("l_orderkey").orderBy("n", "l_linenumber"))).where("prev is not null")
    kind = F.when(F.col("n") == F.col("prev"), "duplicate").when(F.col("n") > F.col("prev") + 1, "gap").otherwise("ok")
    return x.select("l_orderkey", F.col("n").alias("seen"), "prev", kind.alias("kind"))


_SPANS = """iv AS (SELECT p_partkey // 25 AS page, p_partkey AS id, p_size * 20 AS lo, p_size * 20 + p_partkey % 30 AS hi FROM part)"""


def _spans(t: Tables):
    k, s = F.col("p_partkey"), F.col("p_size")
    return t.part.select(F.floor(k / 25).alias("page"), k.alias("id"), (s * 20).cast("long").alias("lo"), (s * 20 + k % 30).alias("hi"))


def _islands(gap: str) -> str:
    return f"""WITH {_SPANS}, f AS (SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY page ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000) + {gap} THEN 1 ELSE 0 END AS fresh FROM iv),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY lo, hi, id ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT page, CAST(min(lo) AS BIGINT) AS lo, CAST(max(hi) AS BIGINT) AS hi, count(*) AS parts FROM g GROUP BY page, island"""


@query("interval_merge", _islands("0"))
def interval_merge(t: Tables):
    return R.islands(_spans(t), ["page"], "lo", "hi", F.lit(0), "id").select("page", "lo", "hi", "parts")


@query("interval_islands", _islands("20"))
def interval_islands(t: Tables):
    return R.islands(_spans(t), ["page"], "lo", "hi", F.lit(20), "id").select("page", "lo", "hi", "parts")


@query(
    "due_order",
    """WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS due FROM orders)
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY due ASC NULLS LAST, o_orderkey) AS by_asc, row_number() OVER (PARTITION BY o_custkey ORDER BY due DESC NULLS FIRST, o_orderkey) AS by_desc FROM o""",
)
def due_order(t: Tables):
    o = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("due"))
    w, d = Window.partitionBy("o_custkey"), F.col("due")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy(d.asc_nulls_last(), "o_orderkey")).cast("long").alias("by_asc"), F.row_number().over(w.orderBy(d.desc_nulls_first(), "o_orderkey")).cast("long").alias("by_desc"))


@query("page_total", "SELECT o_orderkey, position, total FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS position, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O') WHERE position BETWEEN 41 AND 60")
def page_total(t: Tables):
    rows = R.page(t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 20)
    return rows.select("o_orderkey", F.col("position").cast("long").alias("position"), "total")


@query("gc_victims", "SELECT p_partkey FROM part LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS last_ref FROM lineitem WHERE l_quantity > 48 GROUP BY 1) ON l_partkey = p_partkey WHERE last_ref IS NULL ORDER BY p_size, p_partkey LIMIT 200")
def gc_victims(t: Tables):
    held = t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey", "p_size").join(held, "p_partkey", "left_anti").orderBy("p_size", "p_partkey").limit(200).select("p_partkey")


@query("retention_keep", "SELECT c_mktsegment, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name DESC) AS r FROM customer) WHERE r > 3")
def retention_keep(t: Tables):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_name"))
    return t.customer.withColumn("r", F.row_number().over(w)).where("r > 3").select("c_mktsegment", "c_name")


@query("released_hashes", "SELECT md5(CAST(k AS VARCHAR)) AS hash FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 3 UNION SELECT p_partkey FROM part WHERE p_size = 1 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def released_hashes(t: Tables):
    k = t.lineitem.where("l_quantity < 3").select(F.col("l_partkey").alias("k")).union(t.part.where("p_size = 1").select("p_partkey")).union(t.supplier.where("s_acctbal < 0").select("s_suppkey")).distinct()
    return k.select(F.md5(F.col("k").cast("string")).alias("hash"))


@query("set_ops", "SELECT * FROM (SELECT 'both' AS op, l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT 'both', l_partkey FROM lineitem WHERE l_returnflag = 'A') UNION ALL SELECT * FROM (SELECT 'minus' AS op, l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT 'minus', l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def set_ops(t: Tables):
    r = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    a = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k"))
    return r.intersect(a).select(F.lit("both").alias("op"), "k").unionByName(r.distinct().join(a, "k", "left_anti").select(F.lit("minus").alias("op"), "k"))


@query("tag_union", "SELECT p_partkey, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS tags FROM (SELECT p_partkey, list_sort(list_distinct(string_split(p_type, ' '))) AS a, list_sort(list_distinct(string_split(p_name || ' extra', ' '))) AS b FROM part)")
def tag_union(t: Tables):
    a = F.array_sort(F.array_distinct(F.split("p_type", " ")))
    b = F.array_sort(F.array_distinct(F.split(F.concat("p_name", F.lit(" extra")), " ")))
    return t.part.select("p_partkey", F.array_join(F.array_distinct(F.concat(a, b)), ",").alias("tags"))
