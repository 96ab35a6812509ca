"""Scans, sources, sinks and rows that change tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as R
from ..registry import Tables, query
from ..sources import snapshots


@query("scan_project", "SELECT o_orderkey, o_orderstatus FROM orders")
def scan_project(t: Tables):
    return t.orders.select("o_orderkey", "o_orderstatus")


@query("sql_params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 10 AND 200 AND o_orderstatus = 'F'")
def sql_params(t: Tables):
    sql = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey BETWEEN :lo AND :hi AND o_orderstatus = :status"
    return t.spark.sql(sql, args={"lo": 10, "hi": 200, "status": "F"}, orders=t.orders)


@query("keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def keyset_page(t: Tables):
    return R.keyset(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 100, 50)


@query(
    "incr_prune",
    """SELECT o_custkey AS dir_id, count(*) AS files, strftime(max(o_orderdate), '%Y-%m-%d') AS newest, max(o_orderdate) > TIMESTAMP '2000-01-01' AS changed
    FROM orders GROUP BY o_custkey""",
)
def incr_prune(t: Tables):
    newest = F.max("o_orderdate")
    return t.orders.groupBy(F.col("o_custkey").alias("dir_id")).agg(
        F.count("*").alias("files"), F.date_format(newest, "yyyy-MM-dd").alias("newest"), (newest > F.expr("timestamp_ntz '2000-01-01 00:00:00'")).alias("changed")
    )


@query(
    "html_text",
    """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body,
    coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title FROM pages""",
)
def html_text(t: Tables):
    return t.pages.select("page_id", text.tags_stripped(F.col("html")).alias("body"), F.coalesce(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit("")).alias("title"))


@query(
    "ndjson_export",
    """SELECT '{"t":"nation","r":{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}}' AS line FROM nation UNION ALL SELECT '{"t":"region","r":{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}}' FROM region""",
)
def ndjson_export(t: Tables):
    return snapshots.lines({"nation": t.nation, "region": t.region})


@query("ndjson_restore", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def ndjson_restore(t: Tables):
    """Orders from the lines of a snapshot that holds several tables."""
    return snapshots.restored(snapshots.lines({"nation": t.nation, "orders": t.orders, "region": t.region}), "orders", t.orders.schema)


@query(
    "catalog_probe",
    "SELECT * FROM (VALUES ('scholia_nation', 'n_nationkey', 'int'), ('scholia_nation', 'n_name', 'string'), ('scholia_nation', 'n_regionkey', 'int'), ('scholia_region', 'r_regionkey', 'int'), ('scholia_region', 'r_name', 'string')) v(table_name, column_name, data_type)",
)
def catalog_probe(t: Tables):
    for name in ("region", "nation"):
        getattr(t, name).createOrReplaceTempView(f"scholia_{name}")
    return snapshots.catalog(t.spark, "scholia_.*")


@query(
    "topo_order",
    """WITH RECURSIVE edge(child, parent) AS (VALUES ('nation', 'region'), ('customer', 'nation'), ('supplier', 'nation'), ('orders', 'customer'), ('lineitem', 'orders'), ('lineitem', 'part'), ('lineitem', 'supplier')),
    names(n) AS (SELECT child FROM edge UNION SELECT parent FROM edge),
    walk(n, depth) AS (SELECT n, 0 FROM names WHERE n NOT IN (SELECT child FROM edge) UNION SELECT e.child, w.depth + 1 FROM walk w JOIN edge e ON e.parent = w.n)
    SELECT n AS table_name, CAST(max(depth) AS BIGINT) AS level FROM walk GROUP BY n""",
)
def topo_order(t: Tables):
    edges = [("nation", "region"), ("customer", "nation"), ("supplier", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("lineitem", "supplier")]
    return t.literal("table_name string, level long", snapshots.levels(edges))


@query("json_rows", """SELECT c_custkey, '{"k":' || c_custkey || ',"seg":"' || c_mktsegment || '","n":' || coalesce(CAST(nullif(c_nationkey, 0) AS VARCHAR), 'null') || '}' AS line FROM customer""")
def json_rows(t: Tables):
    row = F.struct(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.nullif("c_nationkey", F.lit(0)).alias("n"))
    return t.customer.select("c_custkey", F.to_json(row, {"ignoreNullFields": "false"}).alias("line"))


@query(
    "upsert_merge",
    """SELECT p_partkey, p_size + 100 AS p_size, 'new' AS origin FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, p_size, 'old' FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0""",
)
def upsert_merge(t: Tables):
    old = t.part.where("p_partkey % 2 = 0").select("p_partkey", "p_size", F.lit("old").alias("origin"))
    new = t.part.where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_size") + 100).alias("p_size"), F.lit("new").alias("origin"))
    return R.upsert(old, new, "p_partkey")


@query(
    "prune_guard",
    """WITH s AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber >= 4) AS d FROM lineitem GROUP BY 1)
    SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN s USING (l_orderkey) WHERE l_linenumber < 4 OR d > 0.5 * n OR d = n""",
)
def prune_guard(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber")
    s = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber") >= 4).alias("d"))
    return rows.join(s, "l_orderkey").where("l_linenumber < 4 or d > 0.5 * n or d = n").select("l_orderkey", "l_linenumber")


@query(
    "export_groups",
    """SELECT c_mktsegment AS subject, count(*) AS items, string_agg(c_name, ',' ORDER BY c_custkey) AS names FROM customer WHERE c_acctbal < 0 GROUP BY 1""",
)
def export_groups(t: Tables):
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda s: s["c_name"]), ",")
    return t.customer.where("c_acctbal < 0").groupBy(F.col("c_mktsegment").alias("subject")).agg(F.count("*").alias("items"), names.alias("names"))


@query(
    "json_merge",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type = 'error' AS flagged, CASE WHEN event_type = 'error' THEN 'review' END AS note FROM events""",
)
def json_merge(t: Tables):
    patch = F.when(F.col("event_type") == "error", F.create_map(F.lit("note"), F.lit("review"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.from_json("props", "map<string,string>"), patch)
    return t.events.select("event_id", merged["k"].cast("long").alias("k"), F.map_contains_key(merged, F.lit("note")).alias("flagged"), F.try_element_at(merged, F.lit("note")).alias("note"))


@query("refcount_recompute", "SELECT p_partkey AS blob_id, count(l_orderkey) AS ref_count, count(l_orderkey) > 0 AS active FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def refcount_recompute(t: Tables):
    refs = t.lineitem.groupBy(F.col("l_partkey").alias("blob_id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return t.part.select(F.col("p_partkey").alias("blob_id")).join(refs, "blob_id", "left").select("blob_id", n.alias("ref_count"), (n > 0).alias("active"))


@query(
    "purge_counts",
    """SELECT c.c_custkey AS user_id, coalesce(o.n, 0) AS orders, coalesce(o.lines, 0) AS lines FROM customer c
    LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderkey) AS n, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) o ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0""",
)
def purge_counts(t: Tables):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    per = t.orders.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))
    users = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return users.join(per, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("lines", F.lit(0)).alias("lines"))
