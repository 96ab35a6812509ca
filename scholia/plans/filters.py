"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as R
from ..registry import Tables, query

NOW = "2001-08-02 00:00:00"


@query("filter_basic", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' AND o_totalprice >= 1000 AND o_totalprice < 200000")
def filter_basic(t: Tables):
    c = F.col
    return t.orders.where((c("o_orderstatus") == "O") & (c("o_orderpriority") != "1-URGENT") & (c("o_totalprice") >= 1000) & (c("o_totalprice") < 200000)).select("o_orderkey", "o_totalprice")


@query("filter_null", "SELECT d.doc_id, l.quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.toxic IS NOT NULL")
def filter_null(t: Tables):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where(F.col("quality").isNull() | F.col("toxic").isNotNull()).select("doc_id", F.col("quality").isNull().alias("unlabelled"))


@query("filter_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def filter_in(t: Tables):
    nations = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(nations, "c_nationkey", "left_semi").select("c_custkey", "c_mktsegment")


@query(
    "since_null_fallback",
    """WITH x AS (SELECT l_orderkey, l_linenumber, o_orderdate AS created, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_shipdate END AS added FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT l_orderkey, l_linenumber FROM x WHERE added >= TIMESTAMP '2000-01-01' OR (added IS NULL AND created >= TIMESTAMP '2000-01-01')""",
)
def since_null_fallback(t: Tables):
    x = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("created")), "l_orderkey")
    added = F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_shipdate"))
    return x.where(R.since(added, F.col("created"), F.expr("timestamp_ntz '2000-01-01 00:00:00'"))).select("l_orderkey", "l_linenumber")


@query("keyword_search", "SELECT p_partkey FROM part WHERE p_name ILIKE '%1%' OR p_type ILIKE '%steel%' OR p_brand ILIKE '%steel%'")
def keyword_search(t: Tables):
    return t.part.where(R.any_contains([F.col("p_name")], "1") | R.any_contains([F.col("p_type"), F.col("p_brand")], "STEEL")).select("p_partkey")


@query("key_sanitize", "SELECT page_id, translate(url, '%,()', '') AS key FROM pages")
def key_sanitize(t: Tables):
    return t.pages.select("page_id", F.translate("url", "%,()", "").alias("key"))


@query("tag_contains", "SELECT p_partkey, len(string_split(p_type, ' ')) AS tags FROM part WHERE list_contains(string_split(p_type, ' '), (SELECT max(string_split(p_type, ' ')[1]) FROM part))")
def tag_contains(t: Tables):
    tags = F.split("p_type", " ")
    wanted = t.part.agg(F.max(tags[0]).alias("wanted"))
    return t.part.select("p_partkey", tags.alias("tags")).join(F.broadcast(wanted)).where(F.array_contains("tags", F.col("wanted"))).select("p_partkey", F.size("tags").cast("long").alias("tags"))


@query("json_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_filter(t: Tables):
    return t.events.where(F.get_json_object("props", "$.k") == "7").select("event_id")


@query("null_bucket", "SELECT CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE event_type END AS bucket, count(*) AS n FROM events GROUP BY 1")
def null_bucket(t: Tables):
    given = F.when(F.col("event_type") == "view", "none").when(F.col("event_type") == "click", " Uncategorized ").otherwise(F.col("event_type"))
    return t.events.groupBy(R.sentinel_null(given).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "clean_params",
    """SELECT id, CASE WHEN lower(trim(s)) IN ('', 'undefined', 'null', 'nan') THEN NULL ELSE trim(s) END AS clean, TRY_CAST(trim(s) AS INTEGER) AS as_int, strftime(TRY_CAST(trim(s) AS DATE), '%Y-%m-%d') AS as_day
    FROM (VALUES (1, 'undefined'), (2, 'NaN'), (3, ' 42 '), (4, '2024-02-30'), (5, '2024-02-29'), (6, ''), (7, 'abc')) v(id, s)""",
)
def clean_params(t: Tables):
    rows = t.literal("id int, s string", [(1, "undefined"), (2, "NaN"), (3, " 42 "), (4, "2024-02-30"), (5, "2024-02-29"), (6, ""), (7, "abc")])
    return rows.select("id", text.cleaned(F.col("s")).alias("clean"), F.expr("try_cast(trim(s) as int)").alias("as_int"), F.date_format(F.expr("try_cast(trim(s) as date)"), "yyyy-MM-dd").alias("as_day"))


@query("regex_filter", "SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS digits FROM documents WHERE regexp_matches(text, '^[A-Z]') AND NOT regexp_matches(text, '[|]')")
def regex_filter(t: Tables):
    return t.documents.where(F.col("text").rlike("^[A-Z]") & ~F.col("text").rlike("[|]")).select("doc_id", F.col("text").rlike("[0-9]{3}").alias("digits"))


@query(
    "guarded_cast",
    """SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL AND regexp_matches(json_extract_string(props, '$.k'), '^[0-9]+$') THEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events""",
)
def guarded_cast(t: Tables):
    return t.events.select("event_id", text.int_or_null(F.get_json_object("props", "$.k")).alias("k"))


@query("like_any", "SELECT page_id FROM pages WHERE NOT (url LIKE 'https://www.%' OR url LIKE 'http://m.%' OR url LIKE '%utm_source%')")
def like_any(t: Tables):
    return t.pages.where("not (url like any ('https://www.%', 'http://m.%', '%utm_source%'))").select("page_id")


@query("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def not_in_subquery(t: Tables):
    return t.spark.sql("SELECT c_custkey FROM {c} WHERE c_custkey NOT IN (SELECT o_custkey FROM {o} WHERE o_totalprice > 100000)", c=t.customer, o=t.orders)


@query(
    "size_buckets",
    """SELECT CASE WHEN n_chars < 500 THEN 'tiny' WHEN n_chars BETWEEN 500 AND 1999 THEN 'small' WHEN n_chars BETWEEN 2000 AND 9999 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM documents GROUP BY 1""",
)
def size_buckets(t: Tables):
    n = F.col("n_chars")
    b = F.when(n < 500, "tiny").when(n.between(500, 1999), "small").when(n.between(2000, 9999), "medium").otherwise("large")
    return t.documents.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("lateral_norm", "SELECT doc_id, length(k) AS n_kept, md5(k) AS digest FROM (SELECT doc_id, regexp_replace(text, '[^一-龥A-Za-z0-9]', '', 'g') AS k FROM documents) WHERE length(k) >= 20")
def lateral_norm(t: Tables):
    return R.text_keys(t.documents, "text", "doc_id").where("n_key >= 20").select("doc_id", F.col("n_key").alias("n_kept"), F.col("key").alias("digest"))


@query(
    "grade_spread",
    """WITH g AS (SELECT p_partkey, CASE WHEN p_size % 13 = 0 THEN NULL WHEN p_size % 12 + 1 = 7 THEN 8 ELSE p_size % 12 + 1 END AS grade FROM part)
    SELECT 7 AS asked, p_partkey, grade FROM g WHERE grade IS NULL OR grade IN (7, 6, 8, 5, 9)
    UNION ALL SELECT 5, p_partkey, grade FROM g WHERE grade IS NULL OR grade = 5""",
)
def grade_spread(t: Tables):
    size = F.col("p_size")
    g = t.part.select("p_partkey", F.when(size % 13 == 0, F.lit(None)).when(size % 12 + 1 == 7, 8).otherwise(size % 12 + 1).cast("int").alias("grade"))
    return R.in_scope(g, "grade", 7).select(F.lit(7).alias("asked"), "p_partkey", "grade").unionByName(R.in_scope(g, "grade", 5).select(F.lit(5).alias("asked"), "p_partkey", "grade"))


@query(
    "key_hash",
    """SELECT page_id, regexp_extract('image/' || md5(url) || '_thumb.jpg', '([0-9a-f]{32,64})(_[a-z]+)?[.][a-z]+$', 1) AS content_hash FROM pages""",
)
def key_hash(t: Tables):
    return t.pages.select("page_id", text.hash_of_key(F.concat(F.lit("image/"), F.md5("url"), F.lit("_thumb.jpg"))).alias("content_hash"))


@query(
    "expired_status",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate + INTERVAL 5 DAY < TIMESTAMP '2001-08-02' THEN 'expired' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'done' END AS status FROM orders""",
)
def expired_status(t: Tables):
    over = F.col("o_orderdate") + F.expr("interval 5 days") < F.expr(f"timestamp_ntz '{NOW}'")
    return t.orders.select("o_orderkey", F.when((F.col("o_orderstatus") == "O") & over, "expired").when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
