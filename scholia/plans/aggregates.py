"""Counts, statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational as R
from ..operators import storage as S
from ..registry import Tables, query


@query(
    "overview_counts",
    """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice > 100000) AS mastered, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-07-26') AS week FROM orders""",
)
def overview_counts(t: Tables):
    s = F.col("o_orderstatus")
    return t.orders.agg(
        F.count("*").alias("total"), F.count_if(s == "O").alias("pending"), F.count_if((s == "F") & (F.col("o_totalprice") > 100000)).alias("mastered"),
        F.count_if(F.col("o_orderdate") >= F.expr("timestamp_ntz '2001-07-26 00:00:00'")).alias("week"),
    )


@query("subject_stats", "SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'none' ELSE n_name END AS subject, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def subject_stats(t: Tables):
    n = t.nation.where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t.customer.join(n, "c_nationkey", "left").groupBy(F.coalesce("n_name", F.lit("none")).alias("subject")).agg(F.count("*").alias("n"))


@query("subject_week_stats", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS week FROM events GROUP BY 1")
def subject_week_stats(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= F.expr("timestamp_ntz '2024-01-31 00:00:00' - interval 7 days")).alias("week"))


@query(
    "quality_counts",
    """SELECT count(*) AS objects, count(*) FILTER (WHERE n_chars < 300) AS short, count(*) FILTER (WHERE regexp_matches(text, '[|]')) AS tables, count(*) FILTER (WHERE NOT regexp_matches(text, '[a-zA-Z]')) AS no_letters, count(*) FILTER (WHERE length(regexp_replace(text, '[^一-龥A-Za-z0-9]', '', 'g')) < 200) AS thin FROM documents""",
)
def quality_counts(t: Tables):
    x = F.col("text")
    return t.documents.agg(
        F.count("*").alias("objects"), F.count_if(F.col("n_chars") < 300).alias("short"), F.count_if(x.rlike("[|]")).alias("tables"), F.count_if(~x.rlike("[a-zA-Z]")).alias("no_letters"), F.count_if(F.length(text.normalised(x)) < 200).alias("thin")
    )


#: Texts by the hash of their key.
_KEYS = "WITH k AS (SELECT md5(regexp_replace(text, '[^一-龥A-Za-z0-9]', '', 'g')) AS key, count(*) AS c FROM documents WHERE regexp_replace(text, '[^一-龥A-Za-z0-9]', '', 'g') <> '' GROUP BY 1)"


def _keys(t: Tables):
    return R.text_keys(t.documents, "text").where("n_key > 0").groupBy("key").agg(F.count("*").alias("c"))


@query("dup_summary", _KEYS + " SELECT count(*) AS groups, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS redundant, count(*) FILTER (WHERE c > 1) AS repeated, max(c) AS largest FROM k")
def dup_summary(t: Tables):
    return _keys(t).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("redundant"), F.count_if(F.col("c") > 1).alias("repeated"), F.max("c").alias("largest"))


@query("dup_histogram", _KEYS + " SELECT c AS size, count(*) AS groups, CAST(sum(c) AS BIGINT) AS docs FROM k GROUP BY c")
def dup_histogram(t: Tables):
    return _keys(t).groupBy(F.col("c").alias("size")).agg(F.count("*").alias("groups"), F.sum("c").alias("docs"))


@query("dup_top20", _KEYS + " SELECT key, c FROM k ORDER BY c DESC, key LIMIT 20")
def dup_top20(t: Tables):
    return _keys(t).orderBy(F.desc("c"), "key").limit(20)


@query(
    "paired_strata",
    """WITH s AS (SELECT CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'mid' ELSE 'long' END AS stratum, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY 1)
    SELECT stratum, 'n' AS metric, n AS value FROM s UNION ALL SELECT stratum, 'chars', chars FROM s UNION ALL SELECT stratum, 'langs', langs FROM s""",
)
def paired_strata(t: Tables):
    b = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 4000, "mid").otherwise("long")
    s = t.documents.groupBy(b.alias("stratum")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("langs"))
    return s.unpivot("stratum", ["n", "chars", "langs"], "metric", "value")


@query("readiness", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events GROUP BY 1")
def readiness(t: Tables):
    f = "yyyy-MM-dd HH:mm:ss"
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"), F.date_format(F.min("ts"), f).alias("first_at"), F.date_format(F.max("ts"), f).alias("last_at"))


@query(
    "kv_agg",
    """SELECT c_mktsegment AS segment, string_agg(k || '=' || c, ',' ORDER BY k) AS by_nation FROM (SELECT c_mktsegment, n_name AS k, count(*) AS c FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) GROUP BY 1""",
)
def kv_agg(t: Tables):
    n = t.customer.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("c"))
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "c"))))
    return n.groupBy(F.col("c_mktsegment").alias("segment")).agg(m.alias("m")).select("segment", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("by_nation"))


@query(
    "ext_stats",
    """SELECT lang, count(*) AS files, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars, round(avg(n_chars), 2) AS mean, round(100.0 * count(*) / nullif((SELECT count(*) FROM documents), 0), 2) AS share FROM documents GROUP BY 1""",
)
def ext_stats(t: Tables):
    total = t.documents.agg(F.count("*").alias("total"))
    s = t.documents.groupBy("lang").agg(F.count("*").alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.round(F.avg("n_chars"), 2).alias("mean"))
    return s.join(F.broadcast(total)).select("lang", "files", "chars", "mean", F.round(100.0 * F.col("files") / F.nullif("total", F.lit(0)), 2).alias("share"))


_BLOBS = """blob AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN 'temp' WHEN l_orderkey % 5 = 0 THEN 'doc' WHEN l_orderkey % 11 = 0 THEN NULL ELSE 'image' END AS kind, CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes,
    CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) * 3 END AS original_bytes, CAST(l_quantity AS BIGINT) * 10 AS thumb_bytes, date_diff('day', CAST(l_shipdate AS DATE), DATE '2001-08-02') AS age FROM lineitem)"""


def _blobs(t: Tables):
    k = F.col("l_orderkey")
    kind = F.when(k % 7 == 0, "temp").when(k % 5 == 0, "doc").when(k % 11 == 0, F.lit(None)).otherwise("image")
    size = F.floor("l_extendedprice")
    return t.lineitem.select(kind.alias("kind"), size.alias("size_bytes"), F.when(F.col("l_linenumber") % 4 != 0, size * 3).alias("original_bytes"), (F.col("l_quantity").cast("long") * 10).alias("thumb_bytes"), F.datediff(F.lit("2001-08-02").cast("date"), F.col("l_shipdate").cast("date")).alias("age"))


_TIERS = (
    "WITH " + _BLOBS + """, tier AS (SELECT 'temp' AS tier, size_bytes AS bytes, age >= 1 AS cold, age >= 1 AS gone, FALSE AS archived FROM blob WHERE kind = 'temp'
    UNION ALL SELECT 'doc', size_bytes, age >= 90, FALSE, FALSE FROM blob WHERE kind = 'doc'
    UNION ALL SELECT 'display', size_bytes, age >= 90, FALSE, FALSE FROM blob WHERE coalesce(kind, 'image') NOT IN ('temp', 'doc')
    UNION ALL SELECT 'original', original_bytes, age >= 30, FALSE, age >= 180 FROM blob WHERE coalesce(kind, 'image') NOT IN ('temp', 'doc') AND original_bytes > 0
    UNION ALL SELECT 'thumb', thumb_bytes, FALSE, FALSE, FALSE FROM blob WHERE coalesce(kind, 'image') NOT IN ('temp', 'doc') AND thumb_bytes > 0)"""
)


@query("tier_report", _TIERS + " SELECT tier, count(*) AS objects, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE cold) AS cold_objects, CAST(coalesce(sum(bytes) FILTER (WHERE cold), 0) AS BIGINT) AS cold_bytes FROM tier GROUP BY 1")
def tier_report(t: Tables):
    return S.tier_report(_blobs(t)).select("tier", "objects", "bytes", "cold_objects", "cold_bytes")


@query(
    "tier_cost",
    _TIERS
    + """, c AS (SELECT sum(bytes) FILTER (WHERE tier <> 'temp') / 1073741824.0 * 0.118 AS now_cost, sum(bytes * CASE WHEN tier = 'temp' THEN 0 WHEN archived THEN 0.17 WHEN cold THEN 0.45 ELSE 1 END) / 1073741824.0 * 0.118 AS after_cost FROM tier)
    SELECT round(CAST(now_cost AS DOUBLE), 4) AS monthly_now, round(CAST(after_cost AS DOUBLE), 4) AS monthly_after, round(CAST((1 - after_cost / now_cost) * 100 AS DOUBLE), 2) AS saved_pct FROM c""",
)
def tier_cost(t: Tables):
    return S.tier_cost(S.tier_report(_blobs(t)))


@query(
    "quota_usage",
    """WITH item AS (SELECT o_custkey AS user_id, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_partkey END AS hash, CAST(l_quantity AS BIGINT) AS own FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    h AS (SELECT user_id, CAST(sum(p_size * 100 + 7) AS BIGINT) AS b FROM (SELECT DISTINCT user_id, hash FROM item WHERE hash IS NOT NULL) JOIN part ON p_partkey = hash GROUP BY 1)
    SELECT i.user_id, i.n AS used_count, i.own + coalesce(h.b, 0) AS used_bytes FROM (SELECT user_id, count(*) AS n, CAST(coalesce(sum(own) FILTER (WHERE hash IS NULL), 0) AS BIGINT) AS own FROM item GROUP BY 1) i LEFT JOIN h USING (user_id)""",
)
def quota_usage(t: Tables):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    items = t.lineitem.join(o, "l_orderkey").select("user_id", F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey")).alias("hash"), F.col("l_quantity").cast("long").alias("own_bytes"))
    blobs = t.part.select(F.col("p_partkey").alias("hash"), (F.col("p_size") * 100).cast("long").alias("size_bytes"), F.lit(7).cast("long").alias("thumb_bytes"))
    return S.usage(items, blobs)


@query(
    "quota_decide",
    """WITH u AS (SELECT o_custkey AS user_id, count(*) AS n, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS b, CASE WHEN o_custkey % 3 = 0 THEN 'anonymous' ELSE 'free' END AS tier FROM orders GROUP BY 1), q AS (SELECT *, CASE tier WHEN 'anonymous' THEN 2000000 ELSE 4000000 END AS qb, CASE tier WHEN 'anonymous' THEN 10 ELSE 300 END AS qc FROM u)
    SELECT user_id, CASE WHEN b + 1000 > qb THEN 'QUOTA_BYTES' WHEN n + 1 > qc THEN 'QUOTA_COUNT' ELSE '' END AS code, round(least(100.0, greatest(0.0, 100.0 * b / qb)), 6) AS pct FROM q""",
)
def quota_decide(t: Tables):
    tier = F.when(F.col("o_custkey") % 3 == 0, "anonymous").otherwise("free")
    u = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice")).alias("b"), F.first(tier).alias("tier"))
    limits = {"anonymous": (2_000_000, 10), "free": (4_000_000, 300)}
    code, pct = S.decide(F.col("b"), F.col("n"), F.col("tier"), F.lit(1000), limits)
    return u.select("user_id", code.alias("code"), F.round(pct, 6).alias("pct"))


@query("blob_stats", "SELECT count(*) AS objects, count(*) FILTER (WHERE n > 0) AS active_objects, CAST(sum(p_size) AS BIGINT) AS total_bytes FROM (SELECT p_size, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AS n FROM part)")
def blob_stats(t: Tables):
    refs = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).groupBy("p_partkey").agg(F.count("*").alias("n"))
    return t.part.join(refs, "p_partkey", "left").agg(F.count("*").alias("objects"), F.count_if(F.col("n") > 0).alias("active_objects"), F.sum("p_size").alias("total_bytes"))


@query(
    "media_summary",
    """SELECT l_orderkey AS memory_id, count(*) AS media, arg_min(l_partkey, l_linenumber * 1000000 + l_partkey) FILTER (WHERE l_returnflag <> 'R') AS cover, nullif(CAST(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS BIGINT), 0) AS audio FROM lineitem GROUP BY 1""",
)
def media_summary(t: Tables):
    r = F.col("l_returnflag") == "R"
    order = F.col("l_linenumber") * 1000000 + F.col("l_partkey")
    audio = F.nullif(F.coalesce(F.sum(F.when(r, F.col("l_quantity"))), F.lit(0.0)).cast("long"), F.lit(0).cast("long"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("memory_id")).agg(F.count("*").alias("media"), F.min_by("l_partkey", F.when(~r, order)).alias("cover"), audio.alias("audio"))


@query("ratio_guard", "SELECT lang, round(100.0 * count(*) FILTER (WHERE n_chars < 400) / count(*), 4) AS hit_pct, 100.0 * count(*) FILTER (WHERE n_chars < 400) / count(*) > 10 AS refused FROM documents GROUP BY 1")
def ratio_guard(t: Tables):
    pct = 100.0 * F.count_if(F.col("n_chars") < 400) / F.count("*")
    return t.documents.groupBy("lang").agg(F.round(pct, 4).alias("hit_pct"), (pct > 10).alias("refused"))


@query(
    "nearest_rank",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, 95 AS p, round(min(value) FILTER (WHERE r = greatest(1, ceil(n * 0.95))), 6) AS at_rank FROM r GROUP BY 1 UNION ALL SELECT event_type, 50, round(min(value) FILTER (WHERE r = greatest(1, ceil(n * 0.5))), 6) FROM r GROUP BY 1""",
)
def nearest_rank(t: Tables):
    out = [R.nearest_rank(t.events, ["event_type"], "value", p).select("event_type", F.lit(round(100 * p)).alias("p"), F.round("at_rank", 6).alias("at_rank")) for p in (0.95, 0.5)]
    return out[0].unionByName(out[1])


@query(
    "median_mad",
    """WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT e.event_type, med, median(abs(value - med)) AS mad FROM events e JOIN m USING (event_type) GROUP BY 1, 2),
    b AS (SELECT event_type, bin, row_number() OVER (PARTITION BY event_type ORDER BY c DESC, bin) AS r FROM (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS c FROM events GROUP BY 1, 2))
    SELECT event_type, round(med, 6) AS med, round(mad * 1.4826, 6) AS sigma, bin AS mode_bin FROM d JOIN b USING (event_type) WHERE r = 1""",
)
def median_mad(t: Tables):
    e = t.events.select("event_type", "value")
    med = e.groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("med"))
    mad = e.join(med, "event_type").groupBy("event_type", "med").agg((F.percentile(F.abs(F.col("value") - F.col("med")), F.lit(0.5)) * 1.4826).alias("sigma"))
    bins = e.groupBy("event_type", F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("c")).groupBy("event_type").agg(F.max_by("bin", F.struct("c", -F.col("bin"))).alias("mode_bin"))
    return mad.join(bins, "event_type").select("event_type", F.round("med", 6).alias("med"), F.round("sigma", 6).alias("sigma"), "mode_bin")
