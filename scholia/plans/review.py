"""Spaced review over the events table, and rules on literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review as V
from ..registry import Tables, query

_LOG = """log AS (SELECT user_id AS item_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'wrong' ELSE 'correct' END AS result, CAST(ts + INTERVAL 8 HOUR AS DATE) AS due_on FROM events WHERE event_type IN ('purchase', 'error'))"""

_STATES = [
    (1, True, False, "2024-01-30", 1, 5), (2, True, False, "2024-01-31", 1, 5), (3, True, False, "2024-02-02", 1, 5), (4, True, False, None, 1, 5), (5, True, False, None, 5, 5),
    (6, False, False, "2024-01-28", 0, 5), (7, False, True, "2024-02-01", 1, 5), (8, False, False, None, 2, 2), (9, True, False, "2024-01-01", 99, 5), (10, None, None, None, -3, 5),
]
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in _STATES)


@query(
    "due_first_accuracy",
    f"""WITH {_LOG}, f AS (SELECT *, event_id % 5 AS stage, row_number() OVER (PARTITION BY item_id, due_on ORDER BY ts, event_id) AS r FROM log)
    SELECT stage, count(*) AS n, count(*) FILTER (WHERE result = 'correct') AS correct, round(count(*) FILTER (WHERE result = 'correct') / count(*), 6) AS accuracy FROM f WHERE r = 1 GROUP BY 1 HAVING count(*) >= 30""",
)
def due_first_accuracy(t: Tables):
    first = V.first_attempts(V.attempts(t.events)).withColumn("stage", F.col("event_id") % 5)
    return V.accuracy_by_stage(first, "stage", 30)


@query(
    "review_advance",
    """SELECT count, lapses, result, stages, CASE WHEN result = 'wrong' THEN 0 ELSE n END AS new_count, CASE WHEN result = 'wrong' THEN lapses + 1 ELSE lapses END AS new_lapses,
    CASE WHEN result = 'wrong' THEN 1 WHEN n >= stages THEN NULL ELSE [1, 3, 7, 14, 28][n + 1] END AS wait_days
    FROM (SELECT *, least(5, least(greatest(count, 0), 5) + 1) AS n FROM (SELECT c.count, l.lapses, r.result, s.stages FROM (VALUES (-3), (0), (1), (2), (3), (4), (5), (999)) c(count), (VALUES (0), (1)) l(lapses), (VALUES ('correct'), ('wrong')) r(result), (VALUES (2), (5)) s(stages)))""",
)
def review_advance(t: Tables):
    rows = t.literal("count int, lapses int, result string, stages int", [(c, l, r, s) for c in (-3, 0, 1, 2, 3, 4, 5, 999) for l in (0, 1) for r in ("correct", "wrong") for s in (2, 5)])
    n, l, w = V.advance(F.col("count"), F.col("lapses"), F.col("result"), F.col("stages"))
    return rows.select("count", "lapses", "result", "stages", n.alias("new_count"), l.alias("new_lapses"), w.alias("wait_days"))


@query(
    "review_status",
    f"""WITH s AS (SELECT id, coalesce(in_book, FALSE) AS in_book, coalesce(paused, FALSE) AS paused, CAST(nxt AS DATE) AS nxt, least(greatest(cnt, 0), 5) AS cnt, stages FROM (VALUES {_VALUES}) v(id, in_book, paused, nxt, cnt, stages)),
    x AS (SELECT *, CASE WHEN cnt >= stages AND nxt IS NULL THEN 'graduated' WHEN paused THEN 'paused' WHEN NOT in_book THEN 'out' WHEN nxt IS NULL THEN 'unscheduled' WHEN nxt <= DATE '2024-01-31' THEN 'due' ELSE 'upcoming' END AS status FROM s)
    SELECT id, status, CAST(CASE WHEN status = 'due' THEN date_diff('day', nxt, DATE '2024-01-31') ELSE 0 END AS INTEGER) AS overdue, CAST(CASE WHEN status = 'due' THEN 0 WHEN status = 'upcoming' THEN date_diff('day', DATE '2024-01-31', nxt) END AS INTEGER) AS until FROM x""",
)
def review_status(t: Tables):
    rows = t.literal("id int, in_book boolean, paused boolean, nxt string, cnt int, stages int", _STATES)
    s, over, until = V.status(F.col("in_book"), F.col("paused"), F.col("cnt"), F.col("nxt").cast("date"), F.lit("2024-01-31").cast("date"), F.col("stages"))
    return rows.select("id", s.alias("status"), over.alias("overdue"), until.alias("until"))


@query(
    "review_replay",
    f"""WITH {_LOG}, w AS (SELECT *, sum(CASE WHEN result = 'wrong' THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS lapses FROM log),
    g AS (SELECT item_id, lapses, count(*) FILTER (WHERE result = 'correct') AS streak FROM w GROUP BY 1, 2), m AS (SELECT item_id, max(lapses) AS lapses FROM g GROUP BY 1)
    SELECT item_id, CAST(least(streak, 5) AS INTEGER) AS review_count, CAST(lapses AS BIGINT) AS review_lapses, streak >= 5 AS graduated FROM g JOIN m USING (item_id, lapses)""",
)
def review_replay(t: Tables):
    return V.replayed(V.attempts(t.events))


@query(
    "review_summary",
    f"""WITH {_LOG}, s AS (SELECT item_id, count(*) % 6 AS cnt, CASE WHEN count(*) % 6 = 5 OR item_id % 7 = 0 THEN NULL ELSE CAST(max(ts) + to_days(CAST(item_id % 9 AS INTEGER)) AS DATE) END AS nxt, item_id % 11 = 0 AS paused FROM log GROUP BY 1)
    SELECT count(*) AS in_book, count(*) FILTER (WHERE NOT paused AND nxt <= DATE '2024-01-31') AS due, count(*) FILTER (WHERE NOT paused AND nxt IS NULL AND cnt < 5) AS unscheduled, count(*) FILTER (WHERE nxt IS NULL AND cnt >= 5) AS graduated, count(*) FILTER (WHERE paused) AS paused,
    strftime(min(nxt) FILTER (WHERE NOT paused AND nxt > DATE '2024-01-31'), '%Y-%m-%d') AS next_due FROM s""",
)
def review_summary(t: Tables):
    log = V.attempts(t.events).groupBy("item_id").agg(F.count("*").alias("c"), F.max("ts").alias("ts"))
    cnt = F.col("c") % 6
    nxt = F.when((cnt == 5) | (F.col("item_id") % 7 == 0), F.lit(None)).otherwise(F.date_add(F.col("ts").cast("date"), (F.col("item_id") % 9).cast("int")))
    s = log.select(cnt.alias("cnt"), nxt.alias("nxt"), (F.col("item_id") % 11 == 0).alias("paused"))
    today, n = F.lit("2024-01-31").cast("date"), F.col("nxt")
    return s.agg(
        F.count("*").alias("in_book"), F.count_if(~F.col("paused") & (n <= today)).alias("due"), F.count_if(~F.col("paused") & n.isNull() & (F.col("cnt") < 5)).alias("unscheduled"), F.count_if(n.isNull() & (F.col("cnt") >= 5)).alias("graduated"),
        F.count_if("paused").alias("paused"), F.date_format(F.min(F.when(~F.col("paused") & (n > today), n)), "yyyy-MM-dd").alias("next_due"),
    )


@query(
    "event_derive",
    f"""WITH {_LOG} SELECT event_id, strftime(prev + INTERVAL 3 DAY, '%Y-%m-%d') AS due_on, coalesce(due_on > CAST(prev + INTERVAL 3 DAY AS DATE), FALSE) AS is_overdue FROM (SELECT *, lag(due_on) OVER (PARTITION BY item_id ORDER BY ts, event_id) AS prev FROM log)""",
)
def event_derive(t: Tables):
    from pyspark.sql import Window

    log = V.attempts(t.events).withColumn("due", F.date_add(F.lag("due_on").over(Window.partitionBy("item_id").orderBy("ts", "event_id")), 3))
    return log.select("event_id", F.date_format("due", "yyyy-MM-dd").alias("due_on"), F.coalesce(F.col("due_on") > F.col("due"), F.lit(False)).alias("is_overdue"))


@query(
    "review_transitions",
    f"""WITH s AS (SELECT id, coalesce(in_book, FALSE) AS in_book, coalesce(paused, FALSE) AS paused, CAST(nxt AS DATE) AS nxt, least(greatest(cnt, 0), 5) AS cnt FROM (VALUES {_VALUES}) v(id, in_book, paused, nxt, cnt, stages))
    SELECT id, 'add' AS act, TRUE AS in_book, FALSE AS paused, strftime(CASE WHEN nxt IS NULL AND cnt < 5 THEN DATE '2024-02-01' ELSE nxt END, '%Y-%m-%d') AS nxt, cnt FROM s UNION ALL SELECT id, 'remove', FALSE, FALSE, NULL, cnt FROM s
    UNION ALL SELECT id, 'pause', FALSE, TRUE, strftime(nxt, '%Y-%m-%d'), cnt FROM s UNION ALL SELECT id, 'restore', TRUE, FALSE, strftime(CASE WHEN nxt < DATE '2024-01-31' THEN DATE '2024-02-01' ELSE nxt END, '%Y-%m-%d'), cnt FROM s""",
)
def review_transitions(t: Tables):
    rows = t.literal("id int, in_book boolean, paused boolean, nxt string, cnt int, stages int", _STATES)
    n, c = F.col("nxt"), V.clamp_count(F.col("cnt"))
    today, first = "2024-01-31", "2024-02-01"
    row = lambda act, book, paused, nxt: F.struct(F.lit(act).alias("act"), F.lit(book).alias("in_book"), F.lit(paused).alias("paused"), nxt.alias("nxt"))
    acts = F.array(
        row("add", True, False, F.when(n.isNull() & (c < V.STAGES), first).otherwise(n)), row("remove", False, False, F.lit(None).cast("string")), row("pause", False, True, n), row("restore", True, False, F.when(n < today, first).otherwise(n))
    )
    return rows.select("id", c.alias("cnt"), F.inline(acts)).select("id", "act", "in_book", "paused", "nxt", "cnt")


@query("local_day", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, date_diff('day', CAST(ts + INTERVAL 8 HOUR AS DATE), DATE '2024-01-31') AS days_ago FROM events")
def local_day(t: Tables):
    day = V.local_day(F.col("ts"))
    return t.events.select("event_id", F.date_format(day, "yyyy-MM-dd").alias("day"), F.datediff(F.lit("2024-01-31").cast("date"), day).cast("long").alias("days_ago"))


@query(
    "school_year",
    """SELECT o_orderkey, y AS school_year, CASE WHEN y - 1996 <= 0 OR least(12, g + y - 1996) = g THEN NULL ELSE least(12, g + y - 1996) END AS suggested FROM (SELECT o_orderkey, CAST(year(d) - CASE WHEN month(d) >= 9 THEN 0 ELSE 1 END AS INTEGER) AS y, CAST(o_custkey % 12 + 1 AS INTEGER) AS g FROM (SELECT *, o_orderdate + INTERVAL 8 HOUR AS d FROM orders))""",
)
def school_year(t: Tables):
    d = V.local_day(F.col("o_orderdate"))
    y = F.year(d) - F.when(F.month(d) >= 9, 0).otherwise(1)
    g = (F.col("o_custkey") % 12 + 1).cast("int")
    up = F.least(F.lit(12), g + y - 1996)
    return t.orders.select("o_orderkey", y.cast("int").alias("school_year"), F.when((y - 1996 > 0) & (up != g), up).cast("int").alias("suggested"))


@query("clamp", "SELECT p_partkey, least(greatest(p_size - 10, 0), 5) AS stage, round(p_retailprice, 1) AS price FROM part")
def clamp(t: Tables):
    return t.part.select("p_partkey", V.clamp_count(F.col("p_size") - 10).alias("stage"), F.round("p_retailprice", 1).alias("price"))


@query(
    "hint_level",
    """SELECT id, CASE WHEN n <= 0 OR s = '' THEN 'none' WHEN n <= 2 THEN 'hint' ELSE 'detail' END AS level, CASE WHEN n <= 0 OR s = '' THEN '' WHEN n <= 2 THEN s ELSE concat_ws('|', nullif(l, ''), s) END AS lines
    FROM (SELECT o_orderkey AS id, o_custkey % 5 AS n, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS s, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS l FROM orders)""",
)
def hint_level(t: Tables):
    n = F.col("o_custkey") % 5
    s = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    label = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))
    none = (n <= 0) | (s == "")
    return t.orders.select(F.col("o_orderkey").alias("id"), F.when(none, "none").when(n <= 2, "hint").otherwise("detail").alias("level"), F.when(none, "").when(n <= 2, s).otherwise(F.concat_ws("|", label, s)).alias("lines"))
