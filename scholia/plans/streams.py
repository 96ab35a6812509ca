"""Batch forms of the stream rules; the stateful forms are in ``scholia.streaming``.

``anchored_limit``, ``sliding_limit`` and ``user_quota`` are the limiters' own decisions; ``tumbling_limit`` and ``sliding_rate``
only count calls.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import limits
from ..registry import Tables, query
from ..streaming import rules

_HOURS = 48
_WINDOW = _HOURS * 3_600_000_000
_CALLS = "e AS (SELECT user_id, event_id, epoch_us(ts) AS t0, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 60000000 AS done, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"


def _calls(t: Tables):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select("user_id", "event_id", at.alias("at"), (at + F.floor("value").cast("long") * 60_000_000).alias("done"))


@query(
    "anchored_limit",
    f"""WITH RECURSIVE {_CALLS}, f(user_id, r, event_id, begun, n) AS (SELECT user_id, r, event_id, t0, 1 FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.r, e.event_id, CASE WHEN e.t0 - f.begun >= {_WINDOW} THEN e.t0 ELSE f.begun END, CASE WHEN e.t0 - f.begun >= {_WINDOW} THEN 1 ELSE f.n + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
    SELECT event_id, CASE WHEN n <= 3 THEN 'ok' ELSE 'limited' END AS decision FROM f""",
)
def anchored_limit(t: Tables):
    return limits.folded(_calls(t), "user_id", "at", "event_id", None, limits.anchored(3, _WINDOW))


@query(
    "sliding_limit",
    f"""WITH RECURSIVE {_CALLS}, f(user_id, r, event_id, stamps, ok) AS (SELECT user_id, r, event_id, [t0], TRUE FROM e WHERE r = 1 UNION ALL SELECT user_id, r, event_id, CASE WHEN len(held) < 3 THEN list_append(held, t0) ELSE held END, len(held) < 3 FROM (SELECT e.user_id, e.r, e.event_id, e.t0, list_filter(f.stamps, lambda s: s > e.t0 - {_WINDOW}) AS held FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1))
    SELECT event_id, CASE WHEN ok THEN 'ok' ELSE 'limited' END AS decision FROM f""",
)
def sliding_limit(t: Tables):
    return limits.folded(_calls(t), "user_id", "at", "event_id", None, limits.sliding(3, _WINDOW))


@query(
    "user_quota",
    f"""WITH RECURSIVE {_CALLS}, f(user_id, r, event_id, begun, hits, busy, ends, decision) AS (SELECT user_id, r, event_id, t0, 1, 1, [done], 'ok' FROM e WHERE r = 1 UNION ALL
    SELECT user_id, r, event_id, begun, CASE WHEN d = 'ok' THEN hits + 1 ELSE hits END, CASE WHEN d = 'ok' THEN busy + 1 ELSE busy END, CASE WHEN d = 'ok' THEN list_append(ends, done) ELSE ends END, d FROM (SELECT *, CASE WHEN busy >= 1 THEN 'busy' WHEN hits + 1 > 2 THEN 'limited' ELSE 'ok' END AS d FROM
    (SELECT user_id, r, event_id, t0, done, ends, CASE WHEN fresh THEN t0 ELSE begun END AS begun, CASE WHEN fresh THEN 0 ELSE hits END AS hits, CASE WHEN fresh THEN 0 ELSE greatest(0, busy - ended) END AS busy FROM (SELECT e.user_id, e.r, e.event_id, e.t0, e.done, f.begun, f.hits, f.busy, e.t0 - f.begun >= {_WINDOW} AS fresh, CAST(len(list_filter(f.ends, lambda x: x <= e.t0)) AS INTEGER) AS ended, list_filter(f.ends, lambda x: x > e.t0) AS ends FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1))))
    SELECT event_id, decision FROM f""",
)
def user_quota(t: Tables):
    return limits.folded(_calls(t), "user_id", "at", "event_id", "done", limits.quota(2, 1, _WINDOW))


@query("tumbling_limit", "SELECT user_id, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY 1, 2")
def tumbling_limit(t: Tables):
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) * 3600
    e = t.events.select("user_id", start.cast("long").alias("window_start"))
    return e.groupBy("user_id", "window_start").agg(F.count("*").alias("n"), (F.count("*") > 2).alias("limited"))


@query("sliding_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS rate FROM events")
def sliding_rate(t: Tables):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(us).rangeBetween(-6 * 3_600_000_000, 0)
    return t.events.select("event_id", F.count("*").over(w).alias("rate"))


@query(
    "job_state",
    """SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS last_event, CASE WHEN max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR THEN 'expired' WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'failed' WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 'done' ELSE 'running' END AS state, count(*) AS attempts FROM events GROUP BY 1""",
)
def job_state(t: Tables):
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    state = F.when(F.max("ts") < F.expr("timestamp_ntz '2024-01-31 00:00:00' - interval 24 hours"), "expired").when(last == "error", "failed").when(last == "purchase", "done").otherwise("running")
    return t.events.groupBy(F.col("user_id").alias("job_id")).agg(last.alias("last_event"), state.alias("state"), F.count("*").alias("attempts"))


_TTL, _KEPT, _NOW = 12 * 3_600_000_000, 24 * 3_600_000_000, 1_706_659_200_000_000  # by the end of January 2024


@query(
    "job_runs",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t0, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('click', 'purchase', 'error')),
    f(user_id, r, t0, job, begun, active, decision) AS (SELECT user_id, 0::BIGINT, 0::BIGINT, NULL::BIGINT, 0::BIGINT, FALSE, '' FROM e WHERE r = 1
    UNION ALL SELECT user_id, r, t0, CASE WHEN k = 'click' AND NOT live THEN event_id WHEN live THEN job END, CASE WHEN k = 'click' AND NOT live THEN t0 ELSE begun END, k = 'click', CASE WHEN k = 'click' THEN CASE WHEN live THEN 'joined' ELSE 'new' END WHEN NOT live THEN 'ignored' WHEN k = 'purchase' THEN 'done' ELSE 'failed' END
    FROM (SELECT e.*, f.job, f.begun, f.active AND e.t0 - f.begun <= {_TTL} AS live FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)),
    g AS (SELECT user_id, job, min(t0) AS begun, count(*) FILTER (decision = 'joined') AS joined, min(t0) FILTER (decision IN ('done', 'failed')) AS ended, max(decision) FILTER (decision IN ('done', 'failed')) AS state FROM f WHERE job IS NOT NULL AND decision <> 'ignored' GROUP BY ALL)
    SELECT user_id, job, begun, joined, coalesce(ended, CASE WHEN begun + {_TTL} < {_NOW} THEN begun + {_TTL} END) AS ended, coalesce(state, CASE WHEN begun + {_TTL} < {_NOW} THEN 'timeout' ELSE 'running' END) AS state, begun + {_KEPT} < {_NOW} AS purged FROM g""",
)
def job_runs(t: Tables):
    kind = F.when(F.col("event_type") == "click", limits.SUBMIT).when(F.col("event_type") == "purchase", limits.DONE).when(F.col("event_type") == "error", limits.FAIL)
    events = t.events.select(F.col("user_id").alias("user"), F.col("event_id").alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), kind.alias("kind")).where("kind IS NOT NULL")
    return limits.job_runs(events, _TTL, _KEPT, _NOW).withColumnRenamed("user", "user_id")


@query(
    "mirror_audit",
    """WITH l AS (SELECT 'first' AS sink, day(ts) AS batch, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'second', day(ts), count(*) FROM events WHERE day(ts) % 7 <> 3 AND NOT (day(ts) % 5 = 0 AND event_type = 'error') GROUP BY 2)
    SELECT batch::INTEGER AS batch, a.n AS rows, CASE WHEN b.n IS NULL THEN 'missing' WHEN b.n <> a.n THEN 'differs' ELSE 'both' END AS state FROM (SELECT * FROM l WHERE sink = 'first') a LEFT JOIN (SELECT * FROM l WHERE sink = 'second') b USING (batch)""",
)
def mirror_audit(t: Tables):
    day = F.dayofmonth("ts")
    rows = t.events.select(day.alias("batch"), "event_type")
    batch = F.col("batch")
    first = rows.groupBy("batch").agg(F.count("*").alias("rows")).withColumn("sink", F.lit("first"))
    second = rows.where((batch % 7 != 3) & ~((batch % 5 == 0) & (F.col("event_type") == "error"))).groupBy("batch").agg(F.count("*").alias("rows")).withColumn("sink", F.lit("second"))
    return rules.audit(first.unionByName(second))


@query("daily_quota", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS used, count(*) < 5 AS ok FROM events GROUP BY 1, 2")
def daily_quota(t: Tables):
    e = t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("used"))
    return e.withColumn("ok", F.col("used") < 5)
