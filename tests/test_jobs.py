import pytest
from pyspark.sql import functions as F

from scholia.operators import limits
from scholia.plans import streams
from scholia.streaming import rules

EVENTS = "/root/testdata/sf0.001/events.parquet"
HOUR = 3_600_000_000


def test_job_by_hand():
    job = limits.Job(10)
    assert [job.take(0, 1, limits.SUBMIT), job.take(5, 2, limits.SUBMIT), job.take(7, 3, limits.DONE), job.take(8, 4, limits.FAIL), job.take(9, 5, limits.SUBMIT)] == [("new", 1), ("joined", 1), ("done", 1), ("ignored", None), ("new", 5)]
    assert job.overdue(19) is None and job.overdue(20) == 5 and job.take(20, 6, limits.DONE) == ("ignored", None)


def batch(spark):
    kind = F.when(F.col("event_type") == "click", limits.SUBMIT).when(F.col("event_type") == "purchase", limits.DONE).when(F.col("event_type") == "error", limits.FAIL)
    return spark.read.parquet(EVENTS).select(F.col("user_id").alias("user"), F.col("event_id").alias("event"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), kind.alias("kind")).where("kind IS NOT NULL")


def test_stream_of_jobs_over_a_restart(spark, tmp_path):
    """The first run sees the first half of January and stops; the second goes on from its checkpoint, with the jobs that ran."""
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    events = spark.read.parquet(EVENTS)

    def go() -> None:
        stream = rules.job_runs(rules.read_events(spark, src), 12 * HOUR, 24 * HOUR)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start().awaitTermination(300)

    events.where("dayofmonth(ts) <= 15").coalesce(1).write.parquet(src)
    go()
    half = spark.read.parquet(out).count()
    running = limits.job_runs(batch(spark).where(F.col("at") < 1_705_363_200_000_000), 12 * HOUR, 24 * HOUR, 1_705_363_200_000_000).where("state = 'running'").count()
    assert half > 0 and running > 0
    events.where("dayofmonth(ts) > 15").coalesce(1).write.mode("append").parquet(src)
    go()
    got = [tuple(r) for r in spark.read.parquet(out).select("user_id", "job", "at", "state").collect()]
    assert len(got) == len(set(got))
    want = limits.jobs(batch(spark), 12 * HOUR).join(batch(spark), "event").where("job IS NOT NULL").select("user", "job", "at", "decision").collect()
    assert {g for g in got if g[3] not in ("timeout", "purged")} == {tuple(r) for r in want}
    end = max(r["at"] for r in batch(spark).collect()) - HOUR
    runs = {r["job"]: r for r in limits.job_runs(batch(spark), 12 * HOUR, 24 * HOUR, end).collect()}
    late = {g[1] for g in got if g[3] == "timeout"}
    assert {j for j, r in runs.items() if r["state"] == "timeout" and r["ended"] < end} <= late <= {j for j, r in runs.items() if r["state"] in ("timeout", "running")}
    purged = [g[1] for g in got if g[3] == "purged"]
    assert len(purged) == len(set(purged)) and {j for j, r in runs.items() if r["begun"] + 24 * HOUR < end - HOUR} <= set(purged)


def test_no_jobs(spark):
    assert limits.job_runs(batch(spark).limit(0), 1, 1, 1).count() == 0


class Dies(rules.TwoSinks):
    """Ends between the sinks, or in the second one, as often as it is told to."""

    def __init__(self, *paths, between=0, second=0):
        super().__init__(*paths)
        self.between, self.second = between, second

    def write(self, df, sink, batch):
        if sink == "second" and self.second:
            self.second -= 1
            raise OSError("no space")
        super().write(df, sink, batch)
        if sink == "first" and self.between:
            self.between -= 1
            raise KeyboardInterrupt


def test_a_batch_killed_between_the_sinks(spark, tmp_path):
    a, b, ledger = (str(tmp_path / x) for x in "abl")
    sinks, df = Dies(a, b, ledger, between=1), spark.range(100)
    with pytest.raises(KeyboardInterrupt):
        sinks.put(df, 0)
    assert [r["state"] for r in rules.audit(rules.ledger(spark, ledger)).collect()] == ["missing"]
    sinks.put(df, 0)  # runs again, as the stream has not committed it
    sinks.put(spark.range(100, 150), 1)
    for path in (a, b):
        assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(150))
    assert {(r["batch"], r["rows"], r["state"]) for r in rules.audit(rules.ledger(spark, ledger)).collect()} == {(0, 100, "both"), (1, 50, "both")}


def test_a_mirror_that_fails_is_caught_up(spark, tmp_path):
    a, b, ledger = (str(tmp_path / x) for x in "abl")
    sinks = Dies(a, b, ledger, second=2)
    for k in range(3):
        sinks.put(spark.range(10 * k, 10 * k + 10), k)
        assert spark.read.parquet(a).count() == 10 * (k + 1)
    assert sorted(r["id"] for r in spark.read.parquet(b).collect()) == list(range(30)) and sinks.catch_up(spark, spark.range(1).schema) == 0


def test_queries_are_registered():
    assert streams.job_runs and streams.mirror_audit
