"""Stateful rules over an events stream.

``gated_rate`` is the exact sliding limiter, in which rejected calls leave no stamp; the batch query ``sliding_rate``
counts all calls.  ``anchored_rate`` is the fixed window that begins with the first call.  ``review_state`` folds
results into the state of each item; its batch twin is ``operators.review.replayed``.  All need the RocksDB state
store (``spark.sql.streaming.stateStore.providerClass``).  ``windowed`` holds event-time windows with a watermark;
those are extensions of this engine.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.limits import DONE, FAIL, SUBMIT, Job
from ..operators.review import INTERVALS, STAGES

log = logging.getLogger(__name__)

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, with the event time as a timestamp (watermarks need one)."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


class GatedRate(StatefulProcessor):
    """At most ``most`` accepted calls of a user in any ``seconds``; rejected ones aren't remembered."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stamps = handle.getListState("stamps", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [s[0] for s in self.stamps.get()] if self.stamps.exists() else []
        pdf = pd.concat(list(rows)).sort_values(["at", "event_id"])
        ok = []
        for at in pdf["at"]:
            held = [s for s in held if s > at - self.seconds * 1_000_000]
            ok.append(len(held) < self.most)
            if ok[-1]:
                held.append(int(at))
        self.stamps.put([(s,) for s in held])
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"].to_numpy(), "accepted": ok})

    def close(self) -> None:
        pass


class AnchoredRate(StatefulProcessor):
    """At most ``most`` calls in a window of ``seconds`` that begins with the first call after the last one ended."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", StructType([StructField("start", LongType()), StructField("n", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, n = self.window.get() if self.window.exists() else (None, 0)
        pdf = pd.concat(list(rows)).sort_values(["at", "event_id"])
        ok = []
        for at in pdf["at"]:
            if start is None or at - start >= self.seconds * 1_000_000:
                start, n = int(at), 0
            n += 1
            ok.append(n <= self.most)
        self.window.update((start, n))
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"].to_numpy(), "accepted": ok})

    def close(self) -> None:
        pass


class ReviewState(StatefulProcessor):
    """Count, lapses and days to wait of each item after each batch of results."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("count", IntegerType()), StructField("lapses", IntegerType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count, lapses = self.state.get() if self.state.exists() else (0, 0)
        for kind in pd.concat(list(rows)).sort_values(["at", "event_id"])["event_type"]:
            count, lapses = (0, lapses + 1) if kind == "error" else (min(STAGES, count + 1), lapses)
        self.state.update((count, lapses))
        wait = INTERVALS[count] if 0 < count < STAGES else 1 if count == 0 else 0
        yield pd.DataFrame({"user_id": [key[0]], "review_count": [count], "review_lapses": [lapses], "wait_days": [wait]})

    def close(self) -> None:
        pass


def _keyed(events: DataFrame):
    return events.select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("at")).groupBy("user_id")


def gated_rate(events: DataFrame, most: int = 30, seconds: int = 60) -> DataFrame:
    return _keyed(events).transformWithStateInPandas(GatedRate(most, seconds), "user_id long, event_id long, accepted boolean", "Append", "None")


def anchored_rate(events: DataFrame, most: int = 300, seconds: int = 60) -> DataFrame:
    return _keyed(events).transformWithStateInPandas(AnchoredRate(most, seconds), "user_id long, event_id long, accepted boolean", "Append", "None")


def review_state(events: DataFrame) -> DataFrame:
    log = events.where(F.col("event_type").isin("purchase", "error"))
    return _keyed(log).transformWithStateInPandas(ReviewState(), "user_id long, review_count int, review_lapses int, wait_days int", "Update", "None")


class JobRuns(StatefulProcessor):
    """Runs of a user's jobs: submits join what runs, a run that lasts longer than ``ttl`` times out, and all is forgotten after ``kept``.

    The state is the running job and, for each job, when it is to be forgotten.  Times are those of events: a timer ends a
    run that nobody ends, and another one purges; both survive a restart with the checkpoint.
    """

    def __init__(self, ttl: int, kept: int):
        self.ttl, self.kept = ttl, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", StructType([StructField("job", LongType()), StructField("begun", LongType())]))
        self.known = handle.getMapState("known", StructType([StructField("job", LongType())]), StructType([StructField("until", LongType())]))

    def _rows(self, key, rows: list[tuple[int, int, str]]) -> pd.DataFrame:
        job, at, state = zip(*rows, strict=True) if rows else ((), (), ())
        whole = {"user_id": [key[0]] * len(rows), "job": job, "at": at}
        return pd.DataFrame({c: pd.Series(x, dtype="int64") for c, x in whole.items()} | {"state": pd.Series(state, dtype=object)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        job, out = Job(self.ttl, *(self.running.get() if self.running.exists() else ())), []
        for r in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples():
            gone = job.overdue(int(r.at))
            if gone is not None:
                out.append((gone, job.begun + self.ttl, "timeout"))
            decision, name = job.take(int(r.at), int(r.event_id), int(r.kind))
            if decision != "ignored":
                out.append((name, int(r.at), decision))
            if decision == "new":
                self.known.updateValue((name,), (int(r.at) + self.kept,))
                for wait in (self.ttl, self.kept):
                    self.handle.registerTimer((int(r.at) + wait) // 1000 + 1)
        if job.name is None:
            self.running.clear()
        else:
            self.running.update((job.name, job.begun))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs() * 1000, []
        if self.running.exists():
            name, begun = self.running.get()
            if now - begun > self.ttl:
                out.append((name, begun + self.ttl, "timeout"))
                self.running.clear()
        for (name,), (until,) in list(self.known.iterator()):
            if until < now:
                out.append((name, until, "purged"))
                self.known.removeKey((name,))
        yield self._rows(key, out)

    def close(self) -> None:
        pass


def job_runs(events: DataFrame, ttl: int, kept: int, late: str = "1 hour") -> DataFrame:
    """user_id, job, at, state (new, joined, done, failed, timeout, purged): what happens to jobs; clicks submit, purchases and errors end.  ttl, kept in microseconds."""
    kind = F.when(F.col("event_type") == "click", SUBMIT).when(F.col("event_type") == "purchase", DONE).when(F.col("event_type") == "error", FAIL)
    log = events.withWatermark("ts", late).select("ts", "user_id", "event_id", kind.alias("kind"), F.unix_micros("ts").alias("at")).where("kind IS NOT NULL")
    return log.groupBy("user_id").transformWithStateInPandas(JobRuns(ttl, kept), "user_id long, job long, at long, state string", "Append", "EventTime")


LEDGER = "sink string, batch long, rows long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """LEDGER: the batches that each sink has in full; empty before the first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/*/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def audit(entries: DataFrame) -> DataFrame:
    """batch, rows, state (both, missing, differs): how the second sink stands for each batch of the first, by their ledgers (sink, batch, rows)."""
    first, second = (entries.where(F.col("sink") == s).select("batch", F.col("rows").alias(n)) for s, n in (("first", "rows"), ("second", "there")))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("there") != F.col("rows"), "differs").otherwise("both")
    return first.join(second, "batch", "left").select("batch", "rows", state.alias("state"))


class TwoSinks:
    """Batches to two Parquet sinks, each row once in both, whatever fails in between.

    A batch is a folder named by its number that is written over, so a batch that runs again leaves no second copy; the
    ledger says that a sink has a batch only once its folder is whole.  The second sink is best effort: if it fails, the
    batch goes on, and the next one (or ``catch_up``) copies what the ledger says is missing from the first.
    """

    def __init__(self, first: str, second: str, ledger_path: str):
        self.paths, self.ledger_path = {"first": first, "second": second}, ledger_path

    def write(self, df: DataFrame, sink: str, batch: int) -> None:
        """Any failure is raised; the ledger comes last."""
        spark, path = df.sparkSession, f"{self.paths[sink]}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        rows = spark.read.schema(df.schema).parquet(path).count()
        spark.createDataFrame([(sink, batch, rows)], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{self.ledger_path}/{sink}/{batch}")

    def put(self, df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            self.write(df, "first", batch)
            try:
                self.catch_up(df.sparkSession, df.schema)
            except Exception as e:  # the ledger has it that the mirror lacks the batch
                log.warning("the second sink is behind since batch %s: %s", batch, e)
        finally:
            df.unpersist()

    def catch_up(self, spark: SparkSession, schema: StructType) -> int:
        """Copies the batches that the second sink lacks; how many.  The batches it lacks are few: it is behind by what failed."""
        behind = [r["batch"] for r in audit(ledger(spark, self.ledger_path)).where("state <> 'both'").orderBy("batch").collect()]
        for batch in behind:
            self.write(spark.read.schema(schema).parquet(f"{self.paths['first']}/batch={batch}"), "second", batch)
        return len(behind)


def dual_write(stream: DataFrame, first: str, second: str, checkpoint: str, ledger_path: str | None = None):
    """Every micro-batch to two Parquet sinks (see ``TwoSinks``); the ledger is beside the first sink unless a path is given."""
    sinks = TwoSinks(first, second, ledger_path or f"{first.rstrip('/')}-ledger")
    return stream.writeStream.foreachBatch(sinks.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by event type in tumbling or sliding windows of event time; rows later than the watermark drop out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n")
