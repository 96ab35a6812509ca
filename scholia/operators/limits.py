"""Limiters whose answer hangs on their own earlier answers: ordered folds over each user's calls.

Calls are dealt by user and sorted inside each partition, and a task folds them one by one as they stream by; it holds
the state of one user at a time, never a user's calls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(calls: DataFrame, user: str, at: str, key: str, extra: str | None, start: Callable[[], Callable[[int, int], str]]) -> DataFrame:
    """key and decision of each call; start() gives a fresh state, which is called with (at, extra) of each call in order."""
    columns = [user, at, key, *([extra] if extra else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, decide = object(), None
        for pdf in batches:
            out = []
            for u, t, x in zip(pdf[user], pdf[at], pdf[extra] if extra else pdf[at], strict=True):
                if u != now:
                    now, decide = u, start()
                out.append(decide(int(t), int(x)))
            yield pd.DataFrame({key: pdf[key], "decision": out})

    return calls.select(*columns).repartition(user).sortWithinPartitions(user, at, key).mapInPandas(run, f"{key} {calls.schema[key].dataType.simpleString()}, decision string")


def anchored(most: int, window: int) -> Callable[[], Callable[[int, int], str]]:
    """At most ``most`` calls in a window that begins with the first call after the last one ended; rejected calls count."""

    def start():
        begin, n = None, 0

        def decide(at: int, _: int) -> str:
            nonlocal begin, n
            if begin is None or at - begin >= window:
                begin, n = at, 0
            n += 1
            return "ok" if n <= most else "limited"

        return decide

    return start


def sliding(most: int, window: int) -> Callable[[], Callable[[int, int], str]]:
    """At most ``most`` accepted calls in any window; rejected calls leave no stamp."""

    def start():
        stamps: list[int] = []

        def decide(at: int, _: int) -> str:
            while stamps and stamps[0] <= at - window:
                stamps.pop(0)
            if len(stamps) >= most:
                return "limited"
            stamps.append(at)
            return "ok"

        return decide

    return start


def quota(most: int, running: int, window: int) -> Callable[[], Callable[[int, int], str]]:
    """At most ``running`` calls at once and ``most`` in a window that begins with a call; a new window forgets what runs.

    The second value of a call is when it will have ended; only accepted calls run.
    """

    def start():
        begin, hits, busy, ends = None, 0, 0, []

        def decide(at: int, end: int) -> str:
            nonlocal begin, hits, busy, ends
            busy = max(0, busy - sum(e <= at for e in ends))
            ends = [e for e in ends if e > at]
            if begin is None or at - begin >= window:
                begin, hits, busy = at, 0, 0
            if busy >= running:
                return "busy"
            if hits + 1 > most:
                return "limited"
            hits, busy = hits + 1, busy + 1
            ends.append(end)
            return "ok"

        return decide

    return start


SUBMIT, DONE, FAIL = 1, 2, 3


class Job:
    """One user's running job: submits while it runs join it, what ends it later than ``ttl`` comes too late."""

    __slots__ = ("begun", "name", "ttl")

    def __init__(self, ttl: int, name: int | None = None, begun: int = 0):
        self.ttl, self.name, self.begun = ttl, name, begun

    def overdue(self, at: int) -> int | None:
        """The job that has timed out by then; it runs no more."""
        if self.name is None or at - self.begun <= self.ttl:
            return None
        gone, self.name = self.name, None
        return gone

    def take(self, at: int, event: int, kind: int) -> tuple[str, int | None]:
        """What an event means and for which job: new, joined, done, failed, ignored."""
        if kind == SUBMIT:
            if self.name is not None:
                return "joined", self.name
            self.name, self.begun = event, at
            return "new", event
        if kind in (DONE, FAIL) and self.name is not None:
            ended, self.name = self.name, None
            return "done" if kind == DONE else "failed", ended
        return "ignored", None


def jobs(events: DataFrame, ttl: int) -> DataFrame:
    """event, decision, job of each event (user, at, event, kind) in order; a task holds one user's job at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, job = object(), None
        for pdf in batches:
            out = []
            for u, at, event, kind in zip(pdf["user"], pdf["at"], pdf["event"], pdf["kind"], strict=True):
                if u != now:
                    now, job = u, Job(ttl)
                job.overdue(int(at))
                out.append(job.take(int(at), int(event), int(kind)))
            yield pd.DataFrame({"event": pdf["event"], "decision": [d for d, _ in out], "job": pd.array([j for _, j in out], dtype="Int64")})

    return events.select("user", "at", "event", "kind").repartition("user").sortWithinPartitions("user", "at", "event").mapInPandas(run, "event long, decision string, job long")


def job_runs(events: DataFrame, ttl: int, kept: int, now: int) -> DataFrame:
    """user, job, begun, joined, ended, state of every job by ``now``: done, failed, timeout, running; purged: it began ``kept`` or longer ago."""
    each = jobs(events, ttl).where("job IS NOT NULL").join(events.select("event", "user", "at"), "event")
    ends = F.col("decision").isin("done", "failed")
    runs = each.groupBy("user", "job").agg(F.min("at").alias("begun"), F.count_if(F.col("decision") == "joined").alias("joined"), F.min(F.when(ends, F.col("at"))).alias("ended"), F.max(F.when(ends, F.col("decision"))).alias("end"))
    late = F.col("begun") + ttl
    state = F.coalesce("end", F.when(late < now, "timeout").otherwise("running"))
    return runs.select("user", "job", "begun", "joined", F.coalesce("ended", F.when(late < now, late)).alias("ended"), state.alias("state"), (F.col("begun") + kept < now).alias("purged"))
