"""Spaced review: advancing, status, replay of an event log, transitions of the review book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days to wait at each stage; stages that count as graduated.
INTERVALS = [1, 3, 7, 14, 28]
STAGES = len(INTERVALS)
FIRST_DAYS = 1


def clamp_count(c: Column) -> Column:
    return F.least(F.greatest(F.floor(F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))), F.lit(0)), F.lit(STAGES)).cast("int")


def graduate_stages(c: Column) -> Column:
    return F.when(c == 2, 2).otherwise(STAGES)


def advance(count: Column, lapses: Column, result: Column, stages: Column) -> tuple[Column, Column, Column]:
    """Count, lapses and days until the next review (null: graduated) after a result."""
    wrong = result == "wrong"
    n = F.least(F.lit(STAGES), clamp_count(count) + 1)
    wait = F.when(n >= graduate_stages(stages), F.lit(None)).otherwise(F.get(F.array(*map(F.lit, INTERVALS)), n))
    lapses = F.greatest(F.coalesce(lapses, F.lit(0)), F.lit(0))
    return F.when(wrong, 0).otherwise(n), F.when(wrong, lapses + 1).otherwise(lapses), F.when(wrong, FIRST_DAYS).otherwise(wait)


def status(in_book: Column, paused: Column, count: Column, next_day: Column, today: Column, stages: Column) -> tuple[Column, Column, Column]:
    """Status, days overdue and days until due, by calendar day."""
    graduated = (clamp_count(count) >= graduate_stages(stages)) & next_day.isNull()
    s = (
        F.when(graduated, "graduated").when(F.coalesce(paused, F.lit(False)), "paused").when(~F.coalesce(in_book, F.lit(False)), "out")
        .when(next_day.isNull(), "unscheduled").when(next_day <= today, "due").otherwise("upcoming")
    )
    return s, F.when(s == "due", F.datediff(today, next_day)).otherwise(0), F.when(s == "due", 0).when(s == "upcoming", F.datediff(next_day, today))


def local_day(ts: Column, hours: int = 8) -> Column:
    """Calendar day at a fixed offset from UTC, for timestamps without a zone."""
    return (ts + F.make_dt_interval(hours=F.lit(hours))).cast("date")


def attempts(events: DataFrame, item: str = "user_id") -> DataFrame:
    """The stand-in for the review log: purchases are correct, errors wrong; due on the local day."""
    e = events.where(F.col("event_type").isin("purchase", "error"))
    return e.select(F.col(item).alias("item_id"), "event_id", "ts", F.when(F.col("event_type") == "error", "wrong").otherwise("correct").alias("result"), local_day(F.col("ts")).alias("due_on"))


def first_attempts(log: DataFrame) -> DataFrame:
    """The first attempt of each item and due day; attempts that weren't due don't count."""
    w = Window.partitionBy("item_id", "due_on").orderBy("ts", "event_id")
    return log.where("due_on is not null").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def accuracy_by_stage(first: DataFrame, stage: str, least: int) -> DataFrame:
    """Share of correct first attempts by stage, for stages of at least so many."""
    g = first.groupBy(stage).agg(F.count("*").alias("n"), F.count_if(F.col("result") == "correct").alias("correct"))
    return g.where(F.col("n") >= least).withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 6))


def replayed(log: DataFrame) -> DataFrame:
    """State of each item after its whole log: correct answers since the last wrong one, and all wrong ones."""
    upto = Window.partitionBy("item_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    runs = log.withColumn("lapses", F.sum((F.col("result") == "wrong").cast("int")).over(upto))
    last = runs.groupBy("item_id", "lapses").agg(F.count_if(F.col("result") == "correct").alias("streak"), F.max(F.struct("ts", "event_id")).alias("at"))
    state = last.groupBy("item_id").agg(F.max_by(F.struct("lapses", "streak"), "lapses").alias("s"))
    count = F.least(F.col("s.streak"), F.lit(STAGES)).cast("int")
    return state.select("item_id", count.alias("review_count"), F.col("s.lapses").cast("long").alias("review_lapses"), (count >= STAGES).alias("graduated"))
