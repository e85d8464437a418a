"""Streams that Spark's own state operators express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Priorities, most urgent first.
PRIORITIES = ["critical", "high"]


def deduplicated(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """The first job of each key, for ever; the state grows with the keys."""
    return jobs.dropDuplicates(keys)


def deduplicated_within(jobs: DataFrame, keys: list[str], time: str, bound: str) -> DataFrame:
    """The first job of each key within a bound of time, which also bounds the state."""
    return jobs.withWatermark(time, bound).dropDuplicatesWithinWatermark(keys)


def monthly_quota(usage: DataFrame, time: str = "seen_at") -> DataFrame:
    """user_id, year_month, used; a stream runs it in complete or update mode."""
    return usage.groupBy("user_id", F.date_format(time, "yyyy-MM").alias("year_month")).agg(F.count("*").alias("used"))


def windowed_counts(events: DataFrame, key: str, time: str, length: str, late: str | None = None) -> DataFrame:
    """key, begin, n by windows of event time. With late, a window is given once it is over by that much."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(key, F.window(time, length)).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("begin"), "n")


def by_priority(jobs: DataFrame) -> DataFrame:
    """Jobs of one micro-batch, most urgent first, in order of arrival; what is not known is least urgent."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority")), F.lit(0))
    return jobs.orderBy(F.when(rank == 0, len(PRIORITIES) + 1).otherwise(rank), "enqueued_at", "id")


def process(jobs: DataFrame, work, store, checkpoint: str):
    """A query that hands each micro-batch to work, by priority, and what it gives to store; deduplicate before."""
    return jobs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: store(work(by_priority(df)), n)).start()
