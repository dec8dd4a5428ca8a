"""Idempotent ingest, order and staleness of events, in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.billing import backoff_seconds
from docloom.operators.ordered import earlier, joined, split, within


def idempotent(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Batch: the first event of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return events.withColumn("_n", n).where("_n = 1").drop("_n")


def idempotent_stream(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Stream: the same within a watermark, which bounds what is remembered."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def reject_stale(events: DataFrame, key: str, arrival: str, time: str, pieces: int | None = None) -> DataFrame:
    """Batch: events that aren't older than one of their key that arrived before; a crowded key is read in pieces."""
    rows = earlier(split(events, [key], arrival, pieces), [key], _before=(F.max(time), F.max))
    newest = F.greatest("_before", F.max(time).over(within([key], arrival).rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_newest", newest).where(F.col("_newest").isNull() | (F.col(time) >= F.col("_newest")))
    return joined(rows).drop("_newest", "_before")


def read_marks(events: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Read marks that never move back; the same in a stream, in update mode."""
    return events.groupBy(*keys).agg(F.max(mark).alias(mark))


def replay_fresh(events: DataFrame, time: str, now: Column, window_s: int) -> DataFrame:
    """Buffered events that are still inside the window."""
    return events.where(F.col(time) > now - window_s)


def eligible(outbox: DataFrame, now: Column, lease_s: int = 300) -> DataFrame:
    """Per aggregate the oldest pending event, if it is due and not being delivered."""
    first = F.min("id").over(Window.partitionBy("aggregate_id"))
    rows = outbox.where("status = 'pending'").withColumn("_first", first).where("id = _first").drop("_first")
    return rows.where((F.col("available_s") <= now) & (F.col("locked_s").isNull() | (F.col("locked_s") < now - lease_s)))


def retry_or_dead_letter(outbox: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """Failed deliveries: due again after a delay, or dead at the last attempt unless a revocation must go out."""
    again = F.col("attempts") + 1
    dead = (again >= most) & (F.col("event_type") != "revocation")
    return outbox.withColumn("new_status", F.when(dead, "dead").otherwise("pending")).withColumn("available_again_s", F.when(~dead, now + backoff_seconds(again)))


def claim(notifications: DataFrame, now: Column, size: int, lease_s: int = 300) -> DataFrame:
    """The next notifications to send: pending, due, not claimed of late, by id."""
    free = F.col("locked_s").isNull() | (F.col("locked_s") < now - lease_s)
    return notifications.where((F.col("status") == "pending") & (F.col("available_s") <= now) & free).orderBy("id").limit(size)
