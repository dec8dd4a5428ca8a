"""Devices bound to users: a device has one user, and a user has a few devices, while they are used.

Both sides keep state of their own: a device its owner, a user their devices. Whether an event is
admitted needs both, as a device is free if its user had no room for it. So the sides are walked in
turn, each with what the other said last, until nothing changes: an event depends on earlier ones
only, so the first event is right after the first round, and the only table that stays as it is is
that of events taken one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.ordered import walk
from docloom.sources.scratch import folder
from docloom.streaming.upsert import Versions

MOST, TTL = 3, 30 * 86_400
#: The time of bindings that were there before.
BEFORE_ALL = -(1 << 62)
_ROW = "key string, device string, ts long, event_id long, until long, fits boolean"


def _owned(rows: DataFrame, ttl: int) -> DataFrame:
    """Whether each event's device is free or its user's, given the events that found room with their user."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        user, device, ts, event_id, until, fits = row
        if until is not None:
            return (user, until), [(*row, True)]
        owner, end = state
        free = end <= ts or owner == user
        return ((user, ts + ttl) if free and fits else state), [(*row, free)]

    return walk(rows, ["device"], ["ts", "event_id"], lambda: (None, float("-inf")), step, f"{_ROW}, owned boolean")


def _roomy(rows: DataFrame, most: int, ttl: int) -> DataFrame:
    """Whether each event's user has the device already or room for it, given the devices that are theirs to take."""

    def step(state: dict, row: tuple) -> tuple[dict, list[tuple]]:
        user, device, ts, event_id, until, before, owned = row
        if until is not None:
            return {**state, device: until}, [(*row, True)]
        live = {d: end for d, end in state.items() if end > ts}
        fits = device in live or len(live) < most
        return ({**live, device: ts + ttl} if fits and owned else live), [(*row, fits)]

    return walk(rows, ["key"], ["ts", "event_id"], dict, step, f"{_ROW}, owned boolean, fits_now boolean")


def bind(events: DataFrame, most: int = MOST, ttl: int = TTL, bound: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Decisions (key, device, event_id, ts, admitted, reason) of events, and the bindings (key, device, until) after them.

    The reason is ``other_user`` or ``no_room``. ``bound`` are bindings from before the events. Events of
    one time are in order of id; a null time counts as 0, a null user or device as one of its own.
    """
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("device").cast("string").alias("device"), F.coalesce("ts", F.lit(0)).cast("long").alias("ts"), "event_id", F.lit(None).cast("long").alias("until"), F.lit(True).alias("fits"))
    if bound is not None:
        rows = rows.unionByName(bound.select("key", "device", F.lit(BEFORE_ALL).alias("ts"), F.lit(None).cast("long").alias("event_id"), "until", F.lit(True).alias("fits")))
    root = folder(events.sparkSession, "devices")
    n = 0
    while True:
        told = _roomy(_owned(rows, ttl), most, ttl)
        path = f"{root}/{n:03d}"
        told.write.parquet(path)
        told = events.sparkSession.read.schema(told.schema).parquet(path)
        if told.where("until is null and fits <> fits_now").isEmpty():
            break
        rows, n = told.select("key", "device", "ts", "event_id", "until", F.col("fits_now").alias("fits")), n + 1
    admitted = F.col("owned") & F.col("fits_now")
    reason = F.when(~F.col("owned"), "other_user").when(~F.col("fits_now"), "no_room")
    made = told.where("until is null")
    decisions = made.select("key", "device", "event_id", "ts", admitted.alias("admitted"), reason.alias("reason"))
    ends = made.where(admitted).select("key", "device", (F.col("ts") + ttl).alias("until"))
    kept = told.where("until is not null").select("key", "device", "until")
    owner = F.max_by(F.struct("key", "until"), "until")
    return decisions, ends.unionByName(kept).groupBy("device").agg(owner.alias("o")).select("o.key", "device", "o.until")


def bind_stream(events: DataFrame, root: str, most: int = MOST, ttl: int = TTL):
    """A writer of a stream (key, device, ts, event_id): each micro-batch is decided with the bindings of the one before.

    Bindings and decisions are versions under a shared folder, by number of the micro-batch, so one
    that comes again changes nothing. Bindings that ended before the newest event are left out.
    Start it with a checkpoint; read ``Versions(spark, f"{root}/decisions").all_rows()``.
    """

    def decide(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bindings, decisions = Versions(spark, f"{root}/bindings"), Versions(spark, f"{root}/decisions", keep=1 << 62)
        if bindings.has(number):
            return
        made, now = bind(batch, most, ttl, bindings.rows(before=number))
        newest = batch.agg(F.max("ts")).first()[0]
        decisions.write(made, number)
        bindings.write(now if newest is None else now.where(F.col("until") > newest - ttl), number)

    return events.writeStream.foreachBatch(decide)
