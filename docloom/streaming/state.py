"""Keyed state of streams: lists and maps with timers, the newest time of a key, queues of pending events.

Times are event times in seconds. State that can't count any more goes when it is read next, and all
of an idle key's goes when the watermark passes what it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ADMITTED = "key string, event_id long, ts long, admitted boolean, retry_s long"
Held = list[tuple[int, int]]
Step = Callable[[Held, tuple[int, int, int]], tuple[Held, bool, int]]


def keep_state_on_disk(spark: SparkSession) -> None:
    """Keyed state of this kind needs the store that keeps it on local disk and in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[dict]:
    """The rows of a key in a micro-batch, in order; None for each null."""
    rows = pd.concat(list(batches)).sort_values(by, kind="stable")
    return (dict(zip(rows.columns, x)) for x in zip(*[rows[c].astype(object).where(rows[c].notna(), None) for c in rows.columns]))


class _Timed(StatefulProcessor):
    """A key whose state goes when the watermark passes its last time."""

    def _until(self, seconds: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if seconds is not None:
            self.handle.registerTimer(seconds * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


class ListAdmission(_Timed):
    """What counts against a quota as a list of (time, amount); ``keep`` is for how long an entry counts."""

    def __init__(self, step: Step, keep: int):
        self.step, self.keep = step, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, what long")

    def read(self) -> Held:
        return [tuple(x) for x in self.held.get()] if self.held.exists() else []

    def write(self, held: Held) -> None:
        self.held.put(held) if held else self.held.clear()

    def forget(self) -> None:
        self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, out = self.read(), []
        for e in in_order(rows, ["ts", "event_id"]):
            held, ok, retry = self.step(held, (e["event_id"], e["ts"] or 0, e["cost"] or 0))
            out.append((key[0], e["event_id"], e["ts"], ok, retry))
        self.write(held)
        self._until(max((at for at, _ in held), default=None) and max(at for at, _ in held) + self.keep)
        yield pd.DataFrame(out, columns=["key", "event_id", "ts", "admitted", "retry_s"])


class MapAdmission(ListAdmission):
    """What is live as a map from its name to when it ends; only entries that change are written."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "what long", "at long")
        self.was: dict[int, int] = {}

    def read(self) -> Held:
        self.was = {k[0]: v[0] for k, v in self.held.iterator()} if self.held.exists() else {}
        return sorted((at, what) for what, at in self.was.items())

    def write(self, held: Held) -> None:
        now = {what: at for at, what in held}
        for what in self.was.keys() - now.keys():
            self.held.removeKey((what,))
        for what, at in now.items():
            if self.was.get(what) != at:
                self.held.updateValue((what,), (at,))


def admitted(events: DataFrame, processor: ListAdmission, late: str = "1 hour") -> DataFrame:
    """Rows (key, event_id, ts, cost) of a stream with their admission; events more than ``late`` behind the newest are dropped, and a key's state outlives its last time by that. The first watermark is the epoch, so times are above 0."""
    keep_state_on_disk(events.sparkSession)
    timed = events.withColumn("_time", F.timestamp_seconds(F.coalesce("ts", F.lit(0)))).withWatermark("_time", late)
    return timed.groupBy("key").transformWithStateInPandas(processor, ADMITTED, "Append", "EventTime")


class Newest(_Timed):
    """The newest time that a key has seen: an event older than it is stale."""

    def __init__(self, time: str, arrival: str, keep: int):
        self.time, self.arrival, self.keep = time, arrival, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long")

    def forget(self) -> None:
        self.newest.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest, out = self.newest.get()[0] if self.newest.exists() else None, []
        for e in in_order(rows, [self.arrival]):
            at = e[self.time]
            if newest is None or at is not None and at >= newest:
                out.append((key[0], e[self.arrival], at))
            newest = at if newest is None else max(newest, at or newest)
        if newest is not None:
            self.newest.update((newest,))
            self._until(newest + self.keep)
        yield pd.DataFrame(out, columns=["key", "arrival", "ts"])


def fresh(events: DataFrame, key: str = "key", arrival: str = "event_id", time: str = "ts", keep: int = 86_400, late: str = "1 hour") -> DataFrame:
    """Rows (key, arrival, ts) of a stream that aren't older than one of their key that arrived before.

    A key's newest time is kept until the watermark is ``keep`` seconds past it, so later than that a
    stale event is taken for a first one; events more than ``late`` behind the newest of any key are dropped.
    """
    keep_state_on_disk(events.sparkSession)
    rows = events.select(F.col(key).alias("key"), arrival, time).withColumn("_time", F.timestamp_seconds(F.coalesce(time, F.lit(0)))).withWatermark("_time", late)
    return rows.groupBy("key").transformWithStateInPandas(Newest(time, arrival, keep), "key string, arrival long, ts long", "Append", "EventTime")


class Queue(StatefulProcessor):
    """The pending events of an aggregate; the oldest one is the only one that may go out, and is told once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getMapState("pending", "id long", "available_s long")
        self.told = handle.getValueState("told", "id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = {k[0]: v[0] for k, v in self.pending.iterator()} if self.pending.exists() else {}
        told = self.told.get()[0] if self.told.exists() else None
        for e in in_order(rows, ["id", "sequence"]):
            if e["status"] == "pending":
                waiting[e["id"]] = e["available_s"]
                self.pending.updateValue((e["id"],), (e["available_s"],))
            elif e["id"] in waiting:
                del waiting[e["id"]]
                self.pending.removeKey((e["id"],))
        head = min(waiting, default=None)
        if head is None:
            self.told.clear()
        elif head != told:
            self.told.update((head,))
            yield pd.DataFrame([(key[0], head, waiting[head])], columns=["aggregate_id", "id", "available_s"])

    def close(self) -> None:
        pass


def outbox_heads(changes: DataFrame) -> DataFrame:
    """Rows (aggregate_id, id, available_s): of a stream of changes (aggregate_id, id, status, available_s, sequence), each aggregate's oldest pending event when it becomes so.

    An event waits until all before it are delivered or dead, in whatever order that is told; changes
    of one event in a micro-batch count in order of ``sequence``. An aggregate without pending events keeps no state.
    """
    keep_state_on_disk(changes.sparkSession)
    rows = changes.select("aggregate_id", "id", "status", "available_s", "sequence")
    return rows.groupBy("aggregate_id").transformWithStateInPandas(Queue(), "aggregate_id string, id long, available_s long", "Append", "None")
