"""Sliding quotas, leases and connections: admission of events by keyed state, in batch and in streams.

What is admitted depends on what was rejected before, so a key's events are taken in order: by
time, then id. Both forms keep only what can still count, as pairs of a time and an amount or a name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from docloom.operators.ordered import walk
from docloom.streaming import state
from docloom.streaming.state import ADMITTED, Held, Step


@dataclass(frozen=True)
class Quota:
    """A step from what is held and an event (id, time, cost) to (held, admitted, seconds to wait); how long an entry counts past its time; whether entries have names."""

    step: Step
    keep: int
    named: bool = False


def sliding_quota(limit: int, window: int) -> Quota:
    """At most ``limit`` admitted events in a window; a rejected one is told when the oldest leaves it."""

    def step(held: Held, event: tuple) -> tuple[Held, bool, int]:
        ts = event[1]
        held = [x for x in held if x[0] > ts - window]
        if len(held) < limit:
            return [*held, (ts, 1)], True, 0
        return held, False, max(1, held[0][0] + window - ts)

    return Quota(step, window)


def multi_bucket_quota(buckets: dict[str, tuple[int, int]]) -> Quota:
    """Several buckets (limit, window) with the event's cost: all admit and are charged, or none is; a rejected one waits for enough of the first full bucket to leave."""
    longest = max(w for _, w in buckets.values())

    def step(held: Held, event: tuple) -> tuple[Held, bool, int]:
        ts, cost = event[1], event[2]
        held = [x for x in held if x[0] > ts - longest]
        for limit, window in buckets.values():
            inside = [x for x in held if x[0] > ts - window]
            over = sum(x[1] for x in inside) + cost - limit
            if over > 0:
                for at, amount in inside:
                    over -= amount
                    if over <= 0:
                        return held, False, max(1, at + window - ts)
                return held, False, 1
        return [*held, (ts, cost)], True, 0

    return Quota(step, longest)


def lease_limit(most: int, ttl: int) -> Quota:
    """At most so many live leases; a release (cost below zero) frees the oldest."""

    def step(held: Held, event: tuple) -> tuple[Held, bool, int]:
        number, ts, cost = event
        held = [x for x in held if x[0] > ts]
        if cost < 0:
            return held[1:], True, 0
        if len(held) < most:
            return sorted([*held, (ts + ttl, number)]), True, 0
        return held, False, max(1, held[0][0] - ts)

    return Quota(step, 0, named=True)


def connection_counts(ttl: int) -> Quota:
    """Live connections (cost, closed if below zero) of a user; the number comes in place of the time to retry."""

    def step(held: Held, event: tuple) -> tuple[Held, bool, int]:
        ts, connection = event[1], event[2]
        live = [x for x in held if x[0] > ts and x[1] != abs(connection)]
        live = live if connection < 0 else sorted([*live, (ts + ttl, connection)])
        return live, True, len(live)

    return Quota(step, 0, named=True)


def admit(events: DataFrame, quota: Quota) -> DataFrame:
    """Batch: rows (key, event_id, ts, cost) with their admission; a task holds what can still count of one key.

    A null time counts as 0 and a null cost as none; a null key is a key, a null id stays null and comes first.
    """

    def one(held: Held, row: tuple) -> tuple[Held, list[tuple]]:
        key, ts, event_id, cost = row
        held, ok, retry = quota.step(held, (event_id, ts or 0, cost or 0))
        return held, [(key, event_id, ts, ok, retry)]

    return walk(events.select("key", "ts", "event_id", "cost"), ["key"], ["ts", "event_id"], list, one, ADMITTED)


def admit_stream(events: DataFrame, quota: Quota, late: str = "1 hour") -> DataFrame:
    """Stream: the same, with what is held as a list, or as a map by name, per key.

    Events of a micro-batch are taken in order, micro-batches as they come. When the watermark,
    ``late`` behind the newest event, passes all that a key holds, its state is gone; an event that
    comes when the watermark has passed it is dropped.
    """
    processor = (state.MapAdmission if quota.named else state.ListAdmission)(quota.step, quota.keep)
    return state.admitted(events, processor, late)
