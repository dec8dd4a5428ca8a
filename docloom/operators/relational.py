"""Joins, aggregates, windows, paging and set operations over the messaging and account tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.ordered import earlier, joined, split, walk, within


def role_rank() -> Column:
    return F.when(F.col("role") == "owner", 0).when(F.col("role") == "admin", 1).otherwise(2)


# Joins


def batch_enrich(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children's fields, empty where there are none. For children that a row of their parent can hold, as attachments of a message; others are joined as rows."""
    rows = children.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(rows, parents["id"] == rows["_key"], "left").drop("_key").withColumn(name, F.coalesce(name, F.array()))


def exact_pair(members: DataFrame, first: str, second: str) -> DataFrame:
    """Groups whose active members are exactly two given users."""
    both = F.count_if(F.col("user_id").isin(first, second))
    active = members.where("status = 'active'").groupBy("conversation_id").agg(F.count("*").alias("n"), both.alias("hits"))
    return active.where("n = 2 and hits = 2").select("conversation_id")


def head_of_line(rows: DataFrame, group: str, order: str, pending: Column) -> DataFrame:
    """Pending rows with no earlier pending row in their group."""
    live = rows.where(pending)
    first = live.groupBy(group).agg(F.min(order).alias("_first"))
    return live.join(first, group).where(F.col(order) == F.col("_first")).drop("_first")


def all_consented(participants: DataFrame) -> DataFrame:
    """Calls of two joined participants or more, all of whom consented."""
    joined = participants.where("status in ('joined', 'left')")
    return joined.groupBy("call_id").agg(F.count("*").alias("n"), F.count_if(~F.col("consented")).alias("without")).where("n >= 2 and without = 0").select("call_id", "n")


# Aggregates


def unread_counts(messages: DataFrame, members: DataFrame, read_state: DataFrame) -> DataFrame:
    """Per member and conversation: live messages of others after the read mark, and the latest live id."""
    live = messages.where("not deleted").select("conversation_id", "id", "sender_user_id")
    seen = members.where("status = 'active'").select("conversation_id", "user_id").join(read_state, ["conversation_id", "user_id"], "left")
    after = (F.col("id") > F.coalesce("last_read_message_id", F.lit(0))) & (F.col("sender_user_id") != F.col("user_id"))
    return seen.join(live, "conversation_id", "left").groupBy("conversation_id", "user_id").agg(F.count_if(after).alias("unread"), F.coalesce(F.max("id"), F.lit(0)).alias("latest_id"))


def members_json(members: DataFrame) -> DataFrame:
    """Organisation members as an ordered JSON array: by role, then by age. An organisation is one row, so it must have no more members than a row can hold; ``organization_members`` themselves are the form without that limit."""
    s = F.struct(role_rank().alias("rank"), "created_s", "id", "user_id", "role")
    rows = members.where("status <> 'removed'").groupBy("organization_id").agg(F.sort_array(F.collect_list(s)).alias("m"))
    line = F.transform("m", lambda x: F.concat_ws(":", x["user_id"].cast("string"), x["role"]))
    return rows.select("organization_id", F.size("m").alias("members"), F.array_join(line, ",").alias("ordered"))


def seat_counts(members: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s)
    return members.groupBy("organization_id").agg(
        status("active").alias("active"), status("invited").alias("invited"), (status("active") + status("invited")).alias("reserved"), F.count_if((F.col("role") == "owner") & (F.col("status") == "active")).alias("owners")
    )


def duplicate_content(files: DataFrame, order: str = "id") -> DataFrame:
    """Every later file of equal size and digest with the first one."""
    first = files.groupBy("file_size_bytes", "checksum").agg(F.min(order).alias("first_id"))
    return files.join(first, ["file_size_bytes", "checksum"]).where(F.col(order) != F.col("first_id")).select(F.col(order), "first_id")


# Windows


def verify_chain(events: DataFrame, hashed: Column, pieces: int | None = None) -> DataFrame:
    """Per organisation: events, invalid ones and the first invalid id of a hash chain.

    An event is valid if its stored previous hash is the hash of the event before it and its own
    hash is that of its canonical string. A crowded organisation is checked in pieces.
    """
    key = ["organization_id"]
    rows = earlier(split(events, key, "id", pieces), key, _last=(F.max_by(F.struct("event_hash"), "id"), F.last))
    before = F.coalesce(F.lag(F.struct("event_hash")).over(within(key, "id")), "_last")["event_hash"]
    rows = rows.withColumn("bad", ~(F.col("previous_hash").eqNullSafe(before) & (F.col("event_hash") == hashed)))
    return rows.groupBy("organization_id").agg(F.count("*").alias("total"), F.count_if("bad").alias("invalid"), F.min(F.when(F.col("bad"), F.col("id"))).alias("first_invalid"))


def build_chain(events: DataFrame) -> DataFrame:
    """Seal events (organization_id, id, canonical): each hash covers the one before, in order of id.

    A chain can only be sealed in order, so an organisation stays in one task, which holds the last hash.
    """

    def seal(before: str, row: tuple) -> tuple[str, list[tuple]]:
        sealed = hashlib.sha256(f"{before}|{row[2]}".encode()).hexdigest()
        return sealed, [(*row, before or None, sealed)]

    schema = "organization_id long, id long, canonical string, previous_hash string, event_hash string"
    return walk(events.select("organization_id", "id", "canonical"), ["organization_id"], ["id"], str, seal, schema)


def chained_hash() -> Column:
    """What an event's hash has to be in a chain of ``build_chain``."""
    return F.sha2(F.concat_ws("|", F.coalesce("previous_hash", F.lit("")), "canonical"), 256)


def first_per_key(rows: DataFrame, keys: list[str], order: str, taken: DataFrame | None = None) -> DataFrame:
    """The first row of each key; keys that are taken already give none."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    first = rows.withColumn("_n", n).where("_n = 1").drop("_n")
    return first if taken is None else first.join(taken, keys, "left_anti")


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "island", pieces: int | None = None) -> DataFrame:
    """Number runs of equal neighbouring values within a key, from 1; a crowded key is numbered in pieces along the first of ``order``."""
    place = F.struct(*order)
    rows = earlier(split(rows, keys, order[0], pieces), keys, _last=(F.max_by(F.struct(F.col(value).alias("v")), place), F.last))
    before = F.coalesce(F.lag(F.struct(F.col(value).alias("v"))).over(within(keys, *order)), "_last")
    marked = rows.withColumn("_change", F.when(before.isNotNull() & F.col(value).eqNullSafe(before["v"]), 0).otherwise(1)).drop("_last")
    marked = earlier(marked, keys, _changes=(F.sum("_change"), F.sum))
    number = F.coalesce("_changes", F.lit(0)) + F.sum("_change").over(within(keys, *order))
    return joined(marked.withColumn(name, number)).drop("_change", "_changes")


def usage_in_window(events: DataFrame, key: str, seconds: str, width: int, pieces: int | None = None) -> DataFrame:
    """Events of a key in the trailing window of each event, itself included; those without a time count each other.

    What a window holds is the number of events up to its end less those up to its beginning. Both
    are running counts of the times of a key and the beginnings of their windows, in one order, so
    a window may be longer than a piece of a crowded key.
    """
    counted = events.groupBy(F.col(key).alias("_key"), F.col(seconds).alias("_at")).agg(F.count("*").alias("_n"))
    timed = counted.where("_at is not null")
    ends = timed.select("_key", "_at", F.col("_at").alias("_of"), "_n")
    begins = timed.select("_key", (F.col("_at") - width).alias("_at"), F.col("_at").alias("_of"), F.lit(0).cast("long").alias("_n"))
    marks = earlier(split(ends.unionByName(begins), ["_key"], "_at", pieces), ["_key"], _before=(F.sum("_n"), F.sum))
    running = F.coalesce("_before", F.lit(0)) + F.sum("_n").over(within(["_key"], "_at"))
    marks = marks.withColumn("_up_to", running)
    held = marks.groupBy("_key", F.col("_of").alias("_at")).agg((F.max("_up_to") - F.min("_up_to")).alias("in_window"))
    held = held.unionByName(counted.where("_at is null").select("_key", "_at", F.col("_n").alias("in_window")))
    return events.join(held, F.col(key).eqNullSafe(F.col("_key")) & F.col(seconds).eqNullSafe(F.col("_at"))).drop("_key", "_at")


def sweep_merge(spans: DataFrame, key: str, pieces: int | None = None) -> DataFrame:
    """Merge strictly overlapping spans (key, start, end); touching spans stay apart. A crowded key is swept in pieces."""
    w = within([key], "start", F.desc("end"))
    rows = earlier(split(spans, [key], "start", pieces), [key], _reach=(F.max("end"), F.max))
    before = F.greatest("_reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = rows.withColumn("_new", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1)))
    marked = earlier(marked, [key], _groups=(F.sum("_new"), F.sum))
    groups = marked.withColumn("_group", F.coalesce("_groups", F.lit(0)) + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return groups.groupBy(key, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_group")


# Paging


def keyset_page(rows: DataFrame, size: int, before: int | None = None, after: int | None = None) -> DataFrame:
    """The page before an id, newest first, or the page after it, oldest first."""
    if before is not None:
        return rows.where(F.col("id") < before).orderBy(F.desc("id")).limit(size)
    return rows.where(F.col("id") > (after or 0)).orderBy("id").limit(size)


def keyset_page_composite(rows: DataFrame, cursor_s: int, cursor_id: int, size: int) -> DataFrame:
    """The page after a cursor (created_s, id), newest first, with one row more that tells of a next page."""
    return rows.where(F.struct("created_s", "id") < F.struct(F.lit(cursor_s).alias("created_s"), F.lit(cursor_id).alias("id"))).orderBy(F.desc("created_s"), F.desc("id")).limit(size + 1)


def schedule_order(links: DataFrame, now: Column, include_past: bool = True) -> DataFrame:
    """Upcoming links first, soonest first; then past ones, latest first; then by id, largest first."""
    end = F.col("start_s") + F.col("duration_minutes") * 60
    rows = links.withColumn("upcoming", end > now)
    rows = rows if include_past else rows.where("upcoming")
    return rows.orderBy(F.desc("upcoming"), F.when(F.col("upcoming"), F.col("start_s")).asc_nulls_last(), F.when(~F.col("upcoming"), F.col("start_s")).desc_nulls_last(), F.desc("id"))
