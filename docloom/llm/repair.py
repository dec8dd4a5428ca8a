"""Repair of conversations: the cheapest edits that give every conversation a legal order of roles.

A repair is a derivation. Items say that the rows so far leave the conversation in a state of the
grammar ``(s?(ua)+)?``; deductions add one edit, or one solved block of rows, to an item. Their
weights are (cost, audit), and a deduction never makes a weight smaller and keeps the order of
weights, so the agenda pops every item at its lightest weight: Knuth's generalisation of shortest
paths. Two derivations of one item never have audits of which one begins with the other at equal
cost, as an insertion more costs more; so appending keeps the order of the audits.

Rows are dealt out by ranges of conversation and turn. A conversation inside one range is solved
there; of one that goes over a border, or is long, each block of rows is solved for each pair of
states, and the blocks are deduced in turn as rows are, so no task gathers a conversation.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.frames import map_frames, plain_rows
from docloom.llm.common import Scratch, pick, table, with_key_value
from docloom.operators.ordered import walk

#: States of the grammar: nothing said, after the system, after the user, after the assistant; a conversation may end in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What may follow a state at the end: the cost and audit of the insertions that close it.
CLOSED = {START: (0, ""), ASSISTANT: (0, ""), USER: (2, "I"), SYSTEM: (4, "II")}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: Rows and code points of a block.
BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 20
_SEEN, _LAST = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")

Weight = tuple[int, str]
Item = tuple[int, int]


def lightest(axioms: Iterable[tuple[Item, Weight]], deduce: Callable[[Item], Iterable[tuple[Item, Weight]]], goal: Callable[[Item], bool] | None = None) -> tuple[dict[Item, Weight], dict[Item, Item]]:
    """Knuth's agenda: items with their lightest weights, and the item that each came from.

    ``deduce`` gives, for an item that is final, conclusions with the weight that the deduction adds.
    It ends when an item is a goal, or when nothing is left.
    """
    agenda: list[tuple[Weight, Item, Item | None]] = []
    for item, weight in axioms:
        heappush(agenda, (weight, item, item))
    final, came = {}, {}
    while agenda:
        weight, item, of = heappop(agenda)
        if item in final:
            continue
        final[item], came[item] = weight, of
        if goal and goal(item):
            break
        for conclusion, (cost, audit) in deduce(item):
            if conclusion not in final:
                heappush(agenda, ((weight[0] + cost, weight[1] + audit), conclusion, item))
    return final, came


def row_deductions(row: tuple[str, str]) -> dict[int, list[tuple[int, Weight]]]:
    """What the edits of a row (initial, fault) make of each state: (state, weight)."""
    initial, fault = row
    out: dict[int, list[tuple[int, Weight]]] = {q: [(q, (DELETE, "D"))] for q in STATES}
    if fault not in ("blank", "duplicate"):
        more = CUT_OFF if fault == "truncated" else 0
        for q in STATES:
            if (to := MOVES.get(initial, {}).get(q)) is not None:
                out[q].append((to, (more, "K")))
            for role in "ua":
                if (to := MOVES[role].get(q)) is not None:
                    out[q].append((to, (REROLE + more, "R")))
    return out


INSERTIONS = {q: [(to, (INSERT, "I")) for role in "ua" if (to := MOVES[role].get(q)) is not None] for q in STATES}
_KNOWN_ROWS: dict[tuple[str, str], dict] = {}


def solve_block(rows: list[tuple[str, str]], start: int) -> dict[int, Weight]:
    """The lightest weight of each state after rows (initial, fault) that begin in a state; insertions stand before rows."""
    steps = []
    for r in rows:
        key = (r[0] if r[0] in MOVES else "", r[1])
        if key not in _KNOWN_ROWS:
            _KNOWN_ROWS[key] = row_deductions(key)
        steps.append(_KNOWN_ROWS[key])
    n = len(rows)

    def deduce(item: Item) -> Iterator[tuple[Item, Weight]]:
        at, q = item
        if at < n:
            yield from (((at, to), w) for to, w in INSERTIONS[q])
            yield from (((at + 1, to), w) for to, w in steps[at][q])

    final, _ = lightest([((0, start), (0, ""))], deduce)
    return {q: final[n, q] for q in STATES if (n, q) in final}


def close(ends: dict[int, Weight]) -> tuple[int, Weight]:
    """The state whose closing is lightest, with the whole weight."""
    return min(((q, (c + CLOSED[q][0], a + CLOSED[q][1])) for q, (c, a) in ends.items()), key=lambda x: x[1])


def applied(rows: list[tuple[str, str]], audit: str, state: int) -> tuple[list[str], int]:
    """Lines ``role:text`` of repaired rows, and the state after them."""
    out, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else "a" if state == USER else "u"
        state = MOVES[initial][state]
        out.append(f"{role if edit == 'K' else 'assistant' if initial == 'a' else 'user'}:{text}")
    return out, state


# Damage


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy) after damage by crc32 of ``conv_id:turn``, modulo 20; a null counts as one space.

    0 drops a row, 1 empties its text, 2 removes its ends of sentences, 3 repeats it, 4 makes it the user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    marked = pick(rows, conv_id="conv_id", turn="turn", role="role", text="text").withColumn("_kind", kind).withColumn("_at", F.monotonically_increasing_id())
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(blank("role"))
    copies = F.when(F.col("_kind") == 0, F.array().cast("array<int>")).when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    damaged = marked.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), "_at", F.explode(copies).alias("_copy"))
    return damaged.withColumn("_at", F.col("_at") * 2 + F.col("_copy")).drop("_copy")


def with_duplicates(damaged: DataFrame) -> DataFrame:
    """Rows with ``digest`` of role and text, and ``duplicate``: whether the conversation has both in an earlier row.

    The first row of a key is a minimum over salted parts, so a role and text that most rows share
    doesn't meet in one task.
    """
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = damaged.withColumn("digest", digest).withColumn("_key", F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), "digest"))
    place = F.struct("turn", "_at")
    marked = with_key_value(rows, "_key", F.xxhash64("_at"), {"_first": F.min(place)}, {"_first": F.min("_first")})
    return marked.withColumn("duplicate", F.col("_first._at") != F.col("_at")).drop("_key", "_first")


# Blocks

BLOCK = (
    "conv_id long, part int, seq long, whole boolean, n long, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired string, ends array<struct<start:int,state:int,cost:long,audit:string>>, rows array<struct<role:string,text:string>>"
)


def fault_of(text: str, duplicate: bool) -> str:
    """The first fault that a row has."""
    if not _SEEN.search(text):
        return "blank"
    if duplicate:
        return "duplicate"
    return "" if _LAST.search(text)[1] in ".!?" else "truncated"


def block_row(conv: int | None, part: int, seq: int, rows: list[tuple], whole: bool) -> tuple:
    """A block's counts, and its repair if it is a whole conversation, else its weights between states and its rows."""
    faults = [fault_of(text, dup) for _, _, text, dup in rows]
    initials = [role[:1] for _, role, _, _ in rows]
    turns = [t for t, *_ in rows if t is not None]
    counted = [sum(f == kind for f in faults) for kind in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    head = (conv, part, seq, whole, len(rows), initials[0], initials[-1], min(turns, default=None), max(turns, default=None), len(set(turns)), *counted, illegal)
    said = [(role, text) for _, role, text, _ in rows]
    pairs = list(zip(initials, faults))
    if whole:
        cost, audit = close(solve_block(pairs, START))[1]
        return (*head, cost, audit, "\n".join(applied(said, audit, START)[0]), None, None)
    ends = [{"start": p, "state": q, "cost": c, "audit": a} for p in STATES for q, (c, a) in solve_block(pairs, p).items()]
    return (*head, None, None, None, ends, [{"role": r, "text": t} for r, t in said])


def blocks(rows: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of rows (conv_id, turn, role, text, duplicate, digest, _at), in order of (part, seq) within a conversation.

    Rows are dealt out by ranges of their whole order, so rows of one conversation go to many tasks
    if it is large. Rows of equal turn are in order of role and digest of the text.
    """
    order = ["conv_id", "turn", "role", "digest", "_at"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("conv_id", "turn", "role", "text", "duplicate", "digest", "_at").repartitionByRange(n, *order).sortWithinPartitions(*order).drop("digest", "_at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        from pyspark import TaskContext

        part, seq, held, chars, conv, begun, first = TaskContext.get().partitionId(), 0, [], 0, None, True, True
        for b in batches:
            made = []
            for c, turn, role, text, duplicate in plain_rows(b):
                ends = bool(held) and c != conv
                if ends or len(held) >= most or chars >= BLOCK_CHARS:
                    # the first conversation of a range may have begun in another
                    made.append(block_row(conv, part, seq, held, ends and begun and not first))
                    first, begun = first and not ends, ends
                    seq, held, chars = seq + 1, [], 0
                conv = c
                held.append((turn, role, text, duplicate))
                chars += len(text)
            yield made
        if held:
            yield [block_row(conv, part, seq, held, False)]

    return map_frames(dealt, run, BLOCK)


# Conversations of several blocks

CHOICE = "conv_id long, part int, seq long, entry int, slice string, n long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def choose(parted: DataFrame) -> DataFrame:
    """How each block of a conversation is entered and edited; the row with a null part has the conversation's sums.

    Blocks are folded in order. The state holds the lightest weight of each state of the grammar:
    what all audits have in common is put aside, so they stay short, and a conversation's blocks
    leave a few numbers each.
    """

    def begin() -> dict:
        return {"ends": {START: (0, "")}, "trunk": [], "blocks": [], "sums": [0] * 5, "low": None, "high": None, "turns": 0, "last": None, "cost": 0}

    def step(s: dict, row: tuple) -> tuple[dict, list[tuple]]:
        _, part, seq, n, first, last, low, high, turns, blank, duplicate, truncated, illegal, ends = row
        found: dict[int, list] = {}
        for e in ends:
            found.setdefault(e["start"], []).append(((1, e["state"]), (e["cost"], e["audit"])))
        final, came = lightest([((0, q), w) for q, w in s["ends"].items()], lambda item: found.get(item[1], ()) if item[0] == 0 else ())
        s["ends"] = {q: w for (at, q), w in final.items() if at == 1}
        s["blocks"].append((part, seq, n, {q: came[1, q][1] for q in s["ends"]}))
        common = os.path.commonprefix([a for _, a in s["ends"].values()])
        if common:
            s["trunk"].append(common)
            s["ends"] = {q: (c, a[len(common) :]) for q, (c, a) in s["ends"].items()}
        border = 0 if s["last"] is None else int(s["last"] + first not in LEGAL)
        s["sums"] = [x + y for x, y in zip(s["sums"], (n, blank, duplicate, truncated, illegal + border))]
        if turns:
            s["turns"] += turns - (s["high"] == low)
            s["low"] = low if s["low"] is None else s["low"]
            s["high"] = high
        s["last"] = last
        return s, []

    def end(s: dict, row: tuple) -> list[tuple]:
        state, (cost, tail) = close(s["ends"])
        audit = "".join([*s["trunk"], tail])
        entries = []
        for part, seq, n, came in reversed(s["blocks"]):
            state = came[state]
            entries.append((part, seq, n, state))
        out, at = [], 0
        for part, seq, n, entry in reversed(entries):
            to, seen = at, 0
            while seen < n:
                seen += audit[to] != "I"
                to += 1
            out.append([row[0], part, seq, entry, audit[at:to]] + [None] * 10)
            at = to
        out[-1][4] += audit[at:]
        n, blank, duplicate, truncated, illegal = s["sums"]
        return [*map(tuple, out), (row[0], None, None, None, None, n, s["low"], s["high"], s["turns"], blank, duplicate, truncated, illegal, cost, audit)]

    columns = ["conv_id", "part", "seq", "n", "first", "last", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "ends"]
    return walk(parted.select(*columns), ["conv_id"], ["part", "seq"], begin, step, CHOICE, end)


def edited(parted: DataFrame, choices: DataFrame) -> DataFrame:
    """Rows (conv_id, part, seq, lines) of blocks after their edits; null lines where every row was deleted."""
    edits = choices.where("part is not null").select("part", "seq", "entry", "slice")
    rows = parted.select("conv_id", "part", "seq", "rows").join(edits, ["part", "seq"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        for b in batches:
            yield [(c, p, s, "\n".join(lines) if (lines := applied([(x["role"], x["text"]) for x in said], audit, entry)[0]) else None) for c, p, s, said, entry, audit in plain_rows(b)]

    return map_frames(rows.select("conv_id", "part", "seq", "rows", "entry", "slice"), run, "conv_id long, part int, seq long, lines string")


def joined_digests(pieces: DataFrame) -> DataFrame:
    """Rows (conv_id, sha): the digest of each conversation's lines, read block by block in order."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        digest, any_ = state
        if row[3] is not None:
            digest.update((("\n" if any_ else "") + row[3]).encode())
            any_ = True
        return (digest, any_), []

    return walk(pieces, ["conv_id"], ["part", "seq"], lambda: (hashlib.sha256(), False), step, "conv_id long, sha string", lambda s, last: [(last[0], s[0].hexdigest())])


NOTHING = hashlib.sha256(b"").hexdigest()


def solve(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The damaged rows as written blocks, and the written choices for conversations of several blocks."""
    scratch = Scratch(rows.sparkSession, "repair")
    made = scratch.write(blocks(with_duplicates(damage(rows)), block_rows), "blocks")
    return made, scratch.write(choose(made.where("not whole")), "choices")


def repaired(made: DataFrame, choices: DataFrame) -> DataFrame:
    """Rows (conv_id, part, seq, lines): the lines ``role:text`` of repaired conversations, in one piece or in several in order of (part, seq)."""
    whole = made.where("whole").select("conv_id", "part", "seq", F.col("repaired").alias("lines"))
    return whole.unionByName(edited(made.where("not whole"), choices))


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one per original conversation.

    Nulls in role and text are one space; a null conversation is one of its own and null turns come
    first. A role without a first letter can't be kept. Rows of equal turn are in order of role
    and digest of the text; rows alike are duplicates of the first. A conversation without a row after the damage has zeros, an
    empty audit and the digest of an empty string. The audit is one string with a letter per row, so a
    conversation's result is as long as that. ``repaired`` gives the texts.
    """
    rows = pick(rows, conv_id="conv_id", turn="turn", role="role", text="text")
    made, choices = solve(rows, block_rows)
    columns = ["conv_id", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    digests = joined_digests(edited(made.where("not whole"), choices)).select(F.col("conv_id").alias("_c"), "sha")
    long_ = choices.where("part is null").select(*columns).join(digests, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    found = made.where("whole").select(*columns, F.sha2("repaired", 256).alias("sha")).unionByName(long_).withColumnRenamed("conv_id", "_c")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counts = [zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = zero(F.col("high") - F.col("low") + 1 - F.col("turns"))
    return out.select("conv_id", gaps.alias("gaps"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(NOTHING)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
