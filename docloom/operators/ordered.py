"""Rows of a key taken in order, whatever share of all rows one key holds.

``walk`` folds a key's rows one after the other, for what only a sequence can say. ``split`` and
``earlier`` serve what a window can say of a part of a key: a crowded key is cut to pieces along
its order, windows work within the pieces, and what the earlier pieces give is carried over the
borders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docloom.frames import map_frames, plain_rows


def walk(rows: DataFrame, keys: list[str], order: list[str], begin: Callable[[], object], step: Callable[[object, tuple], tuple[object, list[tuple]]], schema: str, end: Callable[[object, tuple], list[tuple]] | None = None) -> DataFrame:
    """Fold the rows of each key in order: ``step(state, row)`` gives the next state and rows to return.

    Rows are dealt out by key, sorted, and read in batches, so a task holds a batch and one state,
    however many rows a key has; ``end(state, last row)`` gives what is left when a key is over. A
    key's rows are one sequence and stay in one task. Nulls are None in a row, and a null key is a key.
    """
    at = [rows.columns.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        key, state, last = None, None, None
        for b in batches:
            made: list[tuple] = []
            for row in plain_rows(b):
                now = tuple(row[i] for i in at)
                if now != key:
                    if key is not None and end:
                        made += end(state, last)
                    key, state = now, begin()
                state, more = step(state, row)
                made += more
                last = row
            yield made
        if key is not None and end:
            yield end(state, last)

    return map_frames(rows.repartition(*keys).sortWithinPartitions(*keys, *order), run, schema)


#: A crowded key is cut to so many pieces at most; also the borders of one key that a row is compared with, in two steps.
MOST_PIECES, STEP = 1_024, 32


def split(rows: DataFrame, keys: list[str], order: str, pieces: int | None = None) -> DataFrame:
    """Rows with ``_piece``, the number of their part of the key along ``order``, and ``_crowded``, whether the key has several.

    A key is crowded if it holds more than its share, one of ``pieces`` (as many as there are shuffle
    partitions), so there are fewer crowded keys than that, and twice as many pieces at most; this
    table is broadcast. Borders are approximate quantiles of the order, cast to double; rows alike
    in order lie in one piece, as do nulls, in the first. A null key is a key.
    """
    pieces = min(pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_PIECES)
    if pieces < 2:
        return rows.withColumn("_piece", F.lit(0)).withColumn("_crowded", F.lit(False))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    counts = rows.groupBy(*named).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    crowded = counts.join(F.broadcast(total), F.col("_n") * pieces > F.col("_total"))
    fits = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    place = F.col(order).cast("double")
    theirs = rows.select(*keys, place.alias("_place")).join(F.broadcast(crowded), fits)
    names = [f"_k{i}" for i in range(len(keys))]
    at = F.percentile_approx("_place", [i / pieces for i in range(1, pieces)], 100 * pieces)
    borders = theirs.groupBy(*names).agg(at.alias("_all"), F.first("_n").alias("_n"), F.first("_total").alias("_total"))
    stride = F.greatest(F.lit(1), F.floor(F.col("_total") / F.col("_n")).cast("int"))
    kept = F.array_sort(F.array_distinct(F.filter(F.coalesce("_all", F.array().cast("array<double>")), lambda x, i: (i + 1) % stride == 0)))
    borders = borders.select(*names, kept.alias("_borders"))
    coarse = F.filter("_borders", lambda x, i: (i % STEP == 0) & (x <= place))
    fine = F.filter(F.slice("_borders", F.greatest(F.lit(0), F.size(coarse) - 1) * STEP + 1, F.lit(STEP)), lambda x: x <= place)
    number = F.greatest(F.lit(0), F.size(coarse) - 1) * STEP + F.size(fine)
    marked = rows.join(F.broadcast(borders), fits, "left")
    return marked.withColumn("_crowded", F.col("_borders").isNotNull()).withColumn("_piece", F.when(F.col("_crowded"), number).otherwise(0)).drop(*names, "_borders")


def within(keys: list[str], *order: str | Column) -> WindowSpec:
    """The window of a row's piece."""
    return Window.partitionBy(*keys, "_piece").orderBy(*order)


def earlier(rows: DataFrame, keys: list[str], **found: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """Add columns with what all earlier pieces of the key give, null in the first piece.

    Each is (aggregate of a piece, aggregate of pieces), such as (max(x), max), or (the last row, last).
    One row per piece of a crowded key is broadcast, two times the number of pieces at most.
    """
    parts = rows.where("_crowded").groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_p")).agg(*[a.alias(n) for n, (a, _) in found.items()])
    names = [f"_k{i}" for i in range(len(keys))]
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*names, "_p", *[over(n).over(before).alias(n) for n, (_, over) in found.items()])
    fits = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(F.broadcast(carried), [*fits, F.col("_piece") == F.col("_p")], "left").drop(*names, "_p")


def joined(rows: DataFrame) -> DataFrame:
    """Rows without the columns that ``split`` added."""
    return rows.drop("_piece", "_crowded")
