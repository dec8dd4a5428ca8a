"""Folds over the rows of a key, searches by automaton, and folders for files."""

import random

from docloom.operators import rules as R
from docloom.operators.ordered import walk
from docloom.plans import screening
from docloom.sources import scratch, tables


def test_state_is_carried_over_batches(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.randrange(9)) for k in "abcde" for t in rng.sample(range(1000), 40)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "key string, t long, n long").repartition(3)
        step = lambda total, row: (total + row[2], [(row[0], row[1], total + row[2])])
        got = walk(df, ["key"], ["t"], int, step, "key string, t long, total long", lambda total, last: [(last[0], -1, total)]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for k in "abcde":
        total = 0
        for _, t, n in sorted(r for r in rows if r[0] == k):
            total += n
            want.append((k, t, total))
        want.append((k, -1, total))
    assert sorted(map(tuple, got)) == sorted(want)


def test_too_many_rules_are_refused(spark, sf, monkeypatch):
    import pytest

    docs = tables.load(spark, sf, "documents")
    monkeypatch.setattr(R, "MOST_RULES", 3)
    with pytest.raises(ValueError):
        screening.results(docs)


def test_folders_are_new_and_shared(spark):
    a, b = scratch.folder(spark, "x"), scratch.folder(spark, "x")
    assert a != b and a.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_only_small_tables_are_dealt_out(spark, sf, monkeypatch):
    docs = tables.load(spark, sf, "documents")
    assert tables.spread(docs).rdd.getNumPartitions() == min(spark.sparkContext.defaultParallelism, 64)
    monkeypatch.setattr(tables, "SMALL_BYTES", 10)
    assert tables.spread(docs).rdd.getNumPartitions() == docs.rdd.getNumPartitions()
