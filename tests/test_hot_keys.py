"""One key with all rows is cut to pieces: same rows, whatever lies at the borders."""

import random
from collections import defaultdict

import pytest
from docloom.operators import ordered as O
from docloom.operators import relational as R
from docloom.operators import words as W
from docloom.streaming import events as E
from pyspark.sql import Window
from pyspark.sql import functions as F

PIECES = 7


def rows(n=600, keys=(1, 1, 1, 1, 1, 1, 2, None), spread=900):
    rng = random.Random(11)
    return [(rng.choice(keys), rng.randrange(spread), i, rng.choice("aab"), rng.randrange(50)) for i in range(n)]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(rows(), "k long, at long, id long, v string, n long").repartition(3)


def test_a_crowded_key_uses_every_task(spark):
    one = spark.range(10_000).select(F.lit(5).alias("k"), F.col("id"))
    sizes = [r["count"] for r in O.split(one, ["k"], "id", PIECES).groupBy("_piece").count().collect()]
    assert len(sizes) == PIECES and max(sizes) < 1.2 * 10_000 / PIECES
    two = one.unionByName(spark.range(90_000).select((F.col("id") % 900 + 10).alias("k"), "id"))
    shares = O.split(two, ["k"], "id", PIECES).groupBy("k").agg(F.max("_piece").alias("p")).collect()
    assert {r["p"] for r in shares} == {0}


def test_many_pieces_are_numbered_in_two_steps(spark):
    one = spark.range(5_000).select(F.lit(5).alias("k"), F.col("id"))
    got = O.split(one, ["k"], "id", 200)
    ends = got.groupBy("_piece").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("_piece").collect()
    assert len(ends) == 200 and all(x["b"] < y["a"] for x, y in zip(ends, ends[1:]))


def test_islands(spark, table):
    got = {(r["k"], r["id"]): r["island"] for r in R.islands(table, ["k"], ["at", "id"], "v", pieces=PIECES).collect()}
    by = defaultdict(list)
    for k, at, i, v, _ in rows():
        by[k].append((at, i, v))
    for k, mine in by.items():
        n, last = 0, None
        for _, i, v in sorted(mine):
            n += v != last
            last = v
            assert got[(k, i)] == n
    assert set(R.islands(table, ["k"], ["at", "id"], "v").columns) == {*table.columns, "island"}


def test_running_counts(table):
    got = {r["id"]: r["in_window"] for r in R.usage_in_window(table, "k", "at", 400, PIECES).collect()}
    data = rows()
    assert got == {i: sum(k2 == k and at - 400 < at2 <= at for k2, at2, *_ in data) for k, at, i, *_ in data}


def test_sweep(spark, table):
    spans = table.select("k", F.col("at").alias("start"), (F.col("at") + F.col("n") % 4).alias("end"))
    got = sorted(map(tuple, R.sweep_merge(spans, "k", PIECES).collect()), key=str)
    by = defaultdict(list)
    for k, at, _, _, n in rows():
        by[k].append((at, at + n % 4))
    want = []
    for k, mine in by.items():
        open_ = None
        for a, b in sorted(mine, key=lambda s: (s[0], -s[1])):
            if open_ and a < open_[1]:
                open_ = (open_[0], max(open_[1], b), open_[2] + 1)
            else:
                want += [(k, *open_)] if open_ else []
                open_ = (a, b, 1)
        want.append((k, *open_))
    assert got == sorted(want, key=str)


def test_stale_events(table):
    got = sorted(r["id"] for r in E.reject_stale(table, "k", "id", "at", PIECES).collect())
    newest, want = defaultdict(lambda: -1), []
    for k, at, i, *_ in sorted(rows(), key=lambda r: r[2]):
        want += [i] if at >= newest[k] else []
        newest[k] = max(newest[k], at)
    assert got == want


def test_chain_of_one_organisation(spark):
    events = spark.range(300).select(F.lit(None).cast("long").alias("organization_id"), (F.col("id") + 2**53).alias("id"), F.concat(F.lit("e"), "id").alias("canonical"))
    sealed = R.build_chain(events)
    assert [tuple(r) for r in R.verify_chain(sealed, R.chained_hash(), PIECES).collect()] == [(None, 300, 0, None)]
    torn = sealed.withColumn("previous_hash", F.when(F.col("id") == 2**53 + 150, F.lit("x")).otherwise(F.col("previous_hash")))
    assert [tuple(r) for r in R.verify_chain(torn, R.chained_hash(), PIECES).collect()] == [(None, 300, 1, 2**53 + 150)]


def test_speaker_blocks_of_one_recording(spark):
    rng = random.Random(3)
    said = [("m", float(i), float(i) + 0.5, f"w{i}", rng.choice([0, 0, 1, None])) for i in range(400)]
    df = spark.createDataFrame(said, "media_id string, start_s double, end_s double, text string, speaker int").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(PIECES))
    try:
        got = sorted((r["block"], r["speaker"], r["text"]) for r in W.speaker_blocks(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = []
    for _, _, _, text, who in said:
        if want and want[-1][1] == who:
            want[-1][2].append(text)
        else:
            want.append((len(want) + 1, who, [text]))
    assert got == [(n, who, " ".join(t)) for n, who, t in want]


def test_an_empty_table(spark, table):
    none = table.where("false")
    assert R.islands(none, ["k"], ["at", "id"], "v", pieces=PIECES).count() == 0 and R.usage_in_window(none, "k", "at", 5, PIECES).count() == 0


def test_windows_run_by_piece(spark, table):
    plan = R.islands(table, ["k"], ["at", "id"], "v", pieces=PIECES)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_piece" in line or "_p#" in line for line in plan.splitlines() if "windowspecdefinition" in line) and Window is not None
