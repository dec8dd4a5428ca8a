"""Streams in shuffled micro-batches against their batch twins, and quotas against their promise."""

import random
from collections import defaultdict

import pytest
from docloom.operators.business import Reset
from docloom.streaming import devices as D
from docloom.streaming import events as E
from docloom.streaming import quotas as K
from docloom.streaming import state as S
from docloom.streaming import upsert as U
from pyspark.sql import functions as F

SCHEMA = "key string, event_id long, ts long, cost long"


def sample(n=200):
    rng = random.Random(6)
    return sorted([(f"k{rng.randrange(4)}", i, rng.randrange(1, 2000), rng.randint(1, 3)) for i in range(n)], key=lambda r: (r[2], r[1]))


def stream(spark, folder, rows, parts=4):
    for i in range(parts):
        spark.createDataFrame(rows[len(rows) * i // parts : len(rows) * (i + 1) // parts], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def finish(df, folder, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    assert q.awaitTermination(120)


@pytest.mark.parametrize("name, quota", [("sliding", K.sliding_quota(3, 300)), ("buckets", K.multi_bucket_quota({"a": (5, 100), "b": (12, 900)})), ("lease", K.lease_limit(2, 200)), ("live", K.connection_counts(150))])
def test_stream_equals_batch(spark, tmp_path, name, quota):
    rows = sample()
    batch = {tuple(r) for r in K.admit(spark.createDataFrame(rows, SCHEMA), quota).collect()}
    finish(K.admit_stream(stream(spark, tmp_path, rows), quota, "1 second"), tmp_path, f"q_{name}")
    assert {tuple(r) for r in spark.table(f"q_{name}").collect()} == batch and len(batch) == len(rows)


def test_quota_is_kept(spark):
    got = defaultdict(list)
    for r in K.admit(spark.createDataFrame(sample(), SCHEMA), K.sliding_quota(3, 300)).collect():
        if r["admitted"]:
            got[r["key"]].append(r["ts"])
        else:
            assert r["retry_s"] >= 1
    for times in got.values():
        assert all(sum(t - 300 < x <= t for x in times) <= 3 for t in times)


def test_repeated_events(spark, tmp_path):
    rows = sample(60)
    df = stream(spark, tmp_path, rows + rows[:20]).withColumn("time", F.timestamp_seconds(F.col("ts") + 1_700_000_000))
    finish(E.idempotent_stream(df, ["event_id"], "time"), tmp_path, "q_once")
    assert sorted(r["event_id"] for r in spark.table("q_once").collect()) == list(range(60))


def test_read_marks(spark, tmp_path):
    rows = sample(60)
    finish(E.read_marks(stream(spark, tmp_path, rows), ["key"], "event_id"), tmp_path, "q_marks", "complete")
    want = defaultdict(int)
    for k, i, *_ in rows:
        want[k] = max(want[k], i)
    assert {r["key"]: r["event_id"] for r in spark.table("q_marks").collect()} == want


def test_state_of_an_idle_key_is_gone(spark, tmp_path):
    """The watermark passes what key a holds; key b is still live."""
    rows = [("a", 1, 10, 1), ("b", 2, 20, 1), ("b", 3, 5000, 1), ("b", 4, 5001, 1)]
    for i, (name, quota, variable) in enumerate([("gone_list", K.sliding_quota(3, 300), "held"), ("gone_map", K.lease_limit(2, 200), "held")]):
        folder = tmp_path / str(i)
        finish(K.admit_stream(stream(spark, folder, rows), quota, "1 second"), folder, name)
        held = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", variable).load()
        assert {r["key"]["key"] for r in held.select("key").collect()} == {"b"}
        assert {tuple(r) for r in spark.table(name).collect()} == {tuple(r) for r in K.admit(spark.createDataFrame(rows, SCHEMA), quota).collect()}


def test_stale_events_of_a_stream(spark, tmp_path):
    """Arrivals out of order of time, over several micro-batches; the batch twin gives the same."""
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(3)}", i, rng.randrange(500), 1) for i in range(120)]
    finish(S.fresh(stream(spark, tmp_path, rows), keep=10_000, late="1000 seconds"), tmp_path, "q_fresh")
    batch = E.reject_stale(spark.createDataFrame(rows, SCHEMA), "key", "event_id", "ts")
    assert sorted(r["arrival"] for r in spark.table("q_fresh").collect()) == sorted(r["event_id"] for r in batch.collect())


CHANGES = "aggregate_id string, id long, status string, available_s long, sequence long"


def test_outbox_of_a_stream(spark, tmp_path):
    """Each aggregate's events go out one after the other, whatever the order of what is told."""
    rng = random.Random(5)
    changes, waiting, want = [], defaultdict(dict), []
    told: dict[str, int | None] = {}
    for batch in range(4):
        for _ in range(25):
            a, i = f"a{rng.randrange(3)}", rng.randrange(30)
            status = rng.choice(["pending", "pending", "delivered", "dead"])
            changes.append((a, i, status, i * 10, len(changes)))
        mine = defaultdict(list)
        for c in changes[25 * batch :]:
            mine[c[0]].append(c)
        for a, cs in mine.items():
            for _, i, status, at, _ in sorted(cs, key=lambda c: (c[1], c[4])):
                if status == "pending":
                    waiting[a][i] = at
                else:
                    waiting[a].pop(i, None)
            head = min(waiting[a], default=None)
            if head is not None and head != told.get(a):
                want.append((a, head, waiting[a][head]))
            told[a] = head
    for i in range(4):
        spark.createDataFrame(changes[25 * i : 25 * i + 25], CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    df = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    finish(S.outbox_heads(df), tmp_path, "q_outbox")
    assert sorted(map(tuple, spark.table("q_outbox").collect())) == sorted(want)


# Devices


def plain_binding(rows, most, ttl):
    """One by one: a device has one user, a user a few devices."""
    owner, slots, out = {}, defaultdict(dict), set()
    for user, device, ts, i in sorted(rows, key=lambda r: (r[2], r[3])):
        bound = owner.get(device)
        live = {d: e for d, e in slots[user].items() if e > ts}
        if bound and bound[1] > ts and bound[0] != user:
            out.add((user, device, i, ts, False, "other_user"))
        elif device not in live and len(live) >= most:
            out.add((user, device, i, ts, False, "no_room"))
        else:
            owner[device], live[device] = (user, ts + ttl), ts + ttl
            out.add((user, device, i, ts, True, None))
        slots[user] = live
    return out


DEVICES = "key string, device string, ts long, event_id long"


def device_events(n=400, users=12, devices=20):
    rng = random.Random(n)
    return [(f"u{rng.randrange(users)}", f"d{rng.randrange(devices)}", rng.randrange(3000), i) for i in range(n)]


@pytest.mark.parametrize("most, ttl", [(1, 200), (2, 400), (3, 5000)])
def test_devices_equal_a_simulation(spark, most, ttl):
    rows = device_events()
    made, bindings = D.bind(spark.createDataFrame(rows, DEVICES).repartition(3), most, ttl)
    want = plain_binding(rows, most, ttl)
    assert {tuple(r) for r in made.collect()} == want and {r[5] for r in want} == {"other_user", "no_room", None}
    held = defaultdict(set)
    for r in bindings.collect():
        held[r["device"]].add(r["key"])
    assert all(len(users) == 1 for users in held.values())


def test_a_device_of_another_user_is_refused(spark):
    rows = [("u", "d7", 100, 1), ("v", "d7", 101, 2), ("v", "d7", 401, 3), (None, "d7", 402, 4)]
    made, _ = D.bind(spark.createDataFrame(rows, DEVICES), 3, 300)
    assert {(r["event_id"], r["admitted"], r["reason"]) for r in made.collect()} == {(1, True, None), (2, False, "other_user"), (3, True, None), (4, False, "other_user")}


def test_devices_of_a_stream(spark, tmp_path):
    rows = sorted(device_events(160), key=lambda r: (r[2], r[3]))
    for i in range(4):
        spark.createDataFrame(rows[40 * i : 40 * i + 40], DEVICES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    df = spark.readStream.schema(DEVICES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = D.bind_stream(df, f"{tmp_path}/devices", 2, 400).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    made = U.Versions(spark, f"{tmp_path}/devices/decisions", keep=99).all_rows()
    assert {tuple(r) for r in made.select("key", "device", "event_id", "ts", "admitted", "reason").collect()} == plain_binding(rows, 2, 400)


# Upserts

RULES = {"at": "greatest", "plan": "overwrite", "made": "keep", "error": Reset("n.at > o.at")}
STATE = "id long, at long, plan string, made string, error string"


def test_rules_of_an_upsert(spark):
    old = spark.createDataFrame([(1, 5, "a", "m1", "bad"), (2, 5, "a", "m1", "bad"), (3, 9, "a", "m1", "bad"), (None, 1, "n", "m", "e")], STATE)
    new = spark.createDataFrame([(2, 6, "b", "m2", "new"), (3, 8, "b", "m2", "new"), (4, 1, "c", "m3", "first"), (None, 2, "x", "y", "z")], STATE)
    got = {r["id"]: tuple(r)[1:] for r in U.merge_upsert(old, new, "id", RULES).collect()}
    assert got == {1: (5, "a", "m1", "bad"), 2: (6, "b", "m1", None), 3: (9, "b", "m1", "bad"), 4: (1, "c", "m3", "first"), None: (2, "x", "m", None)}


def test_a_batch_given_twice_changes_nothing(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(6), i, f"p{i}", f"m{i}", f"e{i}") for i in range(60)]
    for i in range(3):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], STATE).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    df = spark.readStream.schema(STATE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    writer = U.upsert_stream(df, f"{tmp_path}/table", "id", "at", RULES)
    q = writer.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    table = U.Versions(spark, f"{tmp_path}/table")
    want = {}
    for i in range(3):
        last = {r[0]: r for r in sorted(rows[20 * i : 20 * i + 20], key=lambda r: r[1])}
        for k, r in last.items():
            o = want.get(k)
            want[k] = r if o is None else (k, max(o[1], r[1]), r[2], o[3], None if r[1] > o[1] else o[4])
    assert {tuple(r) for r in table.rows().select("id", *RULES).collect()} == set(want.values()) and table.numbers() == [0, 1, 2]
    # the same batches again, under their numbers, by a stream that lost its checkpoint
    again = U.upsert_stream(df, f"{tmp_path}/table", "id", "at", RULES).option("checkpointLocation", f"{tmp_path}/other").trigger(availableNow=True).start()
    assert again.awaitTermination(120)
    assert {tuple(r) for r in table.rows().select("id", *RULES).collect()} == set(want.values())


def test_a_version_half_written_is_written_again(spark, tmp_path):
    table = U.Versions(spark, str(tmp_path / "t"), keep=2)
    for n in range(4):
        table.write(spark.range(n + 1), n)
    assert table.numbers() == [2, 3]
    (tmp_path / "t" / "v=3" / "_SUCCESS").unlink()
    assert table.numbers() == [2] and table.rows().count() == 3 and not table.has(3)
    table.write(spark.range(9), 3)
    assert table.rows().count() == 9 and table.rows(before=3).count() == 3
