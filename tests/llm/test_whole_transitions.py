"""The class model counts the transitions of all neighbours of training texts, those of rare words included."""

import random

import numpy as np
from docloom.llm import brown, common
from pyspark.sql import functions as F


def test_every_neighbour_is_a_transition(spark):
    rng = random.Random(8)
    rare = [f"r{i}".encode() for i in range(60)]
    often = [f"w{i}".encode() for i in range(20)]
    texts = [b" ".join(rng.choice(often if rng.random() < 0.6 else rare) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [b"", b"r1 r2 r1 r2", b"r3"]
    docs = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "_id long, text binary")
    scratch = common.Scratch(spark, "steps")
    vocab = scratch.write(brown.count_words(docs.select("text")), "words")
    top, least = brown.numbered_words(vocab, 20)
    assert 0 < len(top) <= 20
    numbered = scratch.write(brown.number(docs, top["word"].tolist()).withColumn("row", F.monotonically_increasing_id()), "numbered")
    model, table = brown.train(numbered, vocab, top, least, scratch, classes=4)
    class_of = {r["h"]: r["class"] for r in table.collect()}
    numbers, k = {w: i for i, w in enumerate(top["word"])}, 5
    want = np.zeros((k, k))
    signed = lambda w: int(np.uint64(brown.xxhash.xxh64_intdigest(w, 42)).astype(np.int64))
    for t in texts:
        c = [4, *[int(model["class_of"][numbers[w]]) if w in numbers else class_of[signed(w)] for w in t.split()], 4]
        for a, b in zip(c, c[1:]):
            want[a, b] += 1
    got = 10 ** model["log_transition"]
    assert np.allclose(got, (want + brown.SMOOTH) / (want.sum(axis=1, keepdims=True) + brown.SMOOTH * k))


def test_units_tell_each_text_s_rare_words(spark):
    texts = [b"a x a y X", b"", b"z z", b"a", b"y x"]
    rows = brown.number(spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "_id long, text binary"), [b"a"]).collect()
    signed = lambda w: int(np.uint64(brown.xxhash.xxh64_intdigest(w, 42)).astype(np.int64))
    for r in rows:
        told = [b"a", None, *[None] * len(r["h"])]
        ids = np.frombuffer(r["units"], np.int32).tolist()
        want = [w.lower() for w in texts[r["_id"]].split()]
        assert ids[-1] == 1 and len(ids) == len(want) + 1 and len(set(r["h"])) == len(r["h"])
        for i, w in zip(ids, want):
            assert w == told[i] if i < 1 else r["h"][i - 2] == signed(w) and np.frombuffer(r["e"], np.int16)[i - 2] == brown.ending(w)
