"""Shingles hashed in step, sets dealt by them, and crowded buckets compared by blocks, against brute force."""

import random

import numpy as np
from docloom.llm import common, jaccard
from pyspark.sql import functions as F

from tests.llm.fixtures import odd_documents


def brute(text, width=5):
    words = (text or "").encode("utf-8", "replace").lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def test_hashes_tell_the_same_shingles_apart_as_words_do():
    rng = random.Random(2)
    long = " ".join(rng.choices([f"w{i}" for i in range(900)], k=40_000))
    texts = [r[1] for r in odd_documents()] + [long, "x" * 200_000 + " a b c d e", "tail " + "y" * 70_000, "A b\tC\nd\x0be f", "a B c D E F\x0c", "a\x1cb c d e f", "a a a a a", "a a a a a a a"]
    texts += [" ".join(rng.choices("ab", k=n)) for n in range(12)] + ["ab" * 20 + " c d e f", "ba" * 20 + " c d e f", "\ud800 b c d e"]
    sets = [jaccard.shingles(t) for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(sets, jaccard.shingle_sets(texts)))
    for t, s in zip(texts, sets):
        assert len(s) == len(brute(t)) and (np.diff(s) != 0).all()
    for width in (1, 5):
        every = [(brute(t, width), set(s.tolist())) for t, s in zip(texts, jaccard.shingle_sets(texts, width))]
        for a, x in every:
            for b, y in every:
                assert len(a & b) == len(x & y)


def test_a_passage_of_many_texts_crowds_no_bucket(spark):
    """All its shingles go behind the others, not only those that the first deal had in prefixes."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = rng.choices(vocabulary, k=80)
    texts = [" ".join(passage + rng.choices(vocabulary, k=50)) for _ in range(200)]
    texts += [texts[0] + " more", " ".join(rng.choices(vocabulary, k=60))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    scratch = common.Scratch(spark, "t")
    told = scratch.write(jaccard.summaries(rows), "told")
    first = jaccard.buckets(jaccard.prefixes(told, 8), 4, jaccard.LEAST)
    pairs, crowded = jaccard.meetings(rows, told, told, scratch, jaccard.WIDTH, jaccard.LEAST)
    assert not first.where("rows > 0").isEmpty() and crowded.isEmpty()
    ids = [jaccard._fp(jaccard.shingles(t)) for t in texts]
    assert tuple(sorted((ids[0], ids[200]))) in {tuple(sorted(r)) for r in pairs.collect()}


def test_blocks_of_a_bucket_give_the_pairs_of_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(int(k), i * 2**40, int(rng.integers(80, 140)), int(rng.integers(0, 20)), int(i % 5)) for k in (1, 2) for i in range(60)]
    live = spark.createDataFrame(rows, "key long, fp long, n int, pos int, of long")
    whole = {tuple(r) for r in jaccard.paired(live, (4, 5)).collect()}
    monkeypatch.setattr(jaccard, "TILE", 8)
    assert {tuple(r) for r in jaccard.paired(live, (4, 5)).collect()} == whole
    want = {(f, g) for k, f, m, i, o in rows for l, g, n, j, p in rows if k == l and f < g and o != p and min(m, n) * 5 >= max(m, n) * 4 and min(m - i, n - j) * 9 >= (m + n) * 4}
    assert whole == want and len(want) > 100


def test_a_filter_passes_the_texts_of_its_sets(spark):
    texts = [f"a text of its own with some words and the number {i}" for i in range(300)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    told = common.Scratch(spark, "t").write(jaccard.summaries(rows), "told")
    wanted = told.where("fp <> 0 and pmod(fp, 3) = 0").select("fp")
    got = jaccard.sets_of(rows, wanted, told, jaccard.WIDTH)
    assert sorted(r["fp"] for r in got.collect()) == sorted(r["fp"] for r in wanted.collect())
    assert got.where(F.size("set") == 0).isEmpty()
