"""The pipeline drops near copies by five-word shingles and a similarity of 0.8, against brute force."""

import random

import corpus_pipeline
import numpy as np
from docloom.llm import common, jaccard, simhash
from pyspark.sql import functions as F

from tests.llm.fixtures import odd_documents, write_documents


def brute_kept(texts):
    """Smallest id of each component of texts at a Jaccard similarity of 0.8 of their five-word shingles."""
    sets = {}
    for i, t in texts:
        words = (t or "").lower().split()
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a == b or len(a & b) * 5 >= len(a | b) * 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted({find(i) for i in ids})


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"edit{rng.randrange(10**6)}"
    return out


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randrange(30, 200))
        texts += [base, base] + [edited(rng, base, n) for n in (1, 1, 2, 3, 4)]
    passage = rng.choices(vocabulary, k=60)
    texts += [passage + rng.choices(vocabulary, k=rng.randrange(20, 120)) for _ in range(120)]
    large = rng.choices(vocabulary, k=100)
    texts += [edited(rng, large, rng.randrange(5)) for _ in range(150)]
    texts += [rng.choices(vocabulary, k=n) for n in range(1, 8)] + [[], []]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_edited_copies_are_dropped(spark, tmp_path):
    texts = corpus()
    folder = write_documents(spark, tmp_path, [(i, t, "en", "src1", 1, 1, "", 1, "") for i, t in texts])
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert sorted(r["doc_id"] for r in stage(spark, docs, folder).collect()) == brute_kept(texts)


def test_odd_documents(spark, tmp_path):
    folder = write_documents(spark, tmp_path)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute_kept([(r[0], r[1]) for r in odd_documents() if r[0] is not None])
    got = [r["doc_id"] for r in stage(spark, docs, folder).collect()]
    assert sorted(i for i in got if i is not None) == want and got.count(None) == 1


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    texts = corpus()[:250]
    rows = spark.createDataFrame([(i, t) for i, t in texts], "_id long, text string")
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 3)
    got = {}
    for r in jaccard.groups(rows, common.Scratch(spark, "t")).collect():
        got.setdefault(r["root"], []).append(r["_id"])
    assert sorted(map(min, got.values())) == brute_kept(texts)


def test_sketches_never_exceed_the_difference():
    rng = random.Random(3)
    for _ in range(200):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 400))]
        a, b = jaccard.shingles(" ".join(base)), jaccard.shingles(" ".join(edited(rng, base, rng.randrange(min(len(base), 9) + 1)) + base[: rng.randrange(60)]))
        assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_a_repeated_id_loses_no_other_text(spark, tmp_path):
    a, b = "one two three four five six seven", "quite another text of its own that stays"
    rows = [(1, a), (8, a), (8, b), (8, b), (None, a), (None, "without an id")]
    folder = write_documents(spark, tmp_path, [(i, t, "en", "s", 1, 1, "", 1, "") for i, t in rows])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage in (dict(corpus_pipeline.STAGES)["near_dedup"], lambda spark, docs, folder: simhash.keep_one(docs)):
        got = [(r["doc_id"], r["text"]) for r in stage(spark, docs, folder).collect()]
        assert sorted(got, key=str) == [(1, a), (8, b), (None, "without an id")]


def test_components_of_long_paths_take_few_rounds(spark):
    scratch = common.Scratch(spark, "path")
    edges = spark.range(1, 1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = common.components(edges, scratch)
    assert got.count() == 1000 and got.where("component <> 1").isEmpty()
    assert scratch.n <= 25


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400) * 2**50, rng.randrange(400) * 2**50) for _ in range(350)]
    least = {x: x for p in pairs for x in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = common.components(spark.createDataFrame(pairs, "a long, b long"), common.Scratch(spark, "random"))
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in got.collect()} == {x: least[x] for x in nodes}


def test_signs_never_part_similar_sets(spark):
    """Folded sketches allow every pair that the sketches themselves allow, and rule out pairs that are far apart."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(-(2**63), 2**63, 400))
    sets = [np.unique(np.concatenate((base[rng.permutation(len(base))[: len(base) - k]], rng.integers(-(2**63), 2**63, k)))) for k in (0, 10, 20, 40, 80, 160) for _ in range(4)]
    sets += [np.unique(rng.integers(-(2**63), 2**63, n)) for n in (1, 5, 70, 130)]
    rows = [(i, len(s), bytearray(jaccard.sketch(s))) for i, s in enumerate(sets)]
    about = spark.createDataFrame(rows, "fp long, n int, sketch binary")
    live = about.select(F.lit(1).cast("long").alias("key"), "fp", "n", F.lit(0).alias("pos"), F.col("fp").alias("of")).join(jaccard.signs(about), "fp")
    got = {tuple(r) for r in jaccard.paired(live, (4, 5), signed=True).collect()}
    every = {tuple(r) for r in jaccard.paired(live, (4, 5)).collect()}
    similar = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))}
    assert similar and similar <= got < every


def test_a_pair_leaves_one_bucket_of_those_it_shares(spark):
    """The pairs of large buckets are all there, and a pair that shares many shingles comes out of the first bucket alone."""
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(-(2**63), 2**63, 120))
    sets = [np.unique(np.concatenate((base[rng.permutation(len(base))[:116]], rng.integers(-(2**63), 2**63, 4)))) for _ in range(12)]
    about = spark.createDataFrame([(i, len(s), bytearray(jaccard.sketch(s))) for i, s in enumerate(sets)], "fp long, n int, sketch binary")
    dealt = [(int(k), i, len(s), at, i) for i, s in enumerate(sets) for at, k in enumerate(s[: len(s) // 5 + 1])]
    live = jaccard.with_before(spark.createDataFrame(dealt, "key long, fp long, n int, pos int, of long")).join(jaccard.signs(about), "fp")
    rows = [tuple(r) for r in jaccard.met_pairs(live, (4, 5), signed=True).collect()]
    every = {tuple(r) for r in jaccard.paired(live, (4, 5)).collect()}
    similar = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))}
    assert similar and similar <= set(rows) <= every
    shared = sum(len({k for k, f, *_ in dealt if f == i} & {k for k, f, *_ in dealt if f == j}) for i, j in similar)
    assert shared > 10 * len(similar)
    assert len(rows) < 1.2 * len(set(rows))


def test_fingerprints_link_near_copies_before_the_join(spark, monkeypatch):
    """Pairs by pivot tables are those at two bits, up to connection, and connect near copies by themselves; a pair that is not similar is not linked."""
    rng = random.Random(8)
    long = rng.choices([f"w{i}" for i in range(3000)], k=2000)
    texts = [(i, " ".join(edited(rng, long, n))) for i, n in enumerate([0, 1, 1, 2, 2, 3])] + [(9, "alone")]
    sets = {i: jaccard.shingles(t) for i, t in texts}
    near = {(i, j) for i in sets for j in sets if i < j and (jaccard.fingerprint(sets[i]) ^ jaccard.fingerprint(sets[j])).bit_count() <= simhash.NEAR}
    assert near and jaccard.fingerprint(sets[9]) == simhash._signed(simhash.fingerprint("alone", 5))
    rows = spark.createDataFrame(texts, "_id long, text string")
    scratch = common.Scratch(spark, "t")
    told = scratch.write(jaccard.summaries(rows), "told")
    names = {r["fp"]: r["_id"] for r in told.collect()}
    got = {tuple(sorted((names[r["a"]], names[r["b"]]))) for r in jaccard.fingerprint_pairs(told, scratch).collect()}
    assert got and got <= near
    asked = []
    monkeypatch.setattr(jaccard, "starred", lambda live, *_: asked.append(1) or live.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false"))
    monkeypatch.setattr(jaccard, "paired", jaccard.starred)
    roots = {r["_id"]: r["root"] for r in jaccard.groups(rows, scratch).collect()}
    assert asked and all(roots[i] == roots[j] for i, j in near) and roots[9] not in {roots[i] for i in range(6)}
