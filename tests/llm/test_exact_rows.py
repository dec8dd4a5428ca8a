"""Ids beyond the whole numbers of floats beside nulls, long texts, empty tables, and brute-force twins of whole queries."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from docloom.llm import bpe, brown, flac, language, secret_scan, simhash, toxicity, warc
from docloom.llm.common import Scratch

from tests.llm.fixtures import write_documents

IDS = [None, 2**53 + 1, 2**60 + 3, -(2**62) - 1, 7]
QUERIES = {"bpe": bpe.query, "flac": flac.query, "language": language.query, "simhash": simhash.query, "secrets": secret_scan.query, "toxicity": toxicity.query, "brown": brown.query}
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    rows = [(i, f"text number {n} of some words here", "en", "s", 1, 1, "", 1, "") for n, i in enumerate(IDS)]
    folder = write_documents(spark, tmp_path_factory.mktemp("far"), rows)
    spark.createDataFrame([(i, 1, n % 2) for n, i in enumerate(IDS)], LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, "<p>" + "x" * 200) for i in IDS], "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    folder = write_documents(spark, tmp_path_factory.mktemp("none"), [])
    spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_ids_are_exact(spark, far, name):
    assert Counter(r["doc_id"] for r in QUERIES[name](spark, far).collect()) == Counter(IDS)


def test_page_ids_are_exact(spark, far):
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.query(spark, far).collect()}
    least = min(i for i in IDS if i is not None)
    assert got == {i: ("response", None) if i == least else ("revisit", least) for i in IDS}


def test_pipeline_stages_keep_exact_rows(spark, far):
    docs = spark.read.parquet(f"{far}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert sorted(stage(spark, docs, far).collect(), key=str) == sorted(docs.collect(), key=str), name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, none, name):
    got = QUERIES[name](spark, none)
    assert "doc_id" in got.columns and got.count() == 0


def test_pipeline_on_empty_and_null_tables(spark, none, tmp_path):
    assert corpus_pipeline.run(spark, none).count() == 0
    folder = write_documents(spark, tmp_path, [(None, None, None, None, None, None, None, None, None)] * 3)
    spark.createDataFrame([(None, None, None)], LABELS).write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, folder).count() == 3 and stages["near_dedup"](spark, docs, folder).count() == 1
    assert stages["secrets"](spark, docs, folder).count() == 3 and stages["mixing"](spark, docs, folder).count() == 0


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    folder = write_documents(spark, tmp_path, [(1, text, "en", "s", 1, 1, "", 1, ""), (2, text[: len(text) // 2], "en", "s", 1, 1, "", 1, "")])
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], LABELS).write.parquet(f"{folder}/labels.parquet")
    got = {name: {r["doc_id"]: r for r in query(spark, folder).collect()} for name, query in QUERIES.items()}
    assert all(set(rows) == {1, 2} for rows in got.values())
    assert got["flac"][1]["n_bytes"] == len(text) and got["brown"][1]["n_tokens"] == 60_001
    assert int(got["simhash"][1]["fingerprint"], 16) == simhash.fingerprint(text)


# Secrets

KEY = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}")


def test_live_spans_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    values = ["".join(rng.choices("ABCDEFGHIJKLMNOPqrstuvwxyz0123456789", k=rng.randrange(18, 30))) for _ in range(30)]
    rows = []
    for i in range(160):
        words = [rng.choice(["plain", "words", "of", "text"]) for _ in range(12)]
        words[rng.randrange(12)] = values[min(rng.randrange(30), rng.randrange(30))]
        words[0] = rng.choice(["x", f"token={values[rng.randrange(5)]}"])
        rows.append((i, " ".join(words), rng.choice(["en", "de", "fr", None]), rng.choice(["s1", "s2", "s3", None]), 1, 1, "", 1, ""))
    folder = write_documents(spark, tmp_path, rows)
    got = {r["doc_id"]: r["spans"] for r in secret_scan.query(spark, folder).collect()}
    base, loose, owners, repos = {}, {}, defaultdict(set), defaultdict(set)
    for i, text, lang, source, *_ in rows:
        base[i] = [(m.start(), "assign", m.end(), m[2]) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        base[i] += [(m.start(), "hex", m.end(), m[0]) for m in re.finditer("[0-9a-f]{24,}", text)]
        loose[i] = [(m.start(), "live", m.end(), m[0]) for m in KEY.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b, _ in base[i])]
        for s in base[i] + loose[i]:
            owners[s[3]].add(source)
            repos[s[3]].add((source, lang))
    live = lambda v: not (len(owners[v]) >= 3 or len(owners[v]) > 1 and len(repos[v]) >= 4)
    assert any(map(live, owners)) and not all(map(live, owners)) and any(not live(v) and len(owners[v]) < 3 for v in owners)
    for i in got:
        kept = sorted(base[i] + [s for s in loose[i] if live(s[3])])
        assert got[i] == ",".join(f"{k}:{a}:{b}" for a, k, b, _ in kept)


# Language


def test_predictions_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def profile(text):
        letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
        words = " " + " ".join(letters.split()) + " "
        out = np.zeros(language.WIDTH)
        for i in range(len(words) - 2):
            a, b, c = (language.letter_vector(ord(x)).astype(int) for x in words[i : i + 3])
            out += np.roll(a, 2) * np.roll(b, 1) * c
        return out, max(1, len(words) - 2)

    made = defaultdict(lambda: np.zeros(language.WIDTH))
    for _, text, lang in rows:
        v, n = profile(text)
        made[lang] += v / np.sqrt(n)
    names, learned = language.prototypes(docs.select("text", "lang"))
    assert names == sorted(made)
    for name, v in zip(names, learned):
        assert np.allclose(v, made[name] / np.linalg.norm(made[name]), atol=1e-5)
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for r in language.predict(docs.select("doc_id", "text"), names, learned).collect():
        v = profile(dict((i, t) for i, t, _ in rows)[r["doc_id"]])[0]
        score = {n: cosine(v, made[n]) for n in names}
        assert abs(r["score"] - max(score.values())) < 1e-4 and score[r["lang_pred"]] > max(score.values()) - 1e-4


# Toxicity


def test_lexicon_against_brute_force_and_exceptions(spark):
    rng = random.Random(7)
    plain = [f"word{i}x" for i in range(300)]
    texts = {}
    for i in range(900):
        words, toxic = rng.choices(plain, k=40), i % 4 == 0
        if toxic:
            words[5], words[20] = rng.choice(["grobian", "flegel"]), "flegel"
        elif i % 24 == 1:
            words[10:12] = ["flegel", "harke"]  # a harmless pair of words
        texts[i] = (" ".join(words), int(toxic))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in texts.items()], "_id long, toxic int")
    lexicon = toxicity.fit(docs, labels, Scratch(spark, "lexicon"))
    known = [(r["text"], r["toxic"]) for r in toxicity._labelled(docs, labels, Scratch(spark, "known"), 10_000).collect()]
    pos, neg = Counter(), Counter()
    for t, y in known:
        (pos if y else neg).update({w[:n] for w in set(t.split()) for n in toxicity.STEMS if n <= len(w)})
    toxic, clean = sum(y for _, y in known), sum(not y for _, y in known)
    assert 850 < toxic + clean <= 900
    for stem, weight in lexicon.weights.items():
        assert abs(weight - math.log((pos[stem] + 0.5) / (toxic + 1) / ((neg[stem] + 0.5) / (clean + 1)))) < 1e-9
    assert {w[:3] for w in lexicon.weights} == {"gro", "fle"}
    assert "flegel harke" in lexicon.exceptions
    text = " ".join(plain[:30]) + " flegel harke"
    assert lexicon.score(text) < toxicity.TOXIC_AT <= lexicon.score(text.replace(" harke", "") + " flegel")
    without = toxicity.Lexicon(lexicon.weights, (), lexicon.curve)
    assert without.score(text) > lexicon.score(text)


def test_near_copies_of_labelled_documents_count_once(spark):
    texts = ["one two three four five six"] * 5 + ["seven eight nine ten eleven"] + ["quite another text than those"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(6, "and a repeated id with more text")], "_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 5)) for i in range(7)], "_id long, toxic int")
    got = toxicity._labelled(docs, labels, Scratch(spark, "labelled"), 100).collect()
    assert sorted((r["toxic"], r["text"]) for r in got) == [(0, "and a repeated id with more text"), (0, texts[0]), (1, texts[5])]
