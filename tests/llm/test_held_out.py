"""Held-out documents teach nothing, and what queries return is what their models and codecs give text by text."""

import hashlib
import math

import pytest
from docloom.llm import flac, language, toxicity
from docloom.llm.common import Scratch, table
from pyspark.sql import functions as F

def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1



@pytest.fixture(scope="module")
def twin(spark, sf, tmp_path_factory):
    """The data set with other languages and labels for the held-out documents."""
    path = str(tmp_path_factory.mktemp("twin"))
    table(spark, sf, "documents").withColumn("lang", F.when(held(), F.lit("xx")).otherwise(F.col("lang"))).write.parquet(f"{path}/documents.parquet")
    table(spark, sf, "labels").withColumn("toxic", F.when(held(), 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("query", [language.query, toxicity.query])
def test_held_out_documents_teach_nothing(spark, sf, twin, query):
    rows = lambda path: {r["doc_id"]: tuple(r) for r in query(spark, path).collect()}
    one, other = rows(sf), rows(twin)
    assert one.keys() == other.keys() and any(r[1] for r in one.values())
    for i, a in one.items():
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a, other[i]))
    assert not any("xx" in map(str, r) for r in other.values())


def test_scores_are_those_of_the_lexicon(spark, sf):
    docs = table(spark, sf, "documents")
    lexicon = toxicity.trained(docs, table(spark, sf, "labels"), Scratch(spark, "t"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = toxicity.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        words = toxicity.folded_words(texts[r["doc_id"]] or "")
        plain = " ".join(words)
        safe = [(k, k + len(p)) for p in lexicon.exceptions for k in range(len(plain)) if f" {plain} ".startswith(f" {p} ", k)]
        total, at = 0.0, 0
        for w in words:
            for n in toxicity.STEMS:
                if n <= len(w) and w[:n] in lexicon.weights and not any(a <= at and at + n <= b for a, b in safe):
                    total += lexicon.weights[w[:n]]
            at += len(w) + 1
        x = (1.0, math.log1p(total), math.log1p(100 * total / max(len((texts[r["doc_id"]] or "").split()), 20)))
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(c * v for c, v in zip(lexicon.curve, x))))))
        assert math.isclose(r["score"], want, rel_tol=1e-9, abs_tol=1e-12) and r["predicted"] == int(want >= 0.7)


def test_media_are_those_of_each_text_alone(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    got = flac.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got[::7]:
        data = texts[r["doc_id"]].encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        media = flac.encode([payload])[0]
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), flac.features(payload)) and r["payload_bytes"] == len(payload)
