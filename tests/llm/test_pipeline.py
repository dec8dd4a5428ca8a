"""The pipeline's stages take effect, keep the rest and fit together."""

import random

import corpus_pipeline
from docloom.llm import bpe

from tests.llm.fixtures import write_documents


def corpus():
    rng = random.Random(8)
    words = [f"w{i}o" for i in range(300)]
    rows, labels = [], []
    for i in range(300):
        text = rng.choices(words, k=60)
        if i % 6 == 0:
            text[3], text[30], text[50] = "flegel", "flegel", "grobian"
        if i == 7:
            text[5] = "password=mine77only"
        rows.append([i, " ".join(text), "en", f"src{i % 3}"])
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [[400 + i, rows[1][1], "en", "src1"] for i in range(5)] + [[500, None, None, None], [501, "", "en", "src2"]]
    return [(i, t, l, s, 1, 1, "", 1, "") for i, t, l, s in rows], labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    folder = write_documents(spark, tmp_path, rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
        assert name == "bpe" or docs.columns == columns
    ids = {name: [r["doc_id"] for r in got] for name, got in kept.items()}
    assert sorted(ids["toxicity"]) == sorted(r[0] for r in rows if r[0] % 6 or r[0] >= 300)
    assert sorted(ids["near_dedup"]) == sorted(i for i in ids["toxicity"] if not 400 <= i < 405 and i != 501)
    assert sorted(ids["secrets"]) == sorted(ids["near_dedup"])
    assert [("[secret]" in (r["text"] or "")) for r in kept["secrets"] if r["doc_id"] == 7] == [True]
    assert set(ids["mixing"]) <= set(ids["secrets"]) and max(ids["mixing"].count(i) for i in set(ids["mixing"])) <= 3
    assert sorted(ids["bpe"]) == sorted(ids["mixing"])
    model = bpe.load(bpe.default_vocabulary())
    sizes = {r["doc_id"]: len(model.encode([r["text"] or ""])[0]) // 4 for r in kept["mixing"]}
    assert all(r["n_tokens"] == sizes[r["doc_id"]] for r in kept["bpe"])


def test_run_is_the_stages(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0
