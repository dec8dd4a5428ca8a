"""Operators read whole texts."""

from docloom.operators import classify


def test_phrases_far_into_a_text_count(spark):
    far = "filler words here " * 14_000
    assert len(far) > 250_000
    rows = [(1, far + "tax invoice, amount due", ""), (2, "curriculum vitae, work experience " + far + "I am writing to apply", "")]
    got = classify.privacy_type(spark.createDataFrame(rows, "doc_id long, text string, filename string")).collect()
    assert {r["doc_id"]: r["document_type"] for r in got} == {1: "invoice", 2: "correspondence"}


def test_queries_return_every_document(spark, tmp_path):
    import __spark_entry__

    rows = [(i, "some words of a text", "en", "src1", 20) for i in range(1, 9)] + [(9, "a\x00b", "en", "src1", 3), (10, "a" * 300, "en", "src1", 300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    queries = __spark_entry__.queries()
    for name in ("q13_token_coverage_halved", "s7_ocr_tokens_to_grid", "t32_text_policy_violations"):
        assert {r["doc_id"] for r in queries[name](spark, str(tmp_path)).collect()} == set(range(1, 11)), name
