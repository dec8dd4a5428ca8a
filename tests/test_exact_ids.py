"""Ids beyond 2^53 beside nulls come back as they were from every operator that runs in Python."""

import pytest
from docloom.operators import classify, detect, extract, quality
from docloom.operators import relational as R
from docloom.operators import rules
from docloom.operators import words as W
from docloom.sources import text as T
from docloom.streaming import quotas as K
from pyspark.sql import functions as F

IDS = [None, 2**53 + 1, 2**60 + 3]
TEXT = "Name: Ann Lee\nRole: clerk\nName: Bob Ray\nRole: cook\n\nItem\tQty\nbolt\t1\n\nmail a.b@example.com, card 4111 1111 1111 1111\n\nSubject line here. Missing words stay.\n"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, TEXT) for i in IDS], "doc_id long, text string").coalesce(1)


def pairs(docs):
    return docs.select("doc_id", F.col("text").alias("source"), F.lit("else").alias("output"))


OPERATORS = {
    "detect": lambda d: detect.detect(d, countries=["Nigeria"]),
    "redacted": lambda d: detect.redacted(d, countries=["Nigeria"]),
    "found_by_rules": lambda d: detect.found_by_rules(d, ["email_address"], ["Nigeria"]),
    "contextual_names": lambda d: detect.contextual_names(d, ["Nigeria"]),
    "told_apart": lambda d: detect.told_apart(d.select(F.col("doc_id").alias("id"), F.lit("name").alias("label"), F.lit("Ann").alias("value")), lambda label, v: detect.name_like(v)).withColumnRenamed("id", "doc_id"),
    "external": lambda d: detect.external_findings(d, lambda t: [(0, 4, "name")]),
    "chunk_by_bytes": lambda d: detect.chunk_by_bytes(d, 40, 4),
    "literals": lambda d: detect.literal_findings(d, ["clerk"]),
    "tables": extract.tables,
    "records": extract.records,
    "requested": lambda d: extract.requested(d, ["Subject"]),
    "pieces": lambda d: quality.pieces(d, lambda t: quality.partition_exact(t, 50)),
    "pack_units": lambda d: quality.pack_units(quality.pieces(d, lambda t: quality.partition_exact(t, 50)), 10, 60),
    "token_coverage": lambda d: quality.token_coverage(pairs(d)),
    "missing_paragraphs": lambda d: quality.missing_paragraphs(pairs(d)),
    "per_pair": lambda d: quality.per_pair(pairs(d), lambda s, o: s == o, "same boolean"),
    "text_model": lambda d: quality.apply_text_model(d, lambda t: t[:5], lambda s, o: True),
    "privacy_type": lambda d: classify.privacy_type(d.withColumn("filename", F.lit("cv.pdf"))),
    "section_languages": lambda d: classify.section_languages(d, lambda s: {"en": 0.9}),
    "html": lambda d: T.html_visible_text(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"))).withColumnRenamed("page_id", "doc_id"),
    "build_chain": lambda d: R.build_chain(d.select(F.col("doc_id").alias("organization_id"), F.lit(1).cast("long").alias("id"), F.col("text").alias("canonical"))).withColumnRenamed("organization_id", "doc_id"),
    "quota": lambda d: K.admit(d.select(F.lit("k").alias("key"), F.col("doc_id").alias("event_id"), F.lit(5).cast("long").alias("ts"), F.lit(1).cast("long").alias("cost")), K.sliding_quota(2, 10)).withColumnRenamed("event_id", "doc_id"),
    "search": lambda d: rules.search(d.select(F.lit("s").alias("doc_set"), "doc_id", F.lit(1).alias("page_number"), "text"), signal(d.sparkSession)),
}


def signal(spark):
    row = spark.createDataFrame([("r", ["clerk"])], "rule_id string, required array<string>")
    none = F.array().cast("array<string>")
    return row.select("rule_id", F.lit("substring").alias("search_mode"), F.lit(False).alias("case_sensitive"), F.lit(20).alias("excerpt_window"), F.lit(5).alias("max_matches"), "required", none.alias("optional"), none.alias("prohibited"), *[F.lit(None).cast("string").alias(c) for c in ("on_missing", "on_partial", "on_prohibited")], F.lit(1).alias("min_count"))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_ids_are_kept(docs, name):
    got = OPERATORS[name](docs)
    assert dict(got.dtypes)["doc_id"] == "bigint" and {r["doc_id"] for r in got.select("doc_id").collect()} == set(IDS)


def test_null_keys_are_one_key(spark):
    events = spark.createDataFrame([(None, 1, 5, 1), (None, 2, 6, 1), ("a", None, 5, 1), (None, 3, None, 1)], "key string, event_id long, ts long, cost long").coalesce(1)
    got = {(r["key"], r["event_id"]): r["admitted"] for r in K.admit(events, K.sliding_quota(1, 100)).collect()}
    assert got == {(None, 3): True, (None, 1): False, (None, 2): False, ("a", None): True}
    units = spark.createDataFrame([(None, n, "one two three") for n in range(1, 5)], "doc_id long, n int, piece string")
    assert sorted((r["n"], r["chunk"]) for r in quality.pack_units(units, 6, 100).collect()) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    said = spark.createDataFrame([(None, 0.0, 1.0, "Hello.", 1), (None, 5.0, 6.0, "Bye", 1)], "media_id string, start_s double, end_s double, text string, speaker int")
    assert [(r["media_id"], r["n"], r["speaker"]) for r in W.subtitle_cues(said).orderBy("n").collect()] == [(None, 1, 1), (None, 2, 1)]
