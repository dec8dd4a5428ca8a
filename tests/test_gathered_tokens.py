"""Tokens are shuffled once, by document or page, and texts alike have nothing missing without a search."""

from docloom.operators import quality as Q
from docloom.sources import text as S

SCHEMA = "doc_id long, page int, block int, line int, n int, text string, left double, top double, width double, height double"


def test_tokens_to_text_shuffles_once(spark):
    rows = [(1, 1, 1, 1, 1, "b"), (1, 1, 1, 1, 0, "a"), (1, 1, 1, 2, 0, "c"), (1, 1, 2, 2, 0, "d"), (1, 2, 2, 2, 0, "e"), (1, None, 1, 1, 1, "y"), (1, None, 1, 1, 0, "x"), (1, 2, 2, 2, 1, " "), (2, 1, 1, 1, 0, None), (None, 1, 1, 1, 0, "z")]
    tokens = spark.createDataFrame([(*r, 0.0, 0.0, 1.0, 1.0) for r in rows], SCHEMA)
    made = S.tokens_to_text(tokens)
    assert made._jdf.queryExecution().sparkPlan().toString().count("ObjectHashAggregate") <= 2
    assert {r["doc_id"]: r["text"] for r in made.collect()} == {1: "x y\na b\nc\nd\ne", None: "z"}


def test_tokens_to_grid_gathers_pages(spark):
    rows = [(1, 1, 1, 1, 0, "Item", 0.0, 0.0), (1, 1, 1, 1, 1, "Qty", 300.0, 1.0), (1, 1, 1, 2, 0, "bolt", 0.0, 20.0), (1, 1, 1, 2, 1, "7", 300.0, 20.0), (1, 2, 1, 1, 0, "\u2003", 0.0, 0.0), (1, 2, 1, 1, 1, None, 0.0, 0.0), (None, None, 1, 1, 0, "z", 0.0, 0.0)]
    made = S.tokens_to_grid(spark.createDataFrame([(*r, 50.0, 12.0) for r in rows], SCHEMA))
    assert "collect_list" in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, made.collect()), key=str) == [(1, 1, 1, "Item\tQty"), (1, 1, 2, "bolt\t7"), (None, None, 1, "z")]


def test_texts_alike_are_not_searched(monkeypatch):
    assert Q.missing_tokens("call +1 212 555 0199, AB-12, 1,000 or ３", "AB-12") == 3
    monkeypatch.setattr(Q, "protected_tokens", None)
    assert Q.missing_tokens("AB-12 3", "AB-12 3") == 0
