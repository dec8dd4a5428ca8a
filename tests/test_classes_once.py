"""Signals of classes are searched once for each text, and odd texts have the class that their signals say."""

from docloom.operators import extract as X
from docloom.plans import catalog


def test_classes_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "Invoice No: 1"), (3, "patient with a diagnosis\nTicket"), (4, "to: a\nfrom: b")], "doc_id long, text string")
    assert {r["doc_id"]: r["classes"] for r in X.infer_classes(docs).collect()} == {1: ["form"], 2: ["form"], None: ["invoice"], 3: ["medical_record"], 4: ["memo"]}


def test_a_signal_is_searched_once(spark, sf):
    plan = catalog.queries()["c3_infer_extraction_class"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\bpremium\b") <= 3  # once for each of the three tables
