"""Fields folded within documents, against plain rules and against the merge of several sources."""

from docloom.operators import extract as X
from docloom.operators import fields as FD
from pyspark.sql import functions as F

TEXT = "Invoice No: A-1\nCustomer: Ann\ncustomer: Bob\nDate: 1/2/2024\nInvoice date: 3/2/2024\nTotal: $5\n[STRUCTURED x: y]\nTotal: $5\nTotal: $9\nnote\n"


def test_fields_of_a_document():
    lines = TEXT.splitlines()
    assert [f[:2] for f in FD.key_values(lines)] == [("Invoice No", "A-1"), ("Customer", "Ann"), ("Date", "1/2/2024"), ("Invoice date", "3/2/2024"), ("Total", "$5")]
    assert [f[1] for f in FD.key_values(lines, True) if f[0].lower() in ("customer", "total")] == ["Ann", "Bob", "$5", "$9"]
    assert list(FD.class_fields(lines, X.CLASS_FIELDS["invoice"])) == [("invoice_number", "A-1", 0.92, 1), ("invoice_date", "3/2/2024", 0.92, 5), ("total", "$5", 0.92, 6)]
    assert FD.merged([("A b", "", 0.9, 1)], [("a-b", "x", 0.5, 2)], [("A B", "x", 0.7, 3)], [("a b", "y", 0.99, 4)]) == [("a_b", "a-b", "x", 0.7, 2)]
    assert sorted(FD.reviewed([("A", "1", 1, 1), ("a", "2", 1, 2), ("b", " 1 ", 1, 3), ("c", "", 1, 4)])) == [("a", "needs_review", "", "1|2"), ("b", "found", "1", "1"), ("c", "not_found", "", "")]


def test_a_number_without_a_digit_needs_a_sign():
    patterns = {"ticket_number": [r"ticket\s*[:#]?\s*(\S+)"]}
    assert list(FD.class_fields(["Ticket system", "Ticket # abc"], patterns)) == [("ticket_number", "abc", 0.92, 2)]
    assert list(FD.class_fields(["ticket 7x"], patterns)) == [("ticket_number", "7x", 0.92, 1)]


def test_nothing_is_shuffled(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (None, "")], "doc_id long, text string")
    for made in (X.document_fields(docs, "invoice"), X.document_review(docs), X.key_values(docs), X.class_fields(docs, "invoice")):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["norm"]: (r["value"], r["confidence"]) for r in X.document_fields(docs, "invoice").collect()}
    # the same from the merge of sources by a shuffle
    both = X.merge_fields(X.class_fields(docs, "invoice"), X.key_values(docs))
    assert got == {r["norm"]: (r["value"], r["confidence"]) for r in both.collect()} and got["total"] == ("$5", 0.92)
    status = {r["norm"]: r["status"] for r in X.document_review(docs).collect()}
    assert status["customer"] == status["total"] == "needs_review" and status["date"] == "found"
    again = X.review_status(X.key_values(docs, all_values=True)).select("norm", "status", "value", "candidates")
    assert again.exceptAll(X.document_review(docs).select("norm", "status", "value", "candidates")).count() == 0
    assert X.key_values(docs).where(F.col("doc_id") == 2).count() == 0


def test_letters_that_a_signal_needs():
    assert [X.literal_in(p) for p in (r"\binvoice\b", r"\binv(?:oice)?\s*(?:no\.?|number|#)", r"\b(?:kyc|know\s+your)\b", r"(?m)^\s*to\s*[:\-]", r"driver'?s\s+licen[cs]e", r"ab?c", "a|b", r"\bdue\s+date\b", "x(a(b|c))yz")] == ["invoice", "inv", "", "to", "driver", "a", "", "date", "yz"]


def test_signals_match_where_their_letters_are():
    import re

    texts = ["an invoice, invoice no 5, due date today", "purchase order, vendor x", "know your customer kyc", "to: a\nfrom: b\nsubject: c", "driver's license and passport", "amount due", ""]
    for signals, alone in X.SIGNALS.values():
        for p in [*signals, *([alone] if alone else [])]:
            assert all(X.literal_in(p) in t for t in texts if re.search(p, t)), p
