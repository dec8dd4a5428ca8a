"""Queries over lines take what they need from one pass over each text, and give what the plain ways give."""

import pytest
from docloom.operators import extract as X
from docloom.operators import layout as L
from docloom.plans import catalog
from hypothesis import given, settings
from hypothesis import strategies as st

PIECES = st.sampled_from(["Item", "bolt", "nut", "Name: A", "name: B", "1,234", "a:b", "---", "HEAD", "", " ", "\t", "|", ";", ",", "\n", "\n", "\n", "Item\tQty\n", "Item | Qty\n", "x. y", '"a, b"', "[STRUCTURED x", "http://a", "00:1b:2c:3d:4e:5f"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=24).map("".join))
def test_lines_that_are_not_read_change_nothing(text):
    lines = text.split("\n")
    assert list(L.tables_of(L.run_lines(lines))) == list(L.tables_of(L.lines_of(lines)))
    assert [[x.number for x in run] for run in L.runs(L.run_lines(lines))] == [[x.number for x in run] for run in L.runs(L.lines_of(lines))]
    assert L.records_of(lines) == L.repeated_records(L.lines_of(lines))
    assert list(L.marks_of(lines)) == [x.mark for x in L.lines_of(lines)]


def test_lines_without_a_mark_are_not_read(monkeypatch):
    read = []
    plain = L.line_of
    monkeypatch.setattr(L, "line_of", lambda n, x: read.append(n) or plain(n, x))
    assert [n for _, n, _, _ in L.tables_of(L.run_lines(["Total: 5", "prose", "Item\tQty", "bolt\t1", "nut", "", "Role: x", "y"]))] == [1, 2]
    assert read == [3, 4, 5, 6]


@pytest.mark.parametrize("name", ["x13_table_fields", "x20_attach_provenance", "x22_project_records", "x23_with_document_fields", "x29_project_source_table", "x4_repeated_records", "s12_neutralize_formula", "x8_extract_tables"])
def test_one_pass_without_join_or_shuffle(spark, sf, name):
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not any(x in plan for x in ("Join", "Window", "Aggregate", "map<string"))


def test_records_take_their_document_s_fields(spark):
    text = "Total: 9\nCity: Oslo\n\nItem\tTotal\tdocument_total\nbolt\t1\t2\nnut\t3\t4"
    docs = spark.createDataFrame([(1, text), (1, "City: Rome\n\nItem\tQty\nbolt\t1"), (None, text), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["record"]) for r in X.records_with_fields(docs, ["total", "CITY"], text=True).collect())
    rows = ["Item=bolt;Total=1;city=Oslo;document_document_total=9;document_total=2", "Item=nut;Total=3;city=Oslo;document_document_total=9;document_total=4"]
    assert got == sorted([("1", "Item=bolt;Qty=1;city=Rome"), *[(i, r) for i in ("1", "None") for r in rows]])
    as_maps = sorted((str(r["doc_id"]), X.entries_text(r["values"])) for r in X.records_with_fields(docs, ["total", "CITY"]).collect())
    assert as_maps == got
    assert [tuple(r) for r in X.table_sizes(docs.where("doc_id is null")).collect()] == [(None, 2, 6)]
    named = X.tables(X.with_provenance(docs.where("doc_id = 1")), "filename", "checksum")
    assert {r["filename"] for r in named.collect()} == {"doc-1.txt"} and named.select("checksum").distinct().count() == 2
